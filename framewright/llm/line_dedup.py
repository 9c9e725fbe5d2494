"""Line dedup by a segment-partition edit join (Pass-Join)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bloom
from .edits import within
from .shared import drop, keep, ship, table, unused
from .shingles import BYTE_HASH, mix, powers

EDITS = 2
MIN_CHARS = 40  # shorter lines are not compared by edits


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(length less, segment, shift): which substrings of a line to look up among segments of lines shorter by 0 to `edits`.

    Multi-match-aware: with i segments before it at most i edits come before a matching one, or those after it would
    leave another match; likewise from the right.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(less, i, x) for x in range(low, high + 1)]
    return out


KINDS = 16  # characters are counted by the lower half of their last byte
SLAB = 1 << 20  # bytes of lines that are handled at once
GROUP = 1 << 12  # lines with a key in common that one task holds against each other
KEY = "key long, h1 long, own boolean, letters long"
MET = "hot long, x long, y long, own boolean"
_U = np.uint64


class _Lines:
    """Lines side by side: hashes of any substring of each, and counts of their characters."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        """ends: len(lines) + 1 byte offsets, from 0."""
        self.raw, self.ends = raw, ends
        starts = np.flatnonzero(raw & 0xC0 != 0x80)  # of characters
        self.first = np.searchsorted(starts, ends)
        self.length = np.diff(self.first)
        self.starts = np.append(starts, len(raw))
        self.total = None
        if len(raw) <= 2 * SLAB:  # else there is one line, of which single substrings are summed up
            self.up, self.down = powers(len(raw) + 1)
            self.total = np.concatenate([[_U(0)], np.cumsum(BYTE_HASH[raw] * self.up[: len(raw)])])

    def hashes(self, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of the substrings of size characters from the start-th (from 0) of the lines at."""
        a, b = self.starts[self.first[at] + start], self.starts[self.first[at] + start + size]
        if self.total is not None:
            return mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64))
        out = []
        for i, j in zip(a.tolist(), b.tolist()):
            up, total, scale = powers(SLAB + 1)[0], _U(0), _U(1)
            for k in range(i, j, SLAB):
                part = self.raw[k : min(j, k + SLAB)]
                total += (BYTE_HASH[part] * up[: len(part)]).sum() * scale
                scale = scale * up[SLAB]
            out.append(total + _U(j - i))
        return mix(np.array(out, np.uint64))

    def letters(self) -> np.ndarray:
        """How many characters of each of 16 kinds each line has, modulo 16, in one long."""
        of = np.zeros((4, 256), np.uint64)  # counts of four kinds side by side, 16 bits for each
        for byte in range(256):
            of[byte % 16 // 4, byte] = 1 << (16 * (byte % 4))
        raw, ends = self.raw, self.ends
        last = np.append(raw[1:] & 0xC0 != 0x80, True)  # of the bytes of each character
        out = np.zeros(len(ends) - 1, np.uint64)
        for k in range(4):
            sums = np.add.reduceat(np.where(last, of[k][raw], _U(0)), ends[:-1])
            for j in range(4):
                out |= ((sums >> _U(16 * j)) & _U(15)) << _U(4 * (4 * k + j))
        for i in np.flatnonzero(np.diff(ends) > 0xFFFF):  # their counts could run over
            part = slice(ends[i], ends[i + 1])
            n = np.bincount(raw[part][last[part]] & 15, minlength=16) & 15
            out[i] = sum(int(x) << (4 * k) for k, x in enumerate(n))
        return out


def _keys(batches: Iterator[pa.RecordBatch], edits: int, remember: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (h1, line), the lines not empty: keys of each line's own segments, and of the substrings to look up, once for each line of the task.

    Segment i (from 0) of a line of length l has l div (edits + 1) characters, the last l % (edits + 1) ones one more.
    A key is a hash of length, segment and substring.
    """
    specs, parts = probes(edits), edits + 1
    seen: set[int] = set()

    def keyed(h1: np.ndarray, lines: _Lines) -> pa.RecordBatch:
        letters, n = lines.letters(), lines.length
        key, line, own = [], [], []
        for less, i, shift in specs:
            l = n - less
            extra = l % parts
            start = l // parts * i + np.maximum(0, i - parts + extra) + shift
            size = l // parts + (i >= parts - extra)
            at = np.flatnonzero((l >= parts) & (start >= 0) & (start + size <= n))
            if len(at):
                key.append(mix(lines.hashes(at, start[at], size[at]) + (l[at] * parts + i).astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
                line.append(at)
                own.append(np.full(len(at), less == shift == 0))
        at = np.concatenate(line)
        cols = [np.concatenate(key).view(np.int64), h1[at], np.concatenate(own), letters.view(np.int64)[at]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "h1", "own", "letters"])

    for batch in batches:
        h1 = batch.column(0).to_numpy()
        fresh = np.array([h not in seen and not seen.add(h) for h in h1.tolist()], bool)
        if len(seen) > remember:
            seen.clear()
        h1 = h1[fresh]
        if not len(h1):
            continue
        line = batch.column(1).filter(pa.array(fresh)).cast(pa.large_string())
        ends = np.frombuffer(line.buffers()[1], np.int64)[line.offset : line.offset + len(line) + 1]
        raw = np.frombuffer(line.buffers()[2], np.uint8)
        a = 0
        while a < len(h1):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLAB, "right")) - 1)
            yield keyed(h1[a:b], _Lines(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]))
            a = b


def _alike(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether the letter counts allow for `edits`: each changes two of them by one at most."""
    total = np.zeros(len(a), np.int64)
    for k in range(KINDS):
        d = ((a >> 4 * k) - (b >> 4 * k)) & 15
        total += np.minimum(d, 16 - d)
    return total <= 2 * edits


def _letter_groups(edits: int) -> list[int]:
    """Masks of groups of kinds, as many as lines within `edits` have equal counts in one of them at least."""
    n = 2 * edits + 1
    if n > KINDS:
        return [0]
    masks = [sum(15 << 4 * k for k in range(KINDS) if k % n == g) for g in range(n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _met(batches: Iterator[pa.RecordBatch], edits: int, group: int, slab: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (key, h1, own, letters) sorted by key, h1 and own last: pairs x, y of a line that owns a segment and another that looks it up.

    Keys met by one line only, nearly all, are passed over at once.  Of lines that share a segment but differ by whole words,
    as those of near copies do, few have letter counts that allow for so few edits; the others are left out here.
    A key that more than `group` lines have is hot: its rows are handed on as (hot: key, x: h1, y: letters, own) instead,
    as they come, so that no more than that is held.
    """

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, line, own, letters = rows
        own = own.astype(bool)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        several = size > 1
        # small groups together: each row against those 1, 2, ... places on
        for far in range(1, int(size[several].max()) if several.any() else 0):
            at = start[size > far]
            span = size[size > far] - far
            if len(at) < 50 and span.sum() > slab // 64:
                break
            i = np.repeat(at - np.cumsum(span) + span, span) + np.arange(span.sum())
            ok = own[i] | own[i + far]
            for k in range(0, len(i), slab):
                j = i[k : k + slab][ok[k : k + slab]]
                j = j[_alike(letters[j], letters[j + far], edits)]
                if len(j):
                    yield _pairs(line[j], line[j + far])
        else:
            return
        for a, n in zip(start[size > far], size[size > far]):  # what is left: few and large groups
            for d in range(far, n):
                j = np.arange(a, a + n - d)
                j = j[own[j] | own[j + d]]
                j = j[_alike(letters[j], letters[j + d], edits)]
                if len(j):
                    yield _pairs(line[j], line[j + d])

    def once(rows: np.ndarray) -> np.ndarray:
        """Of a line's rows with a key the last, which owns the segment if any does."""
        return rows[:, np.append((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]), True)] if rows.shape[1] else rows

    def given(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups."""
        rows = once(rows)
        start = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1])) if rows.shape[1] else np.zeros(0, np.int64)
        size = np.diff(np.append(start, rows.shape[1]))
        large = np.repeat(size > group, size)
        if large.any():
            yield _hot(rows[:, large])
        yield from pairs(rows[:, ~large])

    held, hot = np.zeros((4, 0), np.int64), None
    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], 1)
        if hot is not None:
            n = int(np.searchsorted(rows[0], hot, "right"))
            if n:
                yield _hot(once(rows[:, :n]))
            rows = rows[:, n:]
        if not rows.shape[1]:
            held = rows
            continue
        hot = None
        cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on
        yield from given(rows[:, :cut])
        held = once(rows[:, cut:])
        if held.shape[1] > group:
            hot = held[0, -1]
            yield _hot(held)
            held = held[:, :0]
    yield from given(held)


def _hot(rows: np.ndarray) -> pa.RecordBatch:
    key, line, own, letters = rows
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(line), pa.array(letters), pa.array(own.astype(bool))], names=["hot", "x", "y", "own"])


def _split(hot: DataFrame, edits: int, group: int) -> DataFrame:
    """Rows (key, h1, own, letters) of hot keys under keys that fewer lines have.  No pair within `edits` is parted.

    2 * edits + 1 groups of letter counts: of two such lines one at least is equal, so it joins the key.  What then is still
    hot is cut in parts of half of `group`, and every two parts meet under a key of their own.
    """
    masks = F.array(*map(F.lit, _letter_groups(edits)))
    rows = hot.select("hot", "x", "y", "own", F.explode(masks).alias("mask"))
    rows = rows.select(F.xxhash64("hot", "mask", F.col("y").bitwiseAND(F.col("mask"))).alias("sub"), "x", "y", "own")
    parts = rows.groupBy("sub").agg(F.ceil(F.count(F.lit(1)) * 2 / group).alias("parts"))
    rows = rows.join(parts.filter("parts > 2"), "sub", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("x", F.lit(3)), F.col("parts"))
    rows = rows.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    key = F.xxhash64("sub", F.least("part", "other"), F.greatest("part", "other"))
    return rows.select(key.alias("key"), F.col("x").alias("h1"), "own", F.col("y").alias("letters"))


def _in_order(keys: DataFrame) -> DataFrame:
    return keys.repartition("key").sortWithinPartitions("key", "h1", "own")


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    none = pa.nulls(pair.shape[1], pa.int64()), pa.nulls(pair.shape[1], pa.bool_())
    return pa.RecordBatch.from_arrays([none[0], pa.array(pair[0]), pa.array(pair[1]), none[1]], names=["hot", "x", "y", "own"])


def _verified(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y, a, b = (batch.column(i).to_pylist() for i in range(4))
        ok = [within(s, t, edits) for s, t in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))


def line_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, max_bits: int = bloom.MAX_BITS,
    exact_chars: int | None = None, group: int = GROUP,
) -> DataFrame:
    """As repeated_lines, with the row_key of the row that the line is in: a hash of its doc_id and text."""
    spark = docs.sparkSession
    ship(spark)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = text.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    long = F.col("len") >= max(min_chars, edits + 1)
    least = min_chars if exact_chars is None else exact_chars
    short = F.lit(False) if least >= max(min_chars, edits + 1) else (F.col("len") >= least) & F.col("line").rlike(r"\S")
    lines = lines.withColumn("len", F.length("line")).filter(long | short).withColumn("h1", F.xxhash64("line"))
    place = F.struct("doc_id", "row", "line_no")
    occ = keep(lines.select("doc_id", "row", "line_no", "h1", F.xxhash64(F.lit(1), "line").alias("h2")))
    distinct = keep(occ.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")))
    keys = lines.filter(long).select("h1", "line").mapInArrow(lambda it: _keys(it, edits), KEY)
    met = keep(_in_order(keys).mapInArrow(lambda it: _met(it, edits, group), MET))
    apart = _split(met.filter("hot is not null"), edits, group)
    more = _in_order(apart).mapInArrow(lambda it: _met(it, edits, 1 << 62), MET)
    pairs = keep(met.filter("hot is null").unionByName(more).select("x", "y").distinct())
    drop(met)
    ids = pairs.select(F.col("x").alias("h1")).unionByName(pairs.select(F.col("y").alias("h1"))).distinct()
    texts = keep(among(lines.filter(long).select("h1", "line"), ids, "h1", max_bits).groupBy("h1").agg(F.min("line").alias("line")))
    a, b = texts.withColumnsRenamed({"h1": "x", "line": "a"}), texts.withColumnsRenamed({"h1": "y", "line": "b"})
    near = pairs.join(a, "x").join(b, "y").select("x", "y", "a", "b").mapInArrow(lambda it: _verified(it, edits), "x long, y long")
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y")))
    first = distinct.groupBy("h1").agg(F.min("first").alias("first"))
    nearest = both.join(first.withColumnsRenamed({"h1": "y"}), "y").groupBy(F.col("x").alias("h1")).agg(F.min("first").alias("near"))
    limit = keep(
        distinct.join(nearest, "h1", "left").withColumn("limit", F.least("first", F.coalesce("near", "first")))
        .filter((F.col("c") > 1) | (F.col("limit") < F.col("first"))).select("h1", "h2", "limit")
    )
    # most lines repeat nothing: a filter spares them the shuffle; a very common line is one that Spark's join can split
    some = bloom.build(limit, "h1", limit.count(), 0.01, seed=7, max_bits=max_bits).might_contain(F.col("h1"))
    return occ.filter(some).join(limit, ["h1", "h2"]).filter(F.col("limit") < place).select(
        "doc_id", "line_no", F.col("limit.doc_id").alias("first_doc_id"), F.col("limit.line_no").alias("first_line_no"), F.col("row").alias("row_key")
    )


def repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """One row for each line that repeats an earlier one: doc_id, line_no, first_doc_id, first_line_no.

    Options: id_col, text_col, edits, min_chars, max_bits (of a filter), exact_chars, group (lines that one task holds at once).
    A line repeats an earlier one, by doc_id and then number (from 0), if the two are at most `edits` insertions,
    deletions and substitutions apart and have min_chars characters at least; first_* name the earliest such line.
    Shorter lines of exact_chars at least (min_chars, if it is None) that aren't blank repeat an earlier one if they equal it.
    So of each set of equal lines exactly the first stays.  Null texts have no lines; null doc_ids come first; rows
    of the same doc_id and different texts follow each other in an order of their own; rows repeated whole count
    as one; an empty table gives an empty result; other columns are ignored.

    Equal lines are brought together first, by two 64-bit hashes and without their text.  Distinct ones are split in
    edits + 1 segments; two lines within the threshold share one, so each looks up its substrings of fitting
    length and place among the segments.  A task makes a line's keys once.  Hashes alone are shuffled; keys that very many
    lines have are split by letter counts and dealt out in parts; the texts of candidates follow and are verified by banded
    bit-parallel edit distance.
    """
    return line_repeats(docs, **options).drop("row_key")


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def among(rows: DataFrame, ids: DataFrame, col: str, max_bits: int) -> DataFrame:
    """Rows whose rows[col] is among ids[col] (distinct).  A Bloom filter spares most others the shuffle."""
    ids = keep(ids)
    hit = bloom.build(ids, col, ids.count(), 0.01, seed=5, max_bits=max_bits).might_contain(F.col(col))
    return rows.filter(hit).join(ids, col, "left_semi")


def without_lines(docs: DataFrame, repeated: DataFrame, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """docs (doc_id, text, ...) without the lines that line_repeats has found; a document of which nothing but white space is left goes.

    A line goes from the row that it was found in, not from others of its doc_id.  Null texts, empty tables and columns of any
    name are left as they are; n_chars, if there, is counted anew.  Documents without such lines pass straight through: a
    Bloom filter of the others' keys decides which are shuffled.
    """
    key, gone, text, kinds = *unused(docs.columns, "key", "gone"), "text", dict(docs.dtypes)
    drops = keep(repeated.groupBy(F.col("row_key").alias(key)).agg(F.collect_set("line_no").alias(gone)))
    left = F.array_join(F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.when(~F.array_contains(gone, i), x)), lambda x: x.isNotNull()), "\n")
    hit = bloom.build(drops, key, drops.count(), 0.01, seed=6, max_bits=max_bits).might_contain(row_key(F.col("doc_id"), F.col(text)))
    # the same join at every size, so that what is shuffled grows with the input and not with a threshold
    rows = docs.filter(hit).withColumn(key, row_key(F.col("doc_id"), F.col(text))).join(drops.hint("merge"), key, "left")
    changed = {text: F.when(F.col(gone).isNull(), F.col(text)).otherwise(left)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(left).cast(kinds["n_chars"]))
    rows = rows.withColumns(changed).filter(F.col(gone).isNull() | F.col(text).rlike(r"\S"))
    return docs.filter(~hit).unionByName(rows.select(docs.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents"), exact_chars=1)
