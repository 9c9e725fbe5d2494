"""Best-two-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import keep, ship, table

CAPACITY = 2048
END_ID = 0
SPECIAL = {"<|endoftext|>": 50256}  # the tokenizer file's added tokens
CELL = 1 << 20  # pieces of one length that are ranked in one task
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# What the tokenizer's pre-tokenisation takes for white space (Unicode's White_Space).
WHITE = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PART = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_BETWEEN = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


class Words(dict):
    """Token ids, as little-endian unsigned 32-bit bytes, of a run of white space and the run of other characters after it.

    Pre-tokenisation always ends a token where white space begins, so each such part is encoded once and
    looked up afterwards.  The memory is bounded: a full dictionary is emptied, parts of more than LONG characters or
    MANY ids are not remembered (so an entry takes some 350 bytes at most, in any script, and all 140 MB), and a long text is
    split into parts block by block.
    """

    LIMIT = 400_000
    LONG = 32
    MANY = 16
    BLOCK = 1 << 20  # characters

    def __init__(self, ranks_path: str, special: dict[str, int] = SPECIAL):
        """special: strings that are a token of their own wherever they stand, and their ids; the longest wins."""
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.cuts = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(part), "<u4").tobytes()
        if len(part) <= self.LONG and len(ids) <= 4 * self.MANY:
            if len(self) >= self.LIMIT:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not any(x in text for x in self.special):
            return self.plain(text)
        out, at = [], 0
        for m in self.cuts.finditer(text):
            out += [self.plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        out, at = [], 0
        while len(text) - at > self.BLOCK and (m := _BETWEEN.search(text, at + self.BLOCK)):
            out.append(b"".join(map(self.__getitem__, _PART.findall(text, at, m.start()))))
            at = m.start()
        return b"".join([*out, b"".join(map(self.__getitem__, _PART.findall(text, at)))])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: full ones, but for a first one that may be shorter."""
    starts = [0, *range(n % capacity or capacity, n, capacity)]
    return list(zip(starts, (b - a for a, b in zip(starts, [*starts[1:], n]))))


def pieces(batches: Iterator[pa.RecordBatch], ranks_path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """A row for each piece."""
    words, end = Words(ranks_path), np.array([END_ID], "<u4").tobytes()
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            out: list[tuple] = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = (words.encode(text) if text else b"") + end
                out += [(key, i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])) for i, (start, n) in enumerate(cut(len(ids) // 4, capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in PIECES.split(", ")])


def best_two_fit(counts: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Packs counts[n] pieces of each length n: a list of (contents, bins), contents a list of (length, pieces).

    A bin is filled greedily with the longest piece that fits, again and again.  Then its smallest piece
    gives way to two unpacked ones if these fill the room that it leaves more tightly.  Pieces of one length
    are alike, so a bin's contents are repeated while no length it used runs out: the work depends on
    the number of lengths, not of pieces.
    """
    left = list(counts)
    there = sum(1 << n for n, c in enumerate(left) if c and n)
    out = []

    def most(room: int, mask: int) -> int:
        return (mask & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 else 0

    while there:
        used: dict[int, int] = {}
        room, mask = capacity, there
        peak: dict[int, int] = {}

        def take(n: int) -> None:
            nonlocal room, mask
            used[n] = used.get(n, 0) + 1
            peak[n] = max(peak.get(n, 0), used[n])
            room -= n
            if used[n] == left[n]:
                mask &= ~(1 << n)

        while (n := most(room, mask)) > 0:
            take(n)
        if room and sum(used.values()) > 1:
            small = min(used)
            gap, best, pair = room + small, small, None
            a = most(gap, mask)
            while a > 0 and 2 * a > best:
                rest = mask & ~(1 << a) if left[a] - used.get(a, 0) < 2 else mask
                b = most(min(gap - a, a), rest)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == gap:
                        break
                a = most(a - 1, mask)
            if pair:
                used[small] -= 1
                room += small
                for n in pair:
                    take(n)
        contents = [(n, c) for n, c in sorted(used.items(), reverse=True) if c]
        # what ran out in this bin must have been there in each repeat, and must run out in the last alone
        times = max(1, min((left[n] - 1) // c for n, c in peak.items()))
        for n, c in contents:
            left[n] -= c * times
            if not left[n]:
                there &= ~(1 << n)
        out.append((contents, times))
    return out


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces in a sequence, offset) in order of rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first = 0
    for contents, times in plan:
        offset = 0
        for n, c in contents:
            out.setdefault(n, []).append((ranks.get(n, 0), first, c, offset))
            ranks[n] = ranks.get(n, 0) + c * times
            offset += c * n
        first += times
    return {n: np.array(x, np.int64) for n, x in out.items()}


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks_path: str | None = None,
    cell: int = CELL,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the token ids of its whole text and the end id; null and empty texts are the end id
    alone.  One with more ids than capacity is cut into pieces of that many, the first of which may be
    shorter.  Null and repeated doc_ids are rows like any other; an empty table gives an empty result; other columns
    are ignored.  Pieces of one length are interchangeable: the order in which they stand decides ties.

    Texts are read once; what is shuffled is one narrow row per piece.  The driver gets the number of
    pieces of each length (at most `capacity` rows) and packs those counts; the plan has a few rows for each length, however
    many pieces there are.  Every piece then finds its place by its length and its rank among pieces of that length.
    Ranks are given out cell by cell: pieces of one length are dealt to as many cells as keep them at about CELL each, the
    driver gets the cells' sizes (one number for each length and each million pieces), and a cell is numbered by the one
    task that has it, in an order that its rows alone decide, so that a task that runs again gives the same ranks.
    """
    import public_tokenizers

    spark = docs.sparkSession
    ship(spark)
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = keep(source.mapInArrow(lambda it: pieces(it, ranks_path, capacity), PIECES))
    counts = [0] * (capacity + 1)
    for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    place = slots(best_two_fit(counts, capacity))
    cells = F.element_at(F.array(*(F.lit(max(1, -(-c // cell))) for c in counts[1:])), F.col("length").cast("int"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), cells.cast("long")))
    size: dict[tuple[int, int], int] = {}
    for r in sorted(rows.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")).collect()):
        size[r["length"], r["cell"]] = r["n"]
    before, total = {}, {}
    for (n, c), own in size.items():
        before[n, c] = total.get(n, 0)
        total[n] = before[n, c] + own

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, given = None, 0
        for batch in batches:
            n, c = batch.column("length").to_numpy(), batch.column("cell").to_numpy()
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            edges = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (c[1:] != c[:-1]))) if len(n) else []
            for a, b in zip(edges, [*edges[1:], len(n)]):
                k = int(n[a]), int(c[a])
                at, given = k, given if k == at else 0
                rank = before[k] + given + np.arange(b - a)
                given += b - a
                t = place[k[0]]
                row = t[np.searchsorted(t[:, 0], rank, "right") - 1]
                i = rank - row[:, 0]
                seq[a:b], off[a:b] = row[:, 1] + i // row[:, 2], row[:, 3] + i % row[:, 2] * k[0]
            cols = [batch.column(i) for i in range(5)] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    dealt = rows.repartition("length", "cell").sortWithinPartitions("length", "cell", "doc_id", "piece", "ids_crc32", "start")
    return dealt.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
