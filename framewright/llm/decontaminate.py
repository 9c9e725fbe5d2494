"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bloom
from .edits import best_ending, masks, within
from .shared import keep, ship, table, unused

RATE = 0.05  # edits to a character of an item
BLOCK_CHARS = 8_000_000  # of items matched in one pass over the documents
HIT = "doc_id long, item_id long, distance int, start long, length int, key long"


def normal(text: str) -> str:
    """Lower case, with one space for each run of white space and none at the ends."""
    return " ".join(text.lower().split())


class Matcher:
    """Finds items (id, normalised text) in texts, with at most rate * length edits each."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        import ahocorasick

        self.items = [(i, len(t), int(rate * len(t)), masks(t)) for i, t in items]
        self.texts = [t for _, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(items):
            k = self.items[n][2]
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.automaton.add_word(p, (len(p), where))
        if pieces:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start of the match, its length), one for each item that is found.

        k edits leave one of an item's k+1 pieces whole, so every match has an exact piece hit; the
        surroundings of the hits of an item, joined where they overlap, are searched for it.  Of an item's matches of the
        least distance the first to end is told, of several starts that with a length closest to the item's.
        """
        if not self.items:
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                _, m, k, _ = self.items[n]
                start = end + 1 - size - at
                spans.setdefault(n, []).append((max(0, start - k), min(len(text), start + m + k)))
        out = []
        for n, found in spans.items():
            item, m, k, peq = self.items[n]
            best = None
            for a, b in merged(found):
                if b - a >= m - k:
                    distance, end = best_ending(peq, m, text[a:b])
                    if distance <= k and (best is None or distance < best[0]):
                        best = (distance, a + end)
            if best:
                distance, end = best
                sizes = sorted(range(max(0, m - distance), min(end, m + distance) + 1), key=lambda x: (abs(x - m), x))
                own = next(x for x in sizes if within(self.texts[n], text[end - x : end], distance))  # noqa: B023
                out.append((item, distance, end - own, own))
        return sorted(out, key=_by_id)


def _by_id(row: tuple) -> tuple:
    return row[0] is not None, row[0] or 0, *row[1:]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, Callable[[int], list[tuple[int, str]]]]:
    """How many blocks of about block_chars the items take, and what fetches one: the items to look for, normalised."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / block_chars))

    def block(b: int) -> list[tuple[int, str]]:
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        return sorted(((r["item_id"], t) for r in own if (t := normal(r["text"]))), key=_by_id)

    return n, block


def _hits(rows: DataFrame, wanted: list[tuple[int, str]], rate: float) -> DataFrame:
    """rows: doc_id, key, text."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(wanted, rate)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = (c.to_pylist() for c in batch.slice(at, 500).columns)
                hits = [(i, *h, key) for i, key, t in zip(*part) if t for h in match(normal(t))]
                cols = list(zip(*hits)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in HIT.split(", ")])

    return rows.mapInArrow(search, HIT)


def _all_hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, rate: float, block_chars: int) -> DataFrame:
    ship(docs.sparkSession)
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text.alias("text"))
    n, block = item_blocks(benchmark, block_chars)
    if n == 1:
        return _hits(rows, block(0), rate)
    # a block is in the driver only until its pass is over
    return reduce(DataFrame.unionByName, [keep(_hits(rows, block(b), rate)) for b in range(n)])


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, distance, start, length.

    Both texts are lower-cased and their white space is made single spaces; an item is found where its edit distance
    to some part of the whole document is at most rate times its length.  start and length tell the part of the
    normalised document that has the least distance.  Null or empty texts contain nothing; null and blank items are not
    looked for, all others are, however short; items of equal text are all reported, one without id as null; repeated rows are searched each;
    empty tables are fine; other columns are ignored.

    The items are the query set: they go to the tasks in blocks of about block_chars, one pass over the documents for
    each, so a larger benchmark takes more passes and no more memory, in the driver or the tasks.
    """
    return _all_hits(docs, benchmark, id_col, text_col, rate, block_chars).drop("key")


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS, max_bits: int = bloom.MAX_BITS
) -> DataFrame:
    """The rows of docs (doc_id, text, ...), whole, in which find_benchmark finds nothing.

    Rows of null or empty text stay; an empty table gives an empty result; other columns may have any name.  With a benchmark of
    one block no row is shuffled; with more, those that a Bloom filter of the rows with a hit knows are.
    """
    ship(docs.sparkSession)
    n, block = item_blocks(benchmark, block_chars)
    if n > 1:
        own, of, whose = unused(docs.columns, "key", "found", "whose")
        found = keep(_all_hits(docs, benchmark, "doc_id", text_col, rate, block_chars).select(F.col("key").alias(of), F.col("doc_id").alias(whose)).distinct())
        rows = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.col(text_col).cast("string")))
        hit = bloom.build(found, of, found.count(), 0.01, seed=4, max_bits=max_bits).might_contain(F.col(own))
        # by doc_id too, as the hashes of two documents may be equal
        same = (F.col(own) == F.col(of)) & F.col("doc_id").cast("long").eqNullSafe(F.col(whose))
        return rows.filter(~hit).unionByName(rows.filter(hit).join(found, same, "left_anti")).select(docs.columns)
    wanted, at_text = block(0), docs.columns.index(text_col)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(wanted, rate)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part.filter(pa.array([not (t and match(normal(t))) for t in part.column(at_text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(search, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
