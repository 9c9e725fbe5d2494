"""Alignment of the tokens that two tokenizers make of the same texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .packing import Words
from .shared import keep, ship, table

HEAVY = 1 << 18  # pairs whose counts are sent to the tasks, at most
BLOCK = 1 << 20  # characters that are aligned at once, or one text that has more
A_IDS = 50256  # of byte_bpe_50k.tiktoken
LINKS = ("ends", "overlaps", "groups")


class Tokens:
    """Both tokenizers, the bytes of their tokens, and what a digest writes for them."""

    def __init__(self, ranks_path: str, model_path: str):
        import sentencepiece

        self.ranks = own = Words(ranks_path, {}).encoding
        self.a = [own.decode_single_token_bytes(i) for i in range(own.max_token_value + 1)]
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.b = [self._bytes(i) for i in range(self.model.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a, self.b))
        self.a_text, self.b_text = (np.array([b"%d%c" % (i, c) for c in ends for i in range(len(t))], object) for t, ends in ((self.a, b",|"), (self.b, b",;")))

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: Sequence[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A of space and text and by B of the text; none for null and empty texts and those that either's bytes don't give back."""
        there = [i for i, x in enumerate(texts) if x]
        a, b = ([np.zeros(0, np.int64)] * len(texts) for _ in range(2))
        for i, ids in zip(there, self.model.encode([texts[i] for i in there], num_threads=1) if there else []):
            text = " " + texts[i]
            whole, first = text.encode(), self.ranks.encode_ordinary(text)
            if b"".join(map(self.b.__getitem__, ids)) == whole == b"".join(map(self.a.__getitem__, first)):
                a[i], b[i] = np.array(first, np.int64), np.array(ids, np.int64)
        return a, b


def union1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.union1d of two ascending arrays: merged, which a stable sort does with runs, instead of hashed and sorted."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.append(True, both[1:] != both[:-1])] if len(both) else both


@dataclass
class Alignment:
    """Tokens of some documents, one after another, by where they end in the documents' bytes.

    The distinct ends of both sides cut the bytes into elementary intervals.  Each lies within one token of either side, found by
    binary search, and is one overlap.  Where both tokens end with it, it closes a group.
    """

    ends_a: np.ndarray
    ends_b: np.ndarray

    @cached_property
    def intervals(self) -> np.ndarray:
        return union1d(self.ends_a, self.ends_b)

    @cached_property
    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """The token of A and the token of B that own each interval."""
        return np.searchsorted(self.ends_a, self.intervals), np.searchsorted(self.ends_b, self.intervals)

    @cached_property
    def closing(self) -> np.ndarray:
        """Of each interval, whether it closes a group."""
        a, b = self.overlaps
        return (self.ends_a[a] == self.intervals) & (self.ends_b[b] == self.intervals)

    @cached_property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The last token of A and of B in each group: those that end together."""
        a, b = self.overlaps
        return a[self.closing], b[self.closing]

    @cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of each group: its tokens of A times its tokens of B."""
        (first_a, n_a), (first_b, n_b) = self.spans
        pairs = n_a * n_b
        g = np.repeat(np.arange(len(pairs)), pairs)
        i = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        return first_a[g] + i // n_b[g], first_b[g] + i % n_b[g]

    @cached_property
    def spans(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """First token and number of tokens of each group, of A and of B."""
        return tuple((np.append(0, last[:-1] + 1)[: len(last)], np.diff(last, prepend=-1)) for last in self.ends)

    def written(self, tokens: Tokens, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The tokens as bytes in the order a digest has them: of each group those of A, a bar, those of B, a semicolon."""
        (first_a, n_a), (first_b, n_b) = self.spans
        last_a, last_b = (np.zeros(len(x), bool) for x in (a, b))
        last_a[self.ends[0]] = last_b[self.ends[1]] = True
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.repeat(first_b, n_a)] = tokens.a_text[a + last_a * len(tokens.a)]
        out[np.arange(len(b)) + np.repeat(first_a + n_a, n_b)] = tokens.b_text[b + last_b * len(tokens.b)]
        return out


def _blocks(batch: pa.RecordBatch, size: int = BLOCK) -> Iterator[tuple[list, list, list]]:
    ids, keys, texts, held = [], [], [], 0
    rows = (row for at in range(0, batch.num_rows, 500) for row in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)))
    for rid, key, text in rows:
        ids.append(rid)
        keys.append(key)
        texts.append(text)
        held += len(text or "")
        if held >= size or len(ids) >= 1000:
            yield ids, keys, texts
            ids, keys, texts, held = [], [], [], 0
    if ids:
        yield ids, keys, texts


def _aligned(batches: Iterator[pa.RecordBatch], ranks_path: str, model_path: str, links: str, detail: bool) -> Iterator[pa.RecordBatch]:
    tokens = Tokens(ranks_path, model_path)
    longs = pa.list_(pa.int64())
    for batch in batches:
        for rids, keys, texts in _blocks(batch):
            by_a, by_b = tokens.encode(texts)
            a, b = np.concatenate(by_a), np.concatenate(by_b)
            n_a, n_b = (np.array([len(x) for x in t]) for t in (by_a, by_b))
            to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
            of = Alignment(np.cumsum(tokens.a_size[a]), np.cumsum(tokens.b_size[b]))
            # a document's last tokens end together, so that no group and no link is in two documents
            group_doc = np.searchsorted(to_a, of.ends[0], "right")
            n_groups = np.bincount(group_doc, minlength=len(rids))
            la, lb = getattr(of, links)
            link_doc = np.searchsorted(to_a, la, "right")
            n_links = np.bincount(link_doc, minlength=len(rids))
            width, span = len(tokens.a), len(tokens.a) * len(tokens.b)
            found, times = np.unique(link_doc * span + b[lb] * width + a[la], return_counts=True)
            cuts = np.append(0, np.cumsum(np.bincount(found // span, minlength=len(rids))))
            text = of.written(tokens, a, b)
            digests = ["" if not m else hashlib.sha256(b"".join(text[end - m : end].tolist())[:-1]).hexdigest() for m, end in zip(n_a + n_b, to_a + to_b)]
            columns = [
                pa.array(rids, pa.int64()), pa.array(keys, pa.int64()), *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links)), pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found % span)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(times.astype(np.int64))),
            ]
            if detail:
                per = np.append(0, np.cumsum(n_groups))
                columns += [pa.array([x.tolist() for x in t], longs) for t in (by_a, by_b)]
                columns += [pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array(n.astype(np.int64))) for _, n in of.spans]
            yield pa.RecordBatch.from_arrays(columns, names=_names(detail))


_ROW = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_DETAIL = ", a_ids array<long>, b_ids array<long>, a_sizes array<long>, b_sizes array<long>"


def _names(detail: bool) -> list[str]:
    return [x.split()[0] for x in (_ROW + _DETAIL * detail).split(", ")]


def aligned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, model_path: str | None = None,
    links: str = "ends", detail: bool = True,
) -> DataFrame:
    """One row per row of docs: its tokens by A (byte-level ranks, of a space and the text) and by B (pieces, of the text), aligned by bytes.

    doc_id; n_a, n_b, n_groups, n_links; groups_sha256; pairs and times: the id pairs (B's id times the number of A's, plus A's id) that
    links hold and how often; rid, a number of the row's own.  With detail also a_ids, b_ids and, group by group, how many of each a group has (a_sizes, b_sizes).
    links: `ends` for tokens that end together, `overlaps` for those that share bytes, `groups` for all pairs inside a group.

    Null and empty texts, and those that either tokenizer's bytes don't give back, have no tokens: zeros, no pairs and an empty digest.  Null and
    repeated doc_ids are rows like any other; other columns are ignored; an empty table gives an empty result.  Texts are aligned in
    blocks of a million characters, or one by one where they have more: a task holds a block's tokens at most.
    """
    import public_tokenizers

    if links not in LINKS:
        raise ValueError(f"links must be one of {', '.join(LINKS)}")
    ship(docs.sparkSession)
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    model_path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lambda it: _aligned(it, ranks_path, model_path, links, detail), _ROW + _DETAIL * detail)


def scored(rows: DataFrame, width: int, heavy: int = HEAVY) -> DataFrame:
    """rows: a kept table of aligned().  Adds n_best and count_sum, by the counts of id pairs over all rows; width: the number of A's ids.

    A pair with 1 / heavy of all links or more is heavy; there are `heavy` such pairs at most.  Their counts are sent to the
    tasks, as arrays of 17 bytes a pair, and looked up there.  Links of all other pairs are shuffled to the table of counts:
    none of these pairs has more than 1 / heavy of them, so no key is hot.
    """
    spark = rows.sparkSession
    counts = rows.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy("pairs").agg(F.sum("times").alias("n"))
    # a B id has at most as many pairs as A has ids
    of_b = Window.partitionBy(F.expr(f"pairs div {width}L"))
    best = keep(counts.select("pairs", "n", (F.col("n") == F.max("n").over(of_b)).alias("best")))
    total = best.agg(F.sum("n")).first()[0] or 0
    is_heavy = F.col("n") * heavy >= total
    known = best.filter(is_heavy).toArrow()
    order = np.argsort(known["pairs"].to_numpy())
    shipped = spark.sparkContext.broadcast(tuple(known[c].to_numpy()[order] for c in ("pairs", "n", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, top = shipped.value
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                lists = part.column("pairs")
                own, times = lists.flatten().to_numpy(), part.column("times").flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                sums, bests = (np.zeros(part.num_rows, np.int64) for _ in range(2))
                np.add.at(sums, row[hit], n[at[hit]] * times[hit])
                np.add.at(bests, row[hit], top[at[hit]] * times[hit])
                cuts = np.append(0, np.cumsum(np.bincount(row[~hit], minlength=part.num_rows)))
                rest = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[~hit])) for x in (own, times)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(7)), pa.array(bests), pa.array(sums), *rest], names=[*part.schema.names[:7], "n_best", "count_sum", "pairs", "times"])

    head = [x for x in _ROW.split(", ")[:7]]
    found = keep(rows.select(*_names(False)).mapInArrow(look_up, ", ".join([*head, "n_best long", "count_sum long", "pairs array<long>", "times array<long>"])))
    light = found.select("rid", F.inline(F.arrays_zip("pairs", "times"))).join(best.filter(~is_heavy), "pairs")
    light = light.groupBy("rid").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("tops"))
    none = F.lit(0).cast("long")
    return found.join(light, "rid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("tops", none)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", none)).alias("count_sum"), "groups_sha256",
    )


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep(aligned(table(spark, sf_dir, "documents"), detail=False))
    return scored(rows, A_IDS)
