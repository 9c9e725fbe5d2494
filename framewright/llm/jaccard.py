"""N-gram Jaccard join by T-occurrence search (DivideSkip)."""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bloom
from .components import connected_components
from .shared import drop, keep, n_parts, ship, table, unused
from .shingles import WORDS, shingle_sets, signature

NUM, DEN = 80, 100  # two sets link when DEN * |both| >= NUM * |either|
BLOCK_BYTES = 8 << 20  # of input to each block in which shingles are counted
GROUP_BYTES = 4 << 20  # of sets that one task joins at once; its time may grow with the square of that, so larger groups are searched in parts
DENSE = 4096  # sets on the short lists of one search from which on they are counted
LONG = 0.01  # DivideSkip's mu: the larger, the fewer lists are probed instead of merged
_U = np.uint64


def overlap_needed(n):
    """What a set of n must share with any set it links with; also the least size of such a set."""
    return -(-NUM * n // DEN)


def _lead(n):
    return np.maximum(1, 3 * n // 10)


def _prefix(n):
    """Of a set's shingles in order of hash, so many are counted in the first pass.

    Of two sets that link, the first _prefix share _lead of the smaller set at least: what follows the prefix
    of a set of n has overlap_needed(n) - _lead(n) shingles, so at least _lead(n) common ones precede it.
    """
    return n - overlap_needed(n) + _lead(n)


def _chunk() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 24


def _deal(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the hashes by block, dealt by their lower half, and the bounds of the blocks in it."""
    block = ((hashes & _U(0xFFFFFFFF)) * _U(n_blocks) >> _U(32)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    return order, np.searchsorted(block[order], np.arange(n_blocks + 1))


def _upper(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(32)).astype(np.uint32)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(schema: str, cols: list) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, t in zip(cols, types)], names=list(names))


def _u(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(x, kind)


# What is dealt out: for block -1, the documents of a chunk (place: their keys, value: what else is
# known of them), and for other blocks, shingles (place: which document each is of, or in the second pass how many have
# it, value: 32 bits of each).
ALL = 0xFFFF  # stands for the documents of a chunk that have a shingle, if several do
DEALT = "chunk long, block int, place binary, value binary"


def _first(batches: Iterator[pa.RecordBatch], words: int, n_blocks: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    base, k, size = _chunk(), 0, 0
    keys: list[int] = []
    ids: list = []
    sizes: list[int] = []
    heads: list[np.ndarray] = []
    sigs: list[bytes] = []

    def flush() -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(heads)), [len(h) for h in heads]).astype(np.uint16)
        hashes = np.concatenate(heads)
        order = np.argsort(hashes, kind="stable")
        doc, hashes = doc[order], hashes[order]
        # what recurs within the chunk is counted here, and told once as everyone's
        begins = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
        several = ~begins | np.append(~begins[1:], False)[: len(hashes)]
        own = np.bincount(doc[several], minlength=len(heads)).astype(np.uint32)
        doc[several] = ALL
        doc, hashes = doc[begins], hashes[begins]
        order, at = _deal(hashes, n_blocks)
        doc, value = doc[order], _upper(hashes)[order]
        rows = [(base + k, b, doc[i:j].tobytes(), value[i:j].tobytes()) for b, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        known = [np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint8), np.array(sizes, np.int32), own]
        meta = (base + k, -1, np.array(keys, np.int64).tobytes(), b"".join(x.tobytes() for x in known) + b"".join(sigs))
        for x in (keys, ids, sizes, heads, sigs):
            x.clear()
        return _batch(DEALT, list(zip(meta, *rows)))

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            key, id_, text = (x.to_pylist() for x in batch.slice(at, 500).columns)
            keys += key
            ids += id_
            for s in shingle_sets([t.encode() if t else None for t in text], words):
                sizes.append(len(s))
                heads.append(s[: _prefix(len(s))].copy() if len(s) else s)
                sigs.append(signature(s))
                size += len(heads[-1])
            if size >= most or len(keys) > 60_000:
                yield flush()
                k, size = k + 1, 0
    if keys:
        yield flush()


def _recurring(t: pa.Table) -> pa.Table:
    """For a block's rows: which documents of each chunk have shingles that recur in other chunks, and how many."""
    chunk, places, values = (t.column(c).to_pylist() for c in ("chunk", "place", "value"))
    value = np.concatenate([_u(v, "<u4") for v in values])
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    again = np.zeros(len(value), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    rows, at = [], 0
    for c, p in zip(chunk, places):
        doc = _u(p, "<u2")
        doc, n = np.unique(doc[again[at : at + len(doc)] & (doc != ALL)], return_counts=True)
        at += len(p) // 2
        if len(doc):
            rows.append((c, 0, doc.tobytes(), n.astype(np.uint32).tobytes()))
    return pa.Table.from_batches([_batch(DEALT, list(zip(*rows)) or [[]] * 4)])


KNOWN = "doc_id long, key long, n long, sig binary, near boolean"


def _suspects(t: pa.Table) -> pa.Table:
    """The documents of a chunk; near: enough of the counted shingles recur for there to be a link."""
    block, places, values = (t.column(c).to_pylist() for c in ("block", "place", "value"))
    i = block.index(-1)
    key, v = _u(places[i], "<i8"), values[i]
    n = len(key)
    ids, null, size, sigs = _u(v[: 8 * n], "<i8"), _u(v[8 * n : 9 * n], "u1"), _u(v[9 * n : 13 * n], "<i4").astype(np.int64), v[17 * n :]
    found = _u(v[13 * n : 17 * n], "<u4").astype(np.int64)
    for b, p, c in zip(block, places, values):
        if b >= 0:
            found[_u(p, "<u2")] += _u(c, "<u4")
    near = (size > 0) & (found >= _lead(overlap_needed(size)))
    cols = [pa.array(ids, mask=null.astype(bool)), pa.array(key), pa.array(size), pa.array([sigs[16 * j : 16 * j + 16] for j in range(n)], pa.binary()), pa.array(near)]
    return pa.Table.from_arrays(cols, names=[x.split()[0] for x in KNOWN.split(", ")])


def _second(batches: Iterator[pa.RecordBatch], words: int, n_blocks: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The whole sets of suspects in chunks (block -1), and 32 bits of each of a chunk's distinct shingles by block."""
    base, k, size = _chunk(), 0, 0
    keys: list[int] = []
    sets: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        hashes = np.concatenate(sets)
        distinct, have = np.unique(hashes, return_counts=True)
        order, at = _deal(distinct, n_blocks)
        value, have = _upper(distinct)[order], have[order].astype(np.uint32)
        rows = [(base + k, b, have[i:j].tobytes(), value[i:j].tobytes()) for b, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        place = np.array(keys, np.int64).tobytes() + np.array([len(s) for s in sets], np.int32).tobytes()
        out = _batch(DEALT, list(zip((base + k, -1, place, hashes.tobytes()), *rows)))
        keys.clear(), sets.clear()
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            key, text = (x.to_pylist() for x in batch.slice(at, 500).columns)
            for x, s in zip(key, shingle_sets([t.encode() if t else None for t in text], words)):
                if len(s):
                    keys.append(x)
                    sets.append(s)
                    size += len(s)
            if size >= most:
                yield flush()
                k, size = k + 1, 0
    if keys:
        yield flush()


def _frequencies(t: pa.Table) -> pa.Table:
    """For each row of a block: how many suspects have each of its shingles (65535 stands for more, too)."""
    chunk, block, places, values = (t.column(c).to_pylist() for c in ("chunk", "block", "place", "value"))
    value, have = np.concatenate([_u(v, "<u4") for v in values]), np.concatenate([_u(p, "<u4") for p in places])
    _, where = np.unique(value, return_inverse=True)
    n = np.minimum(np.bincount(where, have), 65535).astype(np.uint16)[where]
    ends = np.cumsum([len(v) // 4 for v in values])
    rows = [(c, b, b"", n[e - len(v) // 4 : e].tobytes()) for c, b, v, e in zip(chunk, block, values, ends)]
    return pa.Table.from_batches([_batch(DEALT, list(zip(*rows)) or [[]] * 4)])


def _unpack(place: bytes, value: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(place) // 12
    return _u(place[: 8 * n], "<i8"), _u(place[8 * n :], "<i4").astype(np.int64), _u(value, "<u8")


POSTING = "shingle long, node long"


def _rarest(t: pa.Table, n_blocks: int) -> pa.Table:
    """Of each set the rarest shingles, so many that two sets that link have one in common; none that is alone."""
    rows = sorted(zip(t.column("block").to_pylist(), t.column("place").to_pylist(), t.column("value").to_pylist()))
    keys, sizes, hashes = _unpack(*rows[0][1:])
    distinct, where = np.unique(hashes, return_inverse=True)
    order, _ = _deal(distinct, n_blocks)
    df = np.empty(len(distinct), np.uint16)
    df[order] = np.concatenate([_u(v, "<u2") for b, _, v in rows if b >= 0])
    df = df[where]
    doc = np.repeat(np.arange(len(keys)), sizes)
    order = np.lexsort((hashes, df, doc))
    rank = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    take = order[(rank < (sizes - overlap_needed(sizes) + 1)[doc]) & (df[order] > 1)]
    return pa.Table.from_batches([_batch(POSTING, [hashes[take].view(np.int64), keys[doc[take]]])])


def merge_skip(lists: list[tuple[int, int]], values: list[int], need: int) -> Iterator[tuple[int, int]]:
    """What stands on `need` or more of some sorted lists, in order, and on how many.  lists: where in values each begins and ends.

    The lists' next values are in a heap.  If fewer than `need` lists have the least of them, need - 1 lists can be moved on
    to the least value of the others, as nothing before it is on enough lists.
    """
    heap = [(values[a], a, b) for a, b in lists if a < b]
    heapq.heapify(heap)
    while len(heap) >= need:
        least, taken = heap[0][0], []
        while heap and heap[0][0] == least:
            taken.append(heapq.heappop(heap))
        if len(taken) >= need:
            yield least, len(taken)
            after = least + 1
        else:
            while len(taken) < need - 1:
                taken.append(heapq.heappop(heap))
            after = heap[0][0]
        for _, a, b in taken:
            a = bisect.bisect_left(values, after, a, b)
            if a < b:
                heapq.heappush(heap, (values[a], a, b))


def scan_count(lists: np.ndarray, need: int) -> Iterator[tuple[int, int]]:
    """As merge_skip, of all the lists' values together, by counting them."""
    got = np.bincount(lists)
    for j in np.flatnonzero(got >= need).tolist():
        yield j, int(got[j])


def _links(i: int, low: int, need: int, own: np.ndarray, sizes, label, count, first, posting) -> Iterator[int]:
    """Sets of another label among low to i that link with set i (tokens own), by DivideSkip.  label may change meanwhile."""
    other = label[:i] != label[i]
    other[:low] = False
    shared = own[count[own] > 1]
    if len(shared) < need or not other.any():
        return
    n = count[shared]
    at = np.repeat(first[shared] - np.cumsum(n) + n, n) + np.arange(n.sum())
    there = (posting[at] < i) & other[np.minimum(posting[at], i - 1)]
    on = np.bincount(np.repeat(np.arange(len(shared)), n)[there], minlength=len(shared))
    lists, end = posting[at[there]], np.cumsum(on)
    by_length = np.argsort(on, kind="stable")
    by_length = by_length[on[by_length] > 0]
    if len(by_length) < need:
        return
    n_long = min(need - 1, int(need / (LONG * math.log2(on[by_length[-1]] + 1) + 1)), len(by_length) // 2)
    short, long = by_length[: len(by_length) - n_long], by_length[len(by_length) - n_long :]
    # the long lists one after another as one sorted array: place of the list, then set
    spots = np.concatenate([np.arange(end[t] - on[t], end[t]) for t in long]) if n_long else np.zeros(0, np.int64)
    probed = np.repeat(np.arange(n_long), on[long]) * i + lists[spots]
    if on[short].sum() > DENSE:
        found = scan_count(np.concatenate([lists[end[t] - on[t] : end[t]] for t in short]), need - n_long)
    else:
        found = merge_skip([(int(end[t] - on[t]), int(end[t])) for t in short], lists.tolist(), need - n_long)
    size = 1
    while some := list(itertools.islice(found, size)):
        maybe, total = (np.array(x, np.int64) for x in zip(*some))
        left = label[maybe] != label[i]
        maybe, total = maybe[left], total[left]
        if n_long and len(maybe):
            wanted = (np.arange(n_long)[:, None] * i + maybe[None, :]).ravel()
            hit = probed[np.minimum(np.searchsorted(probed, wanted), len(probed) - 1)] == wanted
            total = total + hit.reshape(n_long, -1).sum(0)
        yield from maybe[DEN * total >= NUM * (int(sizes[i]) + sizes[maybe] - total)].tolist()
        size = min(4 * size, 256)


def join_locally(sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Labels after merging those of any two sets that link.  label: integers, equal for sets known to be connected.

    Sets are taken in order of size and each is held against those before it.  Some sets of other labels are
    tried first; if any label is then left, a T-occurrence search finds the rest: the sets on the inverted
    lists of its shingles that have the overlap it needs.  DivideSkip sets the longest lists aside, merges the others by a
    heap, and looks up in the long ones, by binary search, only what has enough occurrences without them.  Sets that are known to be
    connected with it are left out of the lists first.  Short lists that together hold more than DENSE sets, as those of
    near copies do, are counted instead of merged, which gives the same at less cost.
    """
    sizes = np.array([len(s) for s in sets])
    by = np.argsort(sizes, kind="stable")
    sizes, label = sizes[by], label[by].copy()
    ends = np.cumsum(sizes)
    _, token = np.unique(np.concatenate([sets[i] for i in by]), return_inverse=True)
    count = np.bincount(token)
    posting = np.repeat(np.arange(len(by)), sizes)[np.argsort(token, kind="stable")]
    first = np.cumsum(count) - count
    mine = np.zeros(len(count), bool)

    def merge(a: int, b: int) -> None:
        label[label == label[b]] = label[a]

    for i in range(1, len(by)):
        r = int(sizes[i])
        need = overlap_needed(r)
        low = int(np.searchsorted(sizes, need))
        if not (label[low:i] != label[i]).any():
            continue
        own = token[ends[i] - r : ends[i]]
        mine[own] = True
        _, some = np.unique(label[low:i], return_index=True)
        for j in (low + some[:4]).tolist():
            if label[j] != label[i]:
                both = int(mine[token[ends[j] - sizes[j] : ends[j]]].sum())
                if DEN * both >= NUM * (r + int(sizes[j]) - both):
                    merge(i, j)
        for j in _links(i, low, need, own, sizes, label, count, first, posting):
            if label[j] != label[i]:
                merge(i, j)
        mine[own] = False
    out = np.empty_like(label)
    out[by] = label
    return out


EDGE = "a long, b long"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g1, g2, g3, node, label, set) that are sorted by g: edges that connect what links within a group."""
    group, nodes, labels, sets = None, [], [], []

    def done() -> pa.RecordBatch:
        node = np.array(nodes, np.int64)
        _, start = np.unique(np.array(labels, np.int64), return_inverse=True)
        after = join_locally(sets, start)
        _, first = np.unique(after, return_index=True)
        of = dict(zip(after[first].tolist(), node[first].tolist()))
        return _batch(EDGE, [node, np.array([of[x] for x in after.tolist()], np.int64)])

    for batch in batches:
        for *g, node, label, value in zip(*(x.to_pylist() for x in batch.columns)):
            if g != group:
                if len(nodes) > 1:
                    yield done()
                group, nodes, labels, sets = g, [], [], []
            nodes.append(node)
            labels.append(label)
            sets.append(_u(value, "<u8"))
    if len(nodes) > 1:
        yield done()


def _group_links(rows: DataFrame) -> DataFrame:
    """rows: g1, g2, g3, node, label, value."""
    parts = rows.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3")
    return keep(parts.select("g1", "g2", "g3", "node", "label", "value").mapInArrow(_solve, EDGE).filter("a <> b"))


def _link_large(rows: DataFrame, group_bytes: int) -> DataFrame:
    """rows: node, comp, bytes, value of components too large for one task.  Returns edges.

    Parts of a component are joined on their own, then one set of each result with one another.  That connects most
    of a group of near copies.  What is still not in its component's largest class is then held against all sets of the
    component, part by part; sets of the largest class need not be held against each other.
    """
    zero = F.lit(0).cast("long")
    parts = lambda total: F.greatest(F.ceil(total / F.lit(group_bytes)), F.lit(1)).cast("long")
    total = rows.groupBy("comp").agg(F.sum("bytes").alias("total"))
    rows = keep(rows.join(total, "comp").withColumn("part", F.pmod(F.xxhash64("node"), parts(F.col("total")))))
    first = _group_links(rows.select(F.col("comp").alias("g1"), F.col("part").alias("g2"), zero.alias("g3"), "node", F.col("node").alias("label"), "value"))
    lead = rows.join(first.select(F.col("a").alias("node")), "node", "left_anti")
    total = lead.groupBy("comp").agg(F.sum("bytes").alias("lead_total"))
    lead = lead.join(total, "comp").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), parts(F.col("lead_total"))))
    second = _group_links(lead.select(F.col("comp").alias("g1"), F.col("part").alias("g2"), zero.alias("g3"), "node", F.col("node").alias("label"), "value"))
    edges = first.unionByName(second)
    label = connected_components(edges)
    rows = keep(rows.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"))
    size = rows.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("c"))
    most = size.groupBy("comp").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    rows = rows.join(most, "comp")
    minor = rows.filter(F.col("label") != F.col("main"))
    total = minor.groupBy("comp").agg(F.sum("bytes").alias("minor_total"))
    minor = minor.join(total, "comp")
    n = parts(F.col("minor_total"))
    columns = ["node", "label", "value"]
    left = minor.withColumn("g2", F.pmod(F.xxhash64("node", F.lit(2)), n)).withColumn("g3", F.explode(F.sequence(zero, parts(F.col("total")) - 1)))
    right = rows.filter(F.col("label") == F.col("main")).join(total, "comp").withColumn("g2", F.explode(F.sequence(zero, n - 1))).withColumn("g3", F.col("part"))
    # minor sets also among themselves: every pair of their parts
    a = minor.withColumn("q", F.pmod(F.xxhash64("node", F.lit(2)), n)).withColumn("o", F.explode(F.sequence(zero, n - 1)))
    among = a.select(F.col("comp").alias("g1"), (-1 - F.least("q", "o")).alias("g2"), (-1 - F.greatest("q", "o")).alias("g3"), *columns)
    pairs = left.select(F.col("comp").alias("g1"), "g2", "g3", *columns).unionByName(right.select(F.col("comp").alias("g1"), "g2", "g3", *columns))
    return edges.unionByName(_group_links(pairs)).unionByName(_group_links(among))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
    block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES, max_bits: int = bloom.MAX_BITS,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, key.

    A text's set is its distinct shingles of `words` words, A-Z lower-cased; fewer words are one shingle, and
    null or empty texts have none and link with nothing.  Two texts link when their sets' Jaccard similarity is
    0.8 or more; component_id is the smallest doc_id that links reach.  No link is lost: each step leaves out only
    what its bound proves to have none.  Null doc_ids are no candidates for component_id unless a component has no
    other; repeated rows link with each other.  Other columns of docs are ignored; an empty table gives an empty result.
    Shingles are compared by 64-bit hashes, and key is a 64-bit hash of doc_id and text.

    1. Each set's first half, in order of hash, is dealt out by hash, packed into arrays, to count which shingles recur.
       A document of which too few recur can't link with any.  2. The sets of the rest, one of equal ones each, are
       dealt out whole to count how many of them have each shingle.  3. Sets that share one of their rarest shingles are joined
       into candidate groups.  4. Within a group a T-occurrence search finds the links.  Groups above group_bytes are
       searched in parts.  Nothing but counts of rows and a Bloom filter of bounded size reaches the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text")).select("key", "doc_id", "text")
    n_blocks = n_parts(rows, block_bytes)
    # of more blocks each chunk has less for one: larger chunks keep the arrays from thinning out
    most = min(max(1 << 21, 16 * n_blocks), 1 << 25)
    first = keep(rows.mapInArrow(lambda it: _first(it, words, n_blocks, most), DEALT))
    recurring = first.filter("block >= 0").groupBy("block").applyInArrow(_recurring, DEALT)
    known = keep(first.filter("block < 0").unionByName(recurring).groupBy("chunk").applyInArrow(_suspects, KNOWN))
    drop(first)
    groups = keep(known.filter("near").groupBy("sig").agg(F.min("key").alias("node"), F.min("doc_id").alias("lead")))
    # documents that pass by mistake are joined like others, so they cost time and change nothing
    suspects = rows.filter(bloom.build(groups, "node", groups.count(), 0.01, seed=9, max_bits=max_bits).might_contain(F.col("key")))
    second = keep(suspects.select("key", "text").mapInArrow(lambda it: _second(it, words, n_blocks), DEALT))
    frequencies = second.filter("block >= 0").groupBy("block").applyInArrow(_frequencies, DEALT)
    postings = keep(
        second.filter("block < 0").unionByName(frequencies).groupBy("chunk").applyInArrow(lambda t: _rarest(t, n_blocks), POSTING)
    )
    least = postings.groupBy("shingle").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    edges = postings.join(least, "shingle").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()
    comp = connected_components(edges)
    drop(postings)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, sizes, hashes = _unpack(place, value)
                ends = np.cumsum(sizes)
                yield _batch("node long, bytes long, value binary", [keys, sizes * 8, [hashes[e - s : e].tobytes() for s, e in zip(sizes, ends)]])

    sets = second.filter("block < 0").select("place", "value").mapInArrow(unpacked, "node long, bytes long, value binary")
    sets = sets.join(comp.withColumnRenamed("component", "comp"), "node")
    sizes = second.filter("block < 0").select("place", "value").mapInArrow(unpacked, "node long, bytes long, value binary").select("node", "bytes")
    large = keep(
        sizes.join(comp, "node").groupBy(F.col("component").alias("comp")).agg(F.sum("bytes").alias("b")).filter(F.col("b") > group_bytes).select("comp")
    )
    zero = F.lit(0).cast("long")
    some_large = not large.isEmpty()
    small = sets.join(large, "comp", "left_anti") if some_large else sets
    links = _group_links(small.select(F.col("comp").alias("g1"), zero.alias("g2"), zero.alias("g3"), "node", F.col("node").alias("label"), "value"))
    if some_large:
        links = links.unionByName(_link_large(keep(sets.join(large, "comp", "left_semi")), group_bytes))
    final = connected_components(links)
    classes = keep(groups.join(final, "node", "left").withColumn("class", F.coalesce("component", "node")).select("sig", "class", "lead"))
    least = classes.groupBy("class").agg(F.min("lead").alias("component_id"))
    of = classes.join(least, "class").select("sig", "component_id", F.lit(True).alias("near"))
    return known.join(of, ["sig", "near"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "key"
    )


def one_of_each(docs: DataFrame, max_bits: int = bloom.MAX_BITS, **options) -> DataFrame:
    """The rows of docs (doc_id, text, ...), whole, without those linked to one of a smaller doc_id.

    Of each component the document with the smallest doc_id stays (repeated rows of that id and text all do).
    Null and empty texts link with nothing and stay, as do rows of a null doc_id that are alone; an empty table gives an empty
    result; other columns may have any name.  Rows that a Bloom filter of the dropped ones doesn't know pass straight through; the
    rest is anti-joined.
    """
    found = jaccard_components(docs, max_bits=max_bits, **options)
    own, of, whose = unused(docs.columns, "key", "gone", "whose")
    gone = keep(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("key").alias(of), F.col("doc_id").alias(whose)).distinct())
    rows = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    hit = bloom.build(gone, of, gone.count(), 0.01, seed=8, max_bits=max_bits).might_contain(F.col(own))
    # by doc_id too, as the hashes of two documents may be equal
    same = (F.col(own) == F.col(of)) & F.col("doc_id").cast("long").eqNullSafe(F.col(whose))
    # the same join at every size, so that what is shuffled grows with the input and not with a threshold
    left = rows.filter(hit).join(gone.hint("merge"), same, "left_anti")
    return rows.filter(~hit).select(docs.columns).unionByName(left.select(docs.columns))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
