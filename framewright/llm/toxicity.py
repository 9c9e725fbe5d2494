"""Toxicity by class-conditional Kneser-Ney models of byte n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytegrams import Values, blocks, counted, find, mask
from .language_id import held_out
from .shared import keep, n_parts, place, share, ship, table

N = 8  # bytes of the longest n-gram
DISCOUNT = 0.75
SMOOTH = 4.0  # bytes added to a word's length where its log-likelihoods are length-normalised
MAX_GRAMS = 600_000  # distinct n-grams of a model that is sent to the tasks: 14 MB at most; a larger one stays a table
PART_GRAMS = 100_000  # of those of a larger model to each part of it
CHUNK_BYTES = 32 << 20  # of documents that look up their n-grams in a larger model together
ASK_BYTES = 1 << 29  # of input whose chunks look up a part of the model in one task; each further one gets a copy of the model
LOW = 3  # shorter n-grams, and those of this length, are few enough to be sent to the tasks with a larger model too
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Grams:
    """Distinct n-grams of the labelled texts, in order, and how often each class has them."""

    gram: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray


class Model:
    """Log-likelihood ratio of a byte after those before it, toxic against ordinary.

    A class's probability is (count - D) / all after this context, plus what the discounts leave, shared
    out by how many different contexts a byte follows: Kneser-Ney's continuation counts.  The latter are counted
    over both classes together and are the same for both, so that an expression rare in either is judged by
    what all text has shown, and only what one class has really seen more often tells them apart.
    """

    def __init__(self, grams: Grams, n: int = N, discount: float = DISCOUNT, low: tuple[np.ndarray, np.ndarray] | None = None):
        """low: distinct n-grams of length min(LOW, n - 1) and their kinds, if grams is a part of all of them only."""
        self.n, self.d = n, discount
        self.top = []
        for c in (grams.toxic, grams.clean):
            g, c = grams.gram[c > 0], c[c > 0].astype(np.float64)
            ctx, at = np.unique(g >> np.uint64(8), return_inverse=True)
            self.top.append((g, c, ctx, np.bincount(at, c), np.bincount(at).astype(np.float64)))
        self.lower = []
        g = grams.gram
        for k in range(n - 1, 0, -1):
            g, kinds = low if low and k == min(LOW, n - 1) else np.unique(g & mask(k), return_counts=True)
            ctx, at = np.unique(g >> np.uint64(8), return_inverse=True)
            self.lower.append((k, g, kinds.astype(np.float64), ctx, np.bincount(at, kinds), np.bincount(at).astype(np.float64)))

    def shared(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), 1 / 256)
        for k, g, c, ctx, total, kinds in reversed(self.lower):
            p = self._level(grams & mask(k), g, c, ctx, total, kinds, p)
        return p

    def _level(self, at, g, c, ctx, total, kinds, p):
        here = at >> np.uint64(8)
        t = find(ctx, total, here)
        seen = np.maximum(t, 1)
        new = np.maximum(find(g, c, at) - self.d, 0) / seen + self.d * find(ctx, kinds, here) / seen * p
        return np.where(t > 0, new, p)

    def ratio(self, grams: np.ndarray) -> np.ndarray:
        p = self.shared(grams)
        a, b = (np.log(self._level(grams, *x, p)) for x in self.top)
        return (a - b)[:, None]


def in_words(raw: np.ndarray, grams: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams that look back no further than to the start of a word, and where words start.

    A word is its bytes and the white space after it, so that its end is told as well.
    """
    space = _SPACE[raw]
    begins = np.zeros(len(raw), bool)
    begins[1:] = space[:-1] & ~space[1:]
    begins[starts] = True
    at = np.flatnonzero(begins)
    place = np.arange(len(raw)) - np.repeat(at, np.diff(np.append(at, len(raw))))
    return grams & np.array([mask(k + 1) for k in range(n)])[np.minimum(place, n - 1)], at


FEATURES = 5


def features(values: Values, texts: list[bytes], n: int, smooth: float = SMOOTH) -> np.ndarray:
    """Of each text: its three largest word scores, the mean ratio of its words, and the logarithm of their number.

    A word's score is the log-likelihood ratio of its bytes over its length and `smooth`.
    """
    top, total, words = np.zeros((len(texts), 3)), np.zeros(len(texts)), np.zeros(len(texts))
    for raw, grams, starts, which in blocks(texts, n):
        grams, at = in_words(raw, grams, starts, n)
        ratio = np.add.reduceat(values[grams][:, 0], at, dtype=np.float64)
        score = ratio / (np.diff(np.append(at, len(raw))) + smooth)
        own = np.searchsorted(starts, at, "right") - 1
        first = np.searchsorted(own, np.arange(len(starts)))
        np.add.at(total, which, np.add.reduceat(ratio, first))
        np.add.at(words, which, np.diff(np.append(first, len(at))))
        for _ in range(3):
            best = np.maximum.reduceat(score, first)
            for k, x in zip(which, best):
                if x > top[k, 2]:
                    top[k] = np.sort(np.append(top[k, :2] if x > top[k, 2] else top[k], x))[::-1][:3]
            hit = first + _first_at(score, best, first)
            score[hit] = -np.inf
    return np.column_stack([top, total / np.maximum(words, 1), np.log1p(words)])


def _first_at(score: np.ndarray, best: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each segment, where in it the best score is first met."""
    hit = np.flatnonzero(score == np.repeat(best, np.diff(np.append(first, len(score)))))
    seg = np.searchsorted(first, hit, "right") - 1
    _, k = np.unique(seg, return_index=True)
    return hit[k] - first[seg[k]]


def lowered(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode() for t in texts]


def _count(batches: Iterator[pa.RecordBatch], n: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams and how often each class has them, summed up within a task as far as memory allows."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        g = np.concatenate([x for x, _ in parts] or [np.zeros(0, np.uint64)])
        g, at = np.unique(g, return_inverse=True)
        return g, np.bincount(at, np.concatenate([c for _, c in parts] or [np.zeros(0)]), len(g)).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for label in (0, 1):
            g, c = merged(held[label])
            held[label] = []
            for at in range(0, len(g), 100_000):
                x, y = g[at : at + 100_000].view(np.int64), c[at : at + 100_000]
                cols = [x, y if label else 0 * y, 0 * y if label else y]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols], names=["gram", "toxic", "clean"])

    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            text, toxic = (x.to_pylist() for x in batch.slice(at, 200).columns)
            for label in (0, 1):
                own = lowered([t for t, x in zip(text, toxic) if x == label])
                held[label].append(counted([in_words(*b[:3], n)[0] for b in blocks(own, n)]))
            if sum(len(g) for x in held for g, _ in x) >= most:
                held = [[merged(x)] for x in held]
                if sum(len(x[0][0]) for x in held) >= most // 2:
                    yield from out()
    yield from out()


def count_grams(rows: DataFrame, n: int) -> DataFrame:
    """rows: text, toxic (0 or 1).  Every distinct n-gram of them, and how often each class has it: gram, toxic, clean."""
    return keep(
        rows.mapInArrow(lambda it: _count(it, n), "gram long, toxic long, clean long")
        .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def _in_order(got: pa.Table) -> list[np.ndarray]:
    """Columns sorted by the first, n-grams."""
    gram, *counts = (c.to_numpy() for c in got.columns)
    by = np.argsort(gram.view(np.uint64))
    return [gram.view(np.uint64)[by], *(c[by] for c in counts)]


@dataclass
class Logit:
    """Logistic regression on the features, fitted by Newton's method."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> Logit:
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + penalty * np.eye(len(w))
            w -= np.clip(np.linalg.solve(curve, z.T @ (p - y) / len(y) + penalty * w), -5, 5)
        return cls(w, mean, scale)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def _scored(part: pa.Table | pa.RecordBatch, values: Values, n: int, extra: str, finish=None) -> list[pa.RecordBatch]:
    """part: doc_id, text and another column.  doc_id, that column, and features, or the score that finish makes of them."""
    x = features(values, lowered(part.column(1).to_pylist()), n)
    cols = list(x.T) if finish is None else [finish(x)]
    names = _names(finish)
    got = pa.table([part.column(0), part.column(2), *(pa.array(c, pa.float64()) for c in cols)], names=["doc_id", extra, *names])
    return got.to_batches()


def _names(finish) -> list[str]:
    return [f"f{i}" for i in range(FEATURES)] if finish is None else ["score"]


def _schema(rows: DataFrame, finish) -> str:
    extra = rows.columns[2]
    return f"doc_id long, {extra} {dict(rows.dtypes)[extra]}, " + ", ".join(f"{x} double" for x in _names(finish))


def _features_of(rows: DataFrame, grams: Grams, n: int, finish=None) -> DataFrame:
    """rows: doc_id, text and another column.  Features, or the score that finish makes of them."""
    extra = rows.columns[2]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = None
        for batch in batches:
            values = values or Values(Model(grams, n).ratio, 1, bits=21)
            for at in range(0, batch.num_rows, 500):
                yield from _scored(batch.slice(at, 500), values, n, extra, finish)

    return rows.mapInArrow(of, _schema(rows, finish))


# -- models that are too large to be sent to the tasks


def _deal(grams: np.ndarray, n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the n-grams by part, and the bounds of the parts in it.

    The last LOW bytes of what is before its last byte tell an n-gram's part.  So all that its probability
    needs of n-grams longer than LOW is in the same part.
    """
    part = ((grams >> np.uint64(8) & mask(min(LOW, n - 1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


def _pack(x: np.ndarray) -> bytes:
    """Compressed, first bytes first."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(packed[8:], n * size, "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(size, n).T.copy().view(kind)[:, 0]


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * len(kinds)
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), cols)})


def _parted(batches: Iterator[pa.RecordBatch], n: int, parts: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Counted n-grams by part."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        gram, toxic, clean = _in_order(pa.Table.from_batches(held))
        order, at = _deal(gram, n, parts)
        cols = gram[order], toxic[order], clean[order]
        rows = [(p, *(_pack(c[i:j]) for c in cols)) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        held.clear()
        yield from _table(rows, part=pa.int32(), gram=pa.binary(), toxic=pa.binary(), clean=pa.binary()).to_batches()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield from out()
    if held:
        yield from out()


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in compressed chunks.  A chunk's number is a hash of it, so that what is looked up for it can't go to another."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_table(pa.Table.from_batches(held).combine_chunks())
        held.clear()
        rows = sink.getvalue().to_pybytes()
        chunk = int.from_bytes(hashlib.blake2b(rows, digest_size=8).digest(), "little", signed=True)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([rows], pa.binary())], names=["chunk", "rows"])

    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            held.append(batch.slice(at, 500))
            size += held[-1].nbytes
            if size >= most:
                yield out()
                size = 0
    if held:
        yield out()


def _distinct(texts: list[bytes], n: int, most: int = 1 << 22) -> np.ndarray:
    held = [np.zeros(0, np.uint64)]
    for b in blocks(texts, n):
        held.append(np.unique(in_words(*b[:3], n)[0]))
        if sum(map(len, held[1:])) >= most:
            held = [np.unique(np.concatenate(held))]
    return np.unique(np.concatenate(held))


def _features_far(rows: DataFrame, counts: DataFrame, n: int, parts: int, finish=None, chunk_bytes: int = CHUNK_BYTES, groups: int = 1) -> DataFrame:
    """As _features_of, with a model that stays a table.

    Documents are put together in chunks.  A chunk's distinct n-grams go to the parts of the model that know of them; their
    values come back to the chunk, whose documents are then scored as by a model at hand.  Chunks are dealt to so many
    groups, each of which has the model for itself, so what one task looks up doesn't grow with the input.
    """
    extra, order = rows.columns[2], min(LOW, n - 1)
    low = None
    if order:
        last = lambda k: F.col("gram").bitwiseAND(F.lit(int(mask(k))))
        kinds = counts.select(last(order + 1).alias("gram")).distinct().groupBy(last(order).alias("gram")).agg(F.count(F.lit(1)).alias("kinds"))
        low = tuple(_in_order(kinds.toArrow()))
    chunks = rows.mapInArrow(lambda it: _chunks(it, chunk_bytes), "chunk long, rows binary")

    def texts_of(packed: bytes) -> pa.Table:
        return pa.ipc.open_stream(packed).read_all()

    def asked(t: pa.Table) -> pa.Table:
        grams = _distinct(lowered(texts_of(t.column("rows")[0].as_py()).column(1).to_pylist()), n)
        by, at = _deal(grams, n, parts)
        grams = grams[by]
        out = [(t.column("chunk")[0].as_py(), p, _pack(np.diff(grams[i:j], prepend=np.uint64(0)))) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        return _table(out, chunk=pa.int64(), part=pa.int32(), gram=pa.binary())

    def valued(ask: pa.Table, known: pa.Table) -> pa.Table:
        cols = [np.concatenate([np.zeros(0, k), *(_unpack(x, k) for x in known.column(c).to_pylist())]) for c, k in (("gram", "<u8"), ("toxic", "<i8"), ("clean", "<i8"))]
        by = np.argsort(cols[0])
        values = Values(Model(Grams(*(c[by] for c in cols)), n, low=low).ratio, 1, bits=20)
        out = [
            (c, p, _pack(values[np.cumsum(_unpack(g, "<u8"), dtype=np.uint64)][:, 0]))
            for c, p, g in zip(*(ask.column(x).to_pylist() for x in ("chunk", "part", "gram")))
        ]
        return _table(out, chunk=pa.int64(), part=pa.int32(), value=pa.binary())

    def scored(t: pa.Table, got: pa.Table) -> pa.Table:
        docs = [texts_of(x) for x in t.column("rows").to_pylist()]
        grams = _distinct(lowered(docs[0].column(1).to_pylist()), n)
        by, _ = _deal(grams, n, parts)
        value = np.empty(len(grams), np.float32)
        value[by] = np.concatenate([np.zeros(0, np.float32), *(_unpack(v, "<f4") for _, v in sorted(zip(*(got.column(x).to_pylist() for x in ("part", "value")))))])
        values = Values(lambda g: value[np.searchsorted(grams, g)][:, None], 1, bits=21)
        return pa.Table.from_batches([b for d in docs for at in range(0, len(d), 500) for b in _scored(d.slice(at, 500), values, n, extra, finish)])

    model = counts.mapInArrow(lambda it: _parted(it, n, parts), "part int, gram binary, toxic binary, clean binary")
    ask = chunks.groupBy("chunk").applyInArrow(asked, "chunk long, part int, gram binary")
    ask = ask.withColumn("to", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    model = model.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    values = ask.groupBy("part", "to").cogroup(model.groupBy("part", "to")).applyInArrow(valued, "chunk long, part int, value binary")
    return chunks.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(scored, _schema(rows, finish))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 5, fold: int = 0, n: int = N, max_grams: int = MAX_GRAMS, calibrate_rows: int = 6000, broadcast_rows: int = 2_000_000,
    ask_bytes: int = ASK_BYTES,
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Learns from labels of rows whose crc32(doc_id as text) mod folds is not fold.  Four fifths of those rows are counted,
    all of them, for the two models; of the last fifth, calibrate_rows at most turn their features into a
    probability.  If that fifth has no row of one class, the counted rows take its place; if there is one class
    only, the score is 1 or 0 accordingly, and 0 without any label.  Null and empty texts have features of 0 and are scored
    like others; null doc_ids are scored, not learned from; of several labels of a doc_id the largest counts and
    null ones don't.  Repeated rows count each; an empty table gives an empty result; other columns are ignored.

    The models have every n-gram of the counted rows.  They are sent to the tasks if these are max_grams at most, and stay a table in
    which the documents look up theirs beyond.  Labels are sent to the tasks if there are broadcast_rows of them at most, and joined by a shuffle of the labelled rows beyond.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = held_out(F.col("doc_id"), folds, fold)
    marks = keep(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic is not null")
        .filter(~out).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    few = marks.count() <= broadcast_rows
    known = rows.join(F.broadcast(marks) if few else marks, "doc_id").select("doc_id", "text", "toxic")
    last = F.expr(f"crc32(cast(doc_id as string)) div {folds} % 5 = 0")
    have = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(have) < 2:
        score = F.lit(1.0 if have.get(1) else 0.0)
        return rows.select("doc_id", out.alias("held_out"), score.alias("score"), score.cast("int").alias("predicted"))
    counts = count_grams(known.filter(~last).select("text", "toxic"), n)
    size = counts.count()
    if size <= max_grams:
        grams = Grams(*_in_order(counts.toArrow()))
        features_of: Callable[..., DataFrame] = lambda rows, finish=None: _features_of(rows, grams, n, finish)
    else:
        groups = n_parts(rows, ask_bytes, least=1)
        features_of = lambda rows, finish=None: _features_far(rows, counts, n, -(-size // PART_GRAMS), finish, groups=groups)
    drawn_by = place("doc_id", "kn")
    classes = lambda df: {r["toxic"]: (r["n"], r["least"]) for r in df.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.min(drawn_by).alias("least")).collect()}
    held = classes(marks.filter(last))
    usable, of = (known.filter(last), held) if len(held) == 2 else (known, classes(marks))
    # a hash of 63 bits; of each class the row of the smallest hash is drawn at least
    most = max(share(calibrate_rows, sum(n for n, _ in of.values())), *(least for _, least in of.values()))
    drawn = usable.filter(drawn_by <= most)
    got = features_of(drawn).toArrow()
    x = np.column_stack([got.column(f"f{i}").to_numpy() for i in range(FEATURES)])
    if not len(x):  # labels, but none of a document in docs
        return rows.select("doc_id", out.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    finish = Logit.fit(x, got.column("toxic").to_numpy().astype(np.float64))
    scored = features_of(rows.withColumn("held_out", out), finish)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
