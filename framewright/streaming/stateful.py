"""Ordered folds and lookups on streams: state in a store, timers by event time, and nothing of a key held whole."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..common import folded, ship, unused
from ..operators.control import Controller, Settings
from ..scratch import drop, folder, keep
from .ordered import Reorder

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILE_ROWS = 500_000  # of a file that is played


class StreamFold(Protocol):
    """A common.Fold that can be put away between micro-batches: state() is what JSON can hold, and load() takes it back."""

    def row(self, *values) -> list[tuple]: ...

    def end(self) -> list[tuple]: ...

    def state(self) -> object: ...

    def load(self, state: object) -> None: ...


class _Folding(StatefulProcessor):
    """Rows wait in buckets of event time until the watermark has passed these; a timer for each bucket then folds its rows in order.

    State of a key: its waiting buckets, its fold, and the last bucket folded.  A bucket's rows wait in parts, each written once as it comes; they
    are the most that is held at once.
    """

    def __init__(self, make: Callable[[object], StreamFold], names: Sequence[str], fields: str, n_order: int, out: Sequence[str], bucket_ms: int, idle_ms: int):
        self.make, self.names, self.fields, self.n_order, self.out, self.bucket_ms, self.idle_ms = make, names, fields, n_order, out, bucket_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long, part int", f"rows array<struct<{self.fields}>>")
        self.parts = handle.getMapState("parts", "bucket long", "n int")
        self.fold = handle.getValueState("fold", "state string, last long")

    def _end_of(self, bucket: int) -> int:
        return (bucket + 1) * self.bucket_ms

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        while part := list(itertools.islice(rows, 5000)):
            buckets: dict[int, list] = {}
            for r in part:
                buckets.setdefault(r["_ms"] // self.bucket_ms, []).append(tuple(r[n] for n in self.names))
            for b, own in buckets.items():
                n = self.parts.getValue((b,))[0] if self.parts.containsKey((b,)) else 0
                if not n:
                    self.handle.registerTimer(self._end_of(b))
                    self.handle.registerTimer(self._end_of(b) + self.idle_ms)
                self.waiting.updateValue((b, n), (own,))
                self.parts.updateValue((b,), (n + 1,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Timers come in order of time: a bucket's end folds it, and idle_ms later the key ends unless another bucket has ended since."""
        at = expiredTimerInfo.getExpiryTimeInMs()
        state, last = self.fold.get() if self.fold.exists() else (None, None)
        b = at // self.bucket_ms - 1
        folds = at == self._end_of(b) and self.parts.containsKey((b,))
        ends = not folds and last is not None and at == self._end_of(last) + self.idle_ms
        if not folds and not ends:
            return
        fold = self.make(key[0])
        if state is not None:
            fold.load(json.loads(state))
        out: list[tuple] = []
        if folds:
            rows = []
            for i in range(self.parts.getValue((b,))[0]):
                rows += [tuple(x) for x in self.waiting.getValue((b, i))[0]]
                self.waiting.removeKey((b, i))
            self.parts.removeKey((b,))
            for r in sorted(rows, key=lambda r: tuple((v is not None, v) for v in r[: self.n_order])):
                out += fold.row(*r[self.n_order :])
            self.fold.update((json.dumps(fold.state()), b))
        else:
            out = fold.end()
            self.fold.clear()
        row = Row(*self.out)
        yield from (row(*x) for x in out)

    def close(self) -> None:
        pass


def folded_stream(
    df: DataFrame, key: str, at: str, order: Sequence[str], columns: Sequence[str], make: Callable[[object], StreamFold], schema: str,
    bucket_ms: int = 60_000, idle_ms: int = 3_600_000,
) -> DataFrame:
    """common.folded on a stream.  df: with a watermark on the timestamp `at`, by which rows are put in order, and by `order` where it is equal within a millisecond or as
    `order` says inside a bucket: order must ascend with `at`.

    A row is folded once the watermark has passed its bucket of bucket_ms; what comes after that is late, and Spark drops it.  A key of which nothing has
    come for idle_ms ends: end() gives what the fold still holds, and its state goes.  So state is bounded by the keys that are alive, their waiting rows and their
    folds.  Needs the store that keeps state on disk, which this sets for the session.
    """
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    given = [f"v{i}" for i in range(len(order) + len(columns))]
    kinds = dict(df.dtypes)
    fields = ", ".join(f"{v}: {kinds[c]}" for v, c in zip(given, [*order, *columns]))
    # the watermark's column goes along, as late rows are told by it
    rows = df.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.expr(f"unix_millis(`{at}`)").alias("_ms"), *(F.col(c).alias(v) for v, c in zip(given, [*order, *columns])))
    to = StructType.fromDDL(schema)
    p = _Folding(make, given, fields, len(order), to.names, bucket_ms, idle_ms)
    return rows.groupBy("_key").transformWithState(p, to, "Append", "EventTime")


def reordered(df: DataFrame, key: str, at: str, arrival: str, position: str, depth: int, **how) -> DataFrame:
    """ordered.reorder_batch on a stream: key, position, emitted, flushed (it came out as its key had ended)."""
    kinds = dict(df.dtypes)
    return folded_stream(df, key, at, [arrival], [position], lambda k: Reorder(k, depth), f"`{key}` {kinds[key]}, `{position}` {kinds[position]}, emitted long, flushed boolean", **how)


class Decide:
    """A controller's session."""

    def __init__(self, key, ladder: int, start: int, settings: Settings):
        self.key, self.start, self.of = key, start, Controller(settings)
        self.of.resize(ladder)

    def row(self, at, x) -> list[tuple]:
        return [(self.key, at, *((self.of.cap, None, "hold") if x is None else self.of.observe(float(x), self.start)))]

    def end(self) -> list[tuple]:
        return []

    def state(self):
        c = self.of
        return [c.cap, c.low, c.high, c.speeds, c.before]

    def load(self, state) -> None:
        c = self.of
        c.cap, c.low, c.high, c.speeds, before = state
        c.before = before and tuple(before)


def decided(df: DataFrame, key: str, at: str, order: str, speed: str, ladder: int, start: int, settings: Settings = Settings(), **how) -> DataFrame:
    """control.decide on a stream: key, order, cap, mean_speed, reason.  Null speeds decide nothing."""
    kinds = dict(df.dtypes)
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, cap int, mean_speed double, reason string"
    return folded_stream(df, key, at, [order], [order, speed], lambda k: Decide(k, ladder, start, settings), schema, **how)


class First:
    """Which row of a content came first."""

    def __init__(self, key):
        self.key, self.first, self.seen = key, None, False

    def row(self, own) -> list[tuple]:
        if not self.seen:
            self.first, self.seen = own, True
        return [(own, self.first)]

    def end(self) -> list[tuple]:
        return []

    def state(self):
        return [self.first, self.seen]

    def load(self, state) -> None:
        self.first, self.seen = state


def cached(df: DataFrame, content: str, at: str, order: str, key: str, **how) -> DataFrame:
    """lookup.cached on a stream: key, made_for.  What a content was first seen as is kept until nothing of it has come for idle_ms; then it is made anew.

    Contents are keys by their SHA-256; state is a digest and a key each.
    """
    digest, = unused(df.columns, "digest")
    kind = dict(df.dtypes)[key]
    rows = df.withColumn(digest, F.sha2(F.col(content).cast("binary"), 256))
    return folded_stream(rows, digest, at, [order], [key], First, f"`{key}` {kind}, made_for {kind}", **how)


class Newest:
    """The newest generation so far."""

    def __init__(self, key):
        self.key, self.newest = key, None

    def row(self, own, generation) -> list[tuple]:
        if generation is None or self.newest is not None and generation < self.newest:
            return []
        self.newest = generation
        return [(self.key, own, generation)]

    def end(self) -> list[tuple]:
        return []

    def state(self):
        return self.newest

    def load(self, state) -> None:
        self.newest = state


def current(df: DataFrame, key: str, at: str, order: str, generation: str, **how) -> DataFrame:
    """Rows as they come, but for those of an older generation than the newest that their key has seen: key, order, generation."""
    kinds = dict(df.dtypes)
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{generation}` {kinds[generation]}"
    return folded_stream(df, key, at, [order], [order, generation], Newest, schema, **how)


class Held:
    """A queue of which at most `most` entries are being worked on; the others wait for one of these to be acknowledged."""

    def __init__(self, key, most: int):
        self.key, self.most, self.busy, self.waiting = key, most, 0, []

    def row(self, entry, acknowledges) -> list[tuple]:
        if acknowledges:
            self.busy = max(0, self.busy - 1)
        else:
            self.waiting.append(entry)
        out = []
        while self.waiting and self.busy < self.most:
            self.busy += 1
            first = self.waiting.pop(0)
            out.append((self.key, first, entry, self.busy))
        return out

    def end(self) -> list[tuple]:
        return [(self.key, x, None, self.busy) for x in self.waiting]

    def state(self):
        return [self.busy, self.waiting]

    def load(self, state) -> None:
        self.busy, self.waiting = state


def _held(df: DataFrame, key: str, entry: str) -> str:
    kinds = dict(df.dtypes)
    return f"`{key}` {kinds[key]}, `{entry}` {kinds[entry]}, released_at {kinds[entry]}, busy int"


def held_back(df: DataFrame, key: str, entry: str, acknowledges: str, most: int = 2) -> DataFrame:
    """df: key, entry (a number in order), acknowledges (whether the row is an acknowledgement, else an entry).  One row per entry.

    key, entry, released_at (the row that let it go: itself, or an acknowledgement, or null where none has come), and busy: how many were then being worked on, never
    more than `most`.  Entries go in order.  A task holds the entries that wait.
    """
    return folded(df, key, [entry], [entry, acknowledges], lambda k: Held(k, most), _held(df, key, entry))


def held_back_stream(df: DataFrame, key: str, at: str, entry: str, acknowledges: str, most: int = 2, **how) -> DataFrame:
    """held_back on a stream; entries that wait as their key ends come out then."""
    return folded_stream(df, key, at, [entry], [entry, acknowledges], lambda k: Held(k, most), _held(df, key, entry), **how)


def correlated(requests: DataFrame, responses: DataFrame, key: str, asked: str, answered: str, within: str) -> DataFrame:
    """lookup.correlate on two streams, each with a watermark on its timestamp (asked, answered): requests, the response's columns, pending.

    A response counts that comes no earlier than its request and no later than `within` after it, the first of a key.  Requests without one come out, as
    pending, when none can come any more; both sides' rows go from the state then.
    """
    one = responses.dropDuplicatesWithinWatermark([key])
    own, there = unused([*requests.columns, *responses.columns], "own", "there")
    right = one.withColumnRenamed(key, own).withColumn(there, F.lit(True))
    soon = (F.col(answered) >= F.col(asked)) & (F.col(answered) <= F.col(asked) + F.expr(f"interval {within}"))
    got = requests.join(right, (F.col(key) == F.col(own)) & soon, "left")
    return got.drop(own).withColumn("pending", F.col(there).isNull()).drop(there)


# -- tables as streams, and streams as tables


def played(df: DataFrame, at: str, batches: int, end: str = "2999-01-01", last: dict | None = None) -> DataFrame:
    """A table as a stream: its rows by ranges of the timestamp `at`, in `batches` micro-batches, and then one row with a time
    that is later than all of them, so that a watermark passes everything, and else nulls and the values in `last`: a key that can be null needs another one
    there.  The files are written to the shared folder, as many for each micro-batch, as a stream takes the same number of files each time; so where there are too
    few rows for one of them it is empty.  A file has about FILE_ROWS rows, or where times are equal up to `batches` times as many."""
    spark = df.sparkSession
    path = folder(spark)
    rows = keep(df)
    told = rows.select(F.percentile_approx(at, [k / batches for k in range(1, batches)], 10_000).alias("q"), F.count(F.lit(1)).alias("n")).first()
    files = max(1, math.ceil(told["n"] / batches / FILE_ROWS))
    edges = [None, *dict.fromkeys(told["q"] or []), None]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        own = f"{path}/{i:05d}"
        inside = (F.lit(True) if a is None else F.col(at) > F.lit(a)) & (F.lit(True) if b is None else F.col(at) <= F.lit(b))
        rows.filter(inside).repartition(files).write.parquet(own)
        for _ in range(files - len(spark.read.schema(df.schema).parquet(own).inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(own)
    drop(rows)
    values = {**(last or {}), at: end}
    row = [F.lit(values.get(c)).cast(t).alias(c) for c, t in df.dtypes]
    spark.range(1).select(*row).coalesce(1).write.parquet(f"{path}/{len(edges) - 1:05d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


def collected(stream: DataFrame, seconds: int = 600, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Runs a stream over all that is there, into a table in the shared folder, and reads that."""
    spark = stream.sparkSession
    path = path or folder(spark)
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint or folder(spark)).trigger(availableNow=True).start()
    if not q.awaitTermination(seconds):
        q.stop()
        raise TimeoutError(f"the stream took more than {seconds} seconds")
    return spark.read.schema(stream.schema).parquet(path)
