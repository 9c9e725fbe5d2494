"""Which earlier pictures a picture may use: sets, lists, marking, and scan orders of a picture's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import folded, unused
from ..functions.buffer import PictureBuffer
from .scans import sequence_number


def reference_list(before: Column, after: Column, long_term: Column, size: Column, entries: Column | None = None) -> Column:
    """The list of `size` pictures: the sets one after another, repeated until long enough; `entries` (from 0) pick others."""
    pool = F.concat(before, after, long_term)
    n = F.size(pool)
    at = lambda i: F.try_element_at(pool, (i % n + 1).cast("int"))
    plain = F.transform(F.sequence(F.lit(0), size - 1), at)
    if entries is not None:
        plain = F.when(entries.isNull(), plain).otherwise(F.transform(entries, at))
    return F.when((n == 0) | (size < 1), F.expr("cast(array() as array<bigint>)")).otherwise(plain)


def no_backward(current: Column, *lists: Column) -> Column:
    """Whether no picture of the lists comes after the current one."""
    return ~F.exists(F.concat(*lists), lambda p: p > current)


def collocated(first: Column, second: Column, side: Column, index: Column) -> Column:
    """The picture of list `side` (0 or 1) at an index from 0; null where there is none."""
    at = (index + 1).cast("int")
    return F.when(index < 0, None).when(side == 0, F.try_element_at(first, at)).otherwise(F.try_element_at(second, at))


def derive_sets(pictures: DataFrame, stream: str = "stream", order: str = "decode_idx") -> DataFrame:
    """pictures: stream, order, poc, deltas (array of struct(delta, used)), resets, and perhaps long_term (array of struct(poc, span,
    used): a count, or its value modulo span).  Adds before, after and follow: the POCs of earlier pictures, still held, that this one may
    use or must keep; long_use and long_keep: the same by long_term; missing: those it names that aren't held.

    What a picture doesn't name is let go.  An ordered fold; a task holds few POCs at a time.  A picture that resets starts anew, so a stream is dealt by the runs
    that such pictures begin, however long it is.
    """
    schema = f"`{stream}` {dict(pictures.dtypes)[stream]}, `{order}` long, poc long, before array<long>, after array<long>, follow array<long>, missing array<long>, long_use array<long>, long_keep array<long>"

    class Sets:
        def __init__(self, k):
            self.stream, self.held = k["stream"], set()

        def row(self, at, poc, deltas, resets, long_term):
            if resets:
                self.held = set()
            named = [] if resets else [(poc + d["delta"], d["used"]) for d in deltas or []]
            there = [(p, used) for p, used in named if p in self.held]
            before = sorted((p for p, u in there if u and p < poc), reverse=True)
            after = sorted(p for p, u in there if u and p > poc)
            missing, far = [p for p, _ in named if p not in self.held], []
            for x in (long_term or []) if not resets else []:
                fits = sorted(p for p in self.held if (p % x["span"] if x["span"] else p) == x["poc"])
                far += [(fits[0], x["used"])] if fits else []
                missing += [] if fits else [x["poc"]]
            out = (self.stream, at, poc, before, after, [p for p, u in there if not u], missing, [p for p, u in far if u], [p for p, u in far if not u])
            self.held = {p for p, _ in there} | {p for p, _ in far} | {poc}
            return [out]

        def end(self):
            return []

    far = F.col("long_term") if "long_term" in pictures.columns else F.expr("cast(null as array<struct<poc:long,span:long,used:boolean>>)")
    run, = unused(pictures.columns, "run")
    pictures = sequence_number(pictures, [stream], [order], F.col("resets"), run)
    rows = pictures.select(F.struct(F.col(stream).alias("stream"), F.col(run).alias("run")).alias("at"), F.col(order).cast("long").alias(order), F.col("poc").cast("long").alias("poc"), "deltas", "resets", far.alias("long_term"))
    return folded(rows, "at", [order], [order, "poc", "deltas", "resets", "long_term"], Sets, schema)


def tile_scan(blocks: DataFrame, picture: list[str], columns: Column, rows: Column) -> DataFrame:
    """blocks: picture, x, y; columns and rows: arrays of where tiles start.  Adds tile and scan, the place in tile order."""
    nth = lambda starts, v: F.size(F.filter(starts, lambda s: s <= v)) - 1
    got = blocks.withColumn("tile", nth(rows, F.col("y")) * F.size(columns) + nth(columns, F.col("x")))
    w = Window.partitionBy(*picture).orderBy("tile", "y", "x")
    return got.withColumn("scan", F.row_number().over(w) - 1)


def starts(sizes: Column) -> Column:
    """Where parts of these sizes start: running sums from 0."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(sizes, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]


def uniform_sizes(total: Column, parts: Column) -> Column:
    """Sizes of parts as even as whole numbers allow: part i ends at (i + 1) * total div parts."""
    end = lambda i: F.floor((i * total) / parts)
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: (end(i + 1) - end(i)).cast("long"))


def bumped(pictures: DataFrame, stream: str, order: str, rank: list[str]) -> DataFrame:
    """Output order: by sequence and then count, numbered within a stream."""
    return pictures.withColumn("shown", F.row_number().over(Window.partitionBy(stream).orderBy(*rank)) - 1)


def neighbours(cells: DataFrame, picture: list[str], value: str) -> DataFrame:
    """The value of the cell to the left of each and of that above it; an equi-join on shifted places."""
    at = cells.select(*picture, "gx", "gy", value)
    left = at.select(*picture, (F.col("gx") + 1).alias("gx"), "gy", F.col(value).alias("left"))
    above = at.select(*picture, "gx", (F.col("gy") + 1).alias("gy"), F.col(value).alias("above"))
    return at.join(left, [*picture, "gx", "gy"], "left").join(above, [*picture, "gx", "gy"], "left")


def output_order(pictures: DataFrame, max_reorder: int, max_size: int, stream: str = "stream", order: str = "decode_idx") -> DataFrame:
    """pictures: stream, order, poc, deltas, resets, as for derive_sets.  One row per picture: stream, sequence, poc, shown_after
    (the order of the picture whose arrival let it out, null at the end of the stream) and shown, its running number.

    An ordered fold with a picture buffer for state, so a task holds max_size pictures' marks at most.
    """
    schema = f"`{stream}` {dict(pictures.dtypes)[stream]}, sequence int, poc long, shown_after long, shown long"

    class Output:
        def __init__(self, k):
            self.stream, self.buffer, self.n = k, PictureBuffer(max_reorder, max_size), 0

        def out(self, found, after):
            self.n += len(found)
            return [(self.stream, s, p, after, self.n - len(found) + i) for i, (s, p) in enumerate(found)]

        def row(self, at, poc, deltas, resets):
            return self.out(self.buffer.add(poc, {poc + d["delta"] for d in deltas or []}, bool(resets)), at)

        def end(self):
            return self.out(self.buffer.flush(), None)

    rows = pictures.select(stream, F.col(order).cast("long").alias(order), F.col("poc").cast("long").alias("poc"), "deltas", "resets")
    return folded(rows, stream, [order], [order, "poc", "deltas", "resets"], Output, schema)
