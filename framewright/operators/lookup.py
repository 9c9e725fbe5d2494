"""Resolving records against others: as of a position, by membership, by rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import unused, with_groups


def as_of(facts: DataFrame, versions: DataFrame, keys: Sequence[str], order: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Each fact with the columns `take` of the latest version of its keys at a strictly smaller order.

    Both sides are sorted once by key and order in a union; a window carries the last version forward.
    """
    cols = [*keys, *order]
    rest = [c for c in facts.columns if c not in cols]
    side, fact, version = unused(cols, "side", "fact", "version")
    a = facts.select(*cols, F.lit(1).alias(side), F.struct(*rest).alias(fact), F.lit(None).alias(version))
    b = versions.select(*cols, F.lit(0).alias(side), F.lit(None).alias(fact), F.struct(*take).alias(version))
    # at equal positions facts come first, so that they don't see those versions
    w = Window.partitionBy(*keys).orderBy(*order, F.desc(side)).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(version, F.last(version, ignorenulls=True).over(w))
    return both.filter(F.col(side) == 1).select(*cols, *[F.col(fact)[c].alias(c) for c in rest], *[F.col(version)[c].alias(f"asof_{c}") for c in take])


def mark_members(df: DataFrame, members: DataFrame, keys: Sequence[str], name: str = "member") -> DataFrame:
    """Whether each row's keys are among those of members."""
    there, = unused([*df.columns, name], "in")
    own = members.select(*keys).distinct().withColumn(there, F.lit(True))
    return df.join(own, list(keys), "left").withColumn(name, F.col(there).isNotNull()).drop(there)


def zip_by_rank(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """The i-th row on the left with the i-th on the right, within each key, and that number as rank.

    Both sides go through one shuffle, by the keys: ranks and pairs are then found where the rows are.
    """
    cols = [[c for c in x.columns if c not in keys] for x in (left, right)]
    side, l, r, rank = unused([*keys, *cols[0], *cols[1]], "side", "left", "right", "rank_")
    orders = [[f"{rank}{i}_{k}" for k in range(len(o))] for i, o in enumerate((left_order, right_order))]

    def tagged(df: DataFrame, i: int) -> DataFrame:
        own = [c.alias(n) for c, n in zip((left_order, right_order)[i], orders[i])]
        other = [F.lit(None).alias(n) for n in orders[1 - i]]
        both = [F.struct(*cols[i]).alias((l, r)[i]), F.lit(None).alias((l, r)[1 - i])]
        return df.select(*keys, F.lit(i).alias(side), *both, *own, *other)

    rows = tagged(left, 0).unionByName(tagged(right, 1)).repartition(*keys)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, side).orderBy(*orders[0], *orders[1])))
    pairs = rows.groupBy(*keys, "rank").agg(F.first(l, ignorenulls=True).alias(l), F.first(r, ignorenulls=True).alias(r))
    pairs = pairs.filter(F.col(l).isNotNull() & F.col(r).isNotNull())
    return pairs.select(*keys, "rank", *[F.col(l)[c].alias(c) for c in cols[0]], *[F.col(r)[c].alias(c) for c in cols[1]])


def inherit(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key.  min_by over a struct, so rows are combined before the shuffle."""
    return _edge_per_key(df, key, F.min_by, order)


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, as a store has it in which later rows overwrite earlier ones."""
    return _edge_per_key(df, key, F.max_by, order)


def _edge_per_key(df: DataFrame, key: Sequence[str], pick, order: Sequence[str]) -> DataFrame:
    own, = unused(df.columns, "row")
    rest = [c for c in df.columns if c not in key]
    best = pick(F.struct(*rest), F.struct(*order)).alias(own)
    return df.groupBy(*key).agg(best).select(*key, *[F.col(own)[c].alias(c) for c in rest]).select(df.columns)


def resolve(
    slices: DataFrame, pps: DataFrame, sps: DataFrame, scope: str, order: Sequence[str], take_pps: Sequence[str], take_sps: Sequence[str], join: Callable = as_of
) -> DataFrame:
    """Each slice (scope, order, pps_id) with what it refers to at its place in the stream.

    The picture parameter set of its pps_id (pps: scope, order, pps_id, sps_id) that was written last before it, and of that one's
    sps_id the sequence parameter set (sps: scope, order, sps_id) written last before the slice: two as-of joins, by scans.as_of where a scope may
    be large.
    """
    one = join(slices, pps, [scope, "pps_id"], order, ["sps_id", *take_pps])
    two = one.withColumnRenamed("asof_sps_id", "sps_id").withColumnsRenamed({f"asof_{c}": f"pps_{c}" for c in take_pps})
    return join(two, sps, [scope, "sps_id"], order, take_sps).withColumnsRenamed({f"asof_{c}": f"sps_{c}" for c in take_sps})


def accepted(pps: DataFrame, sps: DataFrame, scope: str, order: Sequence[str]) -> DataFrame:
    """Those of pps whose sequence parameter set had been written before them; others are rejected when they are read."""
    seen, = unused(sps.columns, "seen")
    return as_of(pps, sps.withColumn(seen, F.lit(True)), [scope, "sps_id"], order, [seen]).filter(F.col(f"asof_{seen}")).drop(f"asof_{seen}")


def picture_by_poc(wanted: DataFrame, held: DataFrame, stream: str, bits: int | None = None, short_term: bool = False) -> DataFrame:
    """wanted: stream, poc, and others; held: stream, poc, picture (its place), reference and current, both boolean, and short.  Adds picture.

    The picture held for reference, but for the current one, of that count, or of those lowest bits of it; a short-term one only
    if short_term is given; of several the first.
    """
    poc = lambda c: F.pmod(c, F.lit(1 << bits)) if bits else c
    there = held.filter(F.col("reference") & ~F.col("current"))
    there = there.filter("short") if short_term else there
    own, = unused([*wanted.columns, *held.columns], "count")
    there = there.groupBy(stream, poc(F.col("poc")).alias(own)).agg(F.min("picture").alias("picture"))
    return wanted.withColumn(own, poc(F.col("poc"))).join(there, [stream, own], "left").drop(own)


def correlate(requests: DataFrame, responses: DataFrame, key: Sequence[str]) -> DataFrame:
    """Requests with their responses; `pending` where there is none yet.  Responses to no request are left out, of several the first counts."""
    rest = [c for c in responses.columns if c not in key]
    one = first_per_key(responses, key, rest)
    there, = unused([*requests.columns, *responses.columns], "there")
    got = requests.join(one.withColumn(there, F.lit(True)), list(key), "left")
    return got.withColumn("pending", F.col(there).isNull()).drop(there)


def headers_of(blocks: DataFrame, headers: DataFrame, keys: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Each block with the columns `take` of the header of its slice.  Spark broadcasts the headers if they are few."""
    return blocks.join(headers.select(*keys, *take), list(keys), "left")


def temporal_motion(blocks: DataFrame, motion: DataFrame, picture: Sequence[str], width: int, height: int, log2_ctb: int) -> DataFrame:
    """blocks: picture, x, y, w, h; motion: picture, x, y on a grid of 16, and vector, of the collocated picture.  Adds vector.

    It is that of the sample right below the block's corner, if that is inside the picture and in the same row of coding tree
    blocks, or else that of the block's centre; both are looked up on the grid.
    """
    grid = lambda c: F.floor(c / 16).cast("long") * 16
    gx, gy, far, near = unused([*blocks.columns, *motion.columns], "gx", "gy", "far", "near")
    at = motion.select(*picture, F.col("x").cast("long").alias(gx), F.col("y").cast("long").alias(gy), "vector")
    x, y = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    inside = (x < width) & (y < height) & (F.floor(F.col("y") / (1 << log2_ctb)) == F.floor(y / (1 << log2_ctb)))
    one = blocks.withColumn(gx, F.when(inside, grid(x))).withColumn(gy, F.when(inside, grid(y)))
    one = one.join(at.withColumnRenamed("vector", far), [*picture, gx, gy], "left")
    one = one.withColumn(gx, grid(F.col("x") + F.col("w") / 2)).withColumn(gy, grid(F.col("y") + F.col("h") / 2))
    two = one.join(at.withColumnRenamed("vector", near), [*picture, gx, gy], "left")
    return two.select(*blocks.columns, F.coalesce(far, near).alias("vector"))


def cached(df: DataFrame, content: str, order: Sequence[str], key: str) -> DataFrame:
    """Adds made_for: the key of the first row of the same content, whose result stands for all of them.

    Contents are compared by SHA-256, so they are not shuffled.  Null content is one content.
    """
    digest, = unused(df.columns, "digest")
    rows = df.withColumn(digest, F.sha2(F.col(content).cast("binary"), 256))
    first = rows.groupBy(digest).agg(F.min_by(key, F.struct(*order)).alias("made_for"))
    return with_groups(rows, first, [digest], ["made_for"]).drop(digest)
