"""Lookups, unit and picture operators on the tables of the test data; their SQL is in media_sql."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, media
from ..operators import blocks, control, ladder, lookup, quality, references, sessions
from ..sources import annexb
from ..streaming import ordered
from .queries import _t, _variants

ORDER = ["ts", "event_id"]


def _events(spark, d, *more):
    return _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value", *more)


def unit_kinds(spark, d):
    p = _t(spark, d, "part").select("p_partkey", media.unit_kind(F.col("p_partkey") % 64).alias("k"))
    return p.select("p_partkey", "k.*")


def unit_routing(spark, d):
    return annexb.routed(_t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 64).alias("type"))).select("p_partkey", "route")


def depth_reduction(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    sample = F.greatest(F.lit(0), F.least(F.lit(1023), F.floor((F.col("x").cast("double") + 1) * 512))).cast("int")
    return v.select("vec_id", "i", media.reduce_depth(sample, F.lit(10)).alias("sample"))


def crop_windows(spark, d):
    k = F.col("p_partkey")
    c = media.crop_window(F.col("p_size") * 16, F.col("p_size") * 8, k % 4, k % 3, k % 2, k % 5, F.lit(1))
    return _t(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.*")


def rgb(spark, d):
    k = F.col("p_partkey")
    c = media.to_rgb(F.col("p_size") / 50, k % 256 / 255, k % 100 / 99)
    p = _t(spark, d, "part").select("p_partkey", c.alias("c"))
    return p.select("p_partkey", *[F.round(F.col(f"c.{x}"), 6).alias(x) for x in "rgb"])


def log_filter(spark, d):
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").when(F.col("event_type") == "view", "debug").otherwise("info")
    return _t(spark, d, "events").select("event_id", level.alias("level")).filter(media.told(F.col("level"), "info"))


def bounded_fetch(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", media.fetched(F.col("embedding"), (F.col("vec_id") % 200 - 20).cast("int")).alias("f"))
    return v.select("vec_id", F.round(F.col("f.value").cast("double"), 6).alias("value"), "f.error")


def parameter_upsert(spark, d):
    return lookup.last_per_key(_events(spark, d), ["user_id", "event_type"], ORDER).select("user_id", "event_type", "event_id", "value")


def _sets(spark, d):
    e = _events(spark, d)
    pps = e.filter("event_type = 'click'").select("user_id", *ORDER, (F.col("event_id") % 3).alias("pps_id"), (F.col("event_id") % 2).alias("sps_id"))
    sps = e.filter("event_type = 'view'").select("user_id", *ORDER, (F.col("event_id") % 2).alias("sps_id"), "value")
    return e, pps, sps


def parameter_sets_accepted(spark, d):
    _, pps, sps = _sets(spark, d)
    return lookup.accepted(pps, sps, "user_id", ORDER).select("user_id", "event_id", "pps_id", "sps_id")


def slice_resolution(spark, d):
    e, pps, sps = _sets(spark, d)
    slices = e.filter("event_type = 'purchase'").select("user_id", *ORDER, (F.col("event_id") % 3).alias("pps_id"))
    return lookup.resolve(slices, pps, sps, "user_id", ORDER, [], ["value"]).select("user_id", "event_id", "pps_id", "sps_id", "sps_value")


def _held(spark, d):
    e = _t(spark, d, "events").select("user_id", (F.col("event_id") % 37).alias("poc"), F.col("event_id").alias("picture"), "event_type")
    kind = F.col("event_type")
    return e, e.select("user_id", "poc", "picture", (kind != "error").alias("reference"), (kind == "signup").alias("current"), (kind == "view").alias("short"))


def reference_by_poc(spark, d):
    e, held = _held(spark, d)
    wanted = e.filter("event_type = 'purchase'").select("user_id", F.col("picture").alias("for_picture"), ((F.col("picture") + 5) % 37).alias("poc"))
    any_kind = lookup.picture_by_poc(wanted, held, "user_id")
    short = lookup.picture_by_poc(wanted.select("user_id", "for_picture", "poc"), held, "user_id", short_term=True)
    return any_kind.join(short.select("user_id", "for_picture", F.col("picture").alias("short_picture")), ["user_id", "for_picture"])


def reference_by_low_bits(spark, d):
    e, held = _held(spark, d)
    wanted = e.filter("event_type = 'purchase'").select("user_id", F.col("picture").alias("for_picture"), (F.col("picture") % 101).alias("poc"))
    return lookup.picture_by_poc(wanted, held, "user_id", bits=3)


def correlated(spark, d):
    e = _t(spark, d, "events").select(F.expr("event_id div 2").alias("id"), "event_id", "event_type")
    requests = e.filter("event_id % 2 = 0").select("id", F.col("event_id").alias("request"))
    responses = e.filter("event_id % 2 = 1 and event_type <> 'error'").select("id", F.col("event_id").alias("response"))
    return lookup.correlate(requests, responses, ["id"])


def slice_headers(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    heads = _t(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_custkey")
    return lookup.headers_of(li, heads, ["l_orderkey"], ["o_orderstatus", "o_custkey"])


def temporal_vectors(spark, d):
    k = F.col("p_partkey")
    place = {"picture": F.floor(k / 64), "x": k % 8 * 16, "y": F.floor(k % 64 / 8) * 16}
    p = _t(spark, d, "part").select(*[c.cast("long").alias(n) for n, c in place.items()], "p_partkey", "p_size")
    motion = p.filter("p_size % 3 > 0").select("picture", "x", "y", F.col("p_size").alias("vector"))
    at = p.select("p_partkey", "picture", "x", "y", F.lit(16).alias("w"), F.when(F.col("p_size") % 2 == 0, 16).otherwise(32).alias("h"))
    return lookup.temporal_motion(at, motion, ["picture"], 128, 128, 5).select("p_partkey", "vector")


def init_cache(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("content"))
    return lookup.cached(p, "content", ["p_partkey"], "p_partkey").select("p_partkey", "made_for")


def any_flag(spark, d):
    return quality.any_of(_t(spark, d, "lineitem").select("l_orderkey", "l_discount"), ["l_orderkey"], F.col("l_discount") > 0.085, "offset")


def digests(spark, d):
    return quality.digest(_events(spark, d), "user_id", ORDER, "event_type")


def reconciled(spark, d):
    a = _t(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    b = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return quality.reconcile(a, b, "o_orderkey")


def _units(spark, d):
    t = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 19).when(F.col("event_type") == "purchase", 40).when(F.col("event_type") == "signup", 34).otherwise(36)
    return _events(spark, d, t.alias("type"), (F.col("event_id") % 3 == 0).alias("first_slice"))


def access_units(spark, d):
    return sessions.access_units(_units(spark, d), ["user_id"], ORDER).select("user_id", "event_id", "au_id")


def picture_groups(spark, d):
    return sessions.pictures(_units(spark, d), ["user_id"], ORDER).select("user_id", "event_id", "picture_id")


def buffered_time(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    start = F.col("l_linenumber") * 40.0
    ranges = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct(start.alias("start"), (start + F.col("l_quantity")).alias("end")))).alias("r"))
    joined = sessions.join_ranges(F.col("r"), 5.0)
    return ranges.select("l_orderkey", F.round(sessions.total_buffered(F.col("r")), 4).alias("total"), F.size(joined).alias("runs"))


def block_levels(spark, d):
    levels = F.transform("embedding", lambda x: F.floor(x.cast("double") * 3000).cast("int"))
    v = _t(spark, d, "embeddings").select("vec_id", blocks.dequantise(levels, F.lit(45), 3).alias("residual"))
    whole = blocks.reconstruct(F.transform("residual", lambda x: F.lit(128)), F.transform("residual", lambda x: F.shiftright(x, 6)))
    return v.select("vec_id", F.posexplode(F.arrays_zip("residual", whole.alias("sample"))).alias("i", "z")).select("vec_id", "i", "z.residual", "z.sample")


def edge_classes(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 20).cast("int")).alias("s"))
    at = v.select("vec_id", "s", F.explode(F.sequence(F.lit(1), F.size("s") - 2)).alias("i"))
    return at.select("vec_id", "i", blocks.edge_class(F.col("s")[F.col("i") - 1], F.col("s")[F.col("i")], F.col("s")[F.col("i") + 1]).alias("kind"))


def entry_points(spark, d):
    sizes = F.transform(F.sequence(F.lit(1), (F.col("p_size") % 6 + 1)), lambda i: (i * F.col("p_size")).cast("long"))
    return _t(spark, d, "part").select("p_partkey", F.posexplode(references.starts(sizes)).alias("i", "start"))


def tile_bounds(spark, d):
    p = _t(spark, d, "part").select("p_partkey", references.uniform_sizes(F.col("p_size") + 7, F.col("p_partkey") % 5 + 1).alias("sizes"))
    return p.select("p_partkey", F.posexplode(F.arrays_zip("sizes", references.starts(F.col("sizes")).alias("starts"))).alias("i", "z")).select("p_partkey", "i", F.col("z.sizes").alias("size"), F.col("z.starts").alias("start"))


def _swapped(spark, d):
    """Pictures in an order of decoding in which every two are swapped."""
    from ..operators.ordering import display_order

    e = display_order(_events(spark, d), ["user_id"], ORDER, "n").withColumn("n", F.col("n") - 1)
    return e.select("user_id", F.col("n").cast("long").alias("decode_idx"), F.col("n").cast("long").bitwiseXOR(F.lit(1).cast("long")).alias("poc"))


def output_order(spark, d):
    pictures = _swapped(spark, d).withColumn("deltas", F.expr("cast(array() as array<struct<delta:int,used:boolean>>)")).withColumn("resets", F.col("decode_idx") == 0)
    return references.output_order(pictures, 2, 16, stream="user_id").select("user_id", "sequence", "poc", "shown_after", "shown")


def reordered(spark, d):
    return ordered.reorder_batch(_swapped(spark, d), "user_id", "decode_idx", "poc", 2)


def drained_and_flushed(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type")
    return ordered.all_frames(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"))


def repositions(spark, d):
    delta = F.col("value") / 20 - 1
    return _t(spark, d, "events").select("event_id", ordered.repositioned(delta, F.col("event_id") % 3 > 0, F.col("event_type") != "view").alias("flush"))


def queue_served(spark, d):
    kind = F.when(F.col("event_type") == "signup", "init").when(F.col("event_type") == "error", "abort").when(F.col("event_type") != "view", "segment")
    got = ordered.served(_events(spark, d, kind.alias("kind")), "user_id", ORDER, "kind")
    return got.select("user_id", "event_id", "generation", "init_no", "state")


def caps_applied(spark, d):
    rungs = ladder.ladder(_variants(spark, d), ["brand"], "n").select("brand", "rung", "height", "bandwidth")
    reason = F.when(F.col("p_partkey") % 4 == 0, "lower").when(F.col("p_partkey") % 4 == 1, "raise").otherwise("hold")
    told = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("cap"), reason.alias("reason"))
    return ladder.applied(told, rungs, ["brand"]).drop("brand", "cap")


def caps_by_fold(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") / 40).alias("speed"))
    out = control.decide_sql(e, "user_id", ORDER, "speed", ladder=4, start=3)
    return out.select("user_id", "event_id", F.coalesce("cap", F.lit(-1)).alias("cap"), F.round("mean_speed", 6).alias("mean_speed"), "reason")


def collocated_pictures(spark, d):
    k = F.col("c_custkey")
    c = references.collocated(F.array(k, k + 1, k + 2), F.array(k + 3, k + 4), k % 2, (k % 5 - 1))
    return _t(spark, d, "customer").select("c_custkey", c.alias("picture"))


def time_bases(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_size")
    return p.select(
        "p_partkey", media.ticks_to_micros(F.col("p_partkey") * 512, F.lit(12800)).alias("micros"),
        F.round(media.frames_per_second(F.lit(12800), F.col("p_size") % 7), 6).alias("fps"), media.kilobits(F.col("p_partkey") * 37).alias("kbps"),
    )


def bit_arithmetic(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select("p_partkey", bits.clip(k, F.lit(20), F.lit(150)).alias("held"), bits.bit_length(k + 1).alias("bits"), bits.round_half_up(F.col("p_size") / 2 - 10).alias("rounded"))


def reference_sets(spark, d):
    from ..operators.ordering import display_order

    e = display_order(_events(spark, d), ["user_id"], ORDER, "n").select("user_id", (F.col("n") - 1).cast("long").alias("decode_idx"), "event_type")
    named = F.array(*(F.struct(F.lit(-k).alias("delta"), F.lit(k < 3).alias("used")) for k in (1, 2, 3, 5)))
    pictures_ = e.select("user_id", "decode_idx", F.col("decode_idx").alias("poc"), named.alias("deltas"), (F.col("decode_idx") % 8 == 0).alias("resets"))
    got = references.derive_sets(pictures_, "user_id")
    return got.select("user_id", "decode_idx", F.concat_ws(",", "before").alias("before"), F.concat_ws(",", "follow").alias("follow"), F.concat_ws(",", "missing").alias("missing"))


NAMES = (
    collocated_pictures, time_bases, bit_arithmetic, reference_sets, unit_kinds, unit_routing, depth_reduction, crop_windows, rgb, log_filter, bounded_fetch, parameter_upsert, parameter_sets_accepted, slice_resolution,
    reference_by_poc, reference_by_low_bits, correlated, slice_headers, temporal_vectors, init_cache, any_flag, digests, reconciled, access_units,
    picture_groups, buffered_time, block_levels, edge_classes, entry_points, tile_bounds, output_order, reordered, drained_and_flushed, repositions,
    queue_served, caps_applied, caps_by_fold,
)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}
