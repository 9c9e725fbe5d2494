"""The ordered-stream operators on the tables of the test data, and what they return as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bits, media, mime
from ..operators import blocks, control, ladder, lookup, ordering, quality, references, sessions
from ..streaming import ordered


def _us():
    """Microseconds of ts, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rolling_speed(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "ts", "value")
    out = ordering.rolling_mean(e, ["user_id"], ["ts", "event_id"], "value", 2)
    return out.select("user_id", "event_id", F.round("mean", 6).alias("mean"))


def compute_aware_cap(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") / 40).alias("speed"))
    out = control.decide(e, "user_id", ["ts", "event_id"], "speed", ladder=4, start=3)
    return out.select("user_id", "event_id", F.coalesce("cap", F.lit(-1)).alias("cap"), F.round("mean_speed", 6).alias("mean_speed"), "reason")


def counter_unwrap(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", (F.col("event_id") % 16).cast("int").alias("low"))
    out = ordering.unwrap_counter(e, ["user_id"], ["ts", "event_id"], "low", 16, F.col("event_type") != "click", F.col("event_type") == "signup")
    return out.select("user_id", "event_id", "full")


def sequence_number(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return ordering.sequence_number(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("user_id", "event_id", "seq")


def display_order(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    e = ordering.sequence_number(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return ordering.display_order(e, ["user_id"], ["seq", "value", "event_id"]).select("user_id", "event_id", "seq", "position")


def next_gap_duration(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", _us().alias("us"))
    return ordering.durations(e, ["user_id"], ["us", "event_id"], "us").select("user_id", "event_id", "duration")


def contiguous_ranges(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", _us().alias("us"))
    return ordering.contiguous_ranges(e, ["user_id"], ["us", "event_id"], "us", 6 * 3600 * 1_000_000)


def session_group(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return sessions.boundary_groups(
        e, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("signup", "error"),
        [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first_event")],
    )


def ladder_dedup(spark, d):
    p = _t(spark, d, "part").select("p_size", "p_partkey", "p_retailprice")
    one = lookup.first_per_key(p, ["p_size"], ["p_partkey"])
    # as many rows as there are sizes: the rungs of one ladder
    return ordering.display_order(one.withColumn("all", F.lit(0)), ["all"], ["p_size"], "rung").select("p_size", "p_partkey", "p_retailprice", (F.col("rung") - 1).alias("rung"))


def asof_config(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    got = lookup.as_of(e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'"), ["user_id"], ["ts", "event_id"], ["value"])
    got2 = got.select("user_id", "event_id", "value", F.col("asof_value").alias("config_value"))
    return got2


def ref_mark(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    late = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookup.mark_members(o, late, ["o_orderkey"], "referenced")


def ordinal_zip(spark, d):
    o = _t(spark, d, "orders")
    a = o.select("o_custkey", "o_orderkey", "o_orderdate")
    b = o.select("o_custkey", "o_totalprice", F.col("o_orderkey").alias("price_order"))
    z = lookup.zip_by_rank(a, b, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], [F.col("o_totalprice"), F.col("price_order")])
    return z.select("o_custkey", "rank", "o_orderkey", "o_totalprice")


def inherit_last(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return lookup.inherit(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("value")), "inherited").select("user_id", "event_id", "inherited")


def frame_quality(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 127 + 0.5)).alias("a"))
    v = v.withColumn("b", F.transform("a", lambda x: F.floor(x / 8) * 8))
    q = v.select("vec_id", quality.frame_difference(F.col("a"), F.col("b"), 255).alias("q"))
    return q.select("vec_id", F.col("q.max_abs").alias("max_abs"), F.col("q.n_diff").cast("long").alias("n_diff"), F.col("q.first_diff").cast("long").alias("first_diff"), F.round("q.psnr", 6).alias("psnr"))


def codec_level(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("hvc1.1.6.L"), (F.col("p_size") * 4).cast("string"), F.lit(".90")).alias("codec"), "p_size")
    return p.select("p_partkey", "codec", media.codec_for_level(F.col("codec")).alias("by_level"), media.codec_for_pixels(F.col("p_size") * 64, F.col("p_size") * 36).alias("by_pixels"))


def exp_golomb(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_partkey") % 1000).alias("v"))
    code = bits.ue_code(F.col("v"))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", code.alias("code"), bits.ue_length(F.col("v")).cast("long").alias("bits"), bits.ue_value(code).alias("back"), bits.se_value(F.col("v")).alias("signed"))


def chunk30(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id")
    return ordering.batches(e, ["user_id"], ["ts", "event_id"], 30).groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def retention(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "ts")
    return ordering.retained(e, ["user_id"], "ts", F.expr("interval 3 days")).select("user_id", "event_id")


def block_transform(spark, d):
    return blocks.block_transform(_t(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 1000)


def best_of_runs(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", "value")
    b = quality.best_of(e, ["user_id", "event_type"], "value")
    return b.select("user_id", "event_type", "best", F.round("mean", 6).alias("mean"), "runs")


def segment_speed(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    g = li.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("ms"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("dur"))
    return g.select("l_orderkey", quality.speed(F.col("ms"), F.col("dur")).alias("speed"))


def _variants(spark, d):
    height = F.when(F.col("p_size") % 3 > 0, F.col("p_size") * 36)
    return _t(spark, d, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("n"), height.alias("height"), (F.col("p_size") * 1000 + F.col("p_partkey") % 2).alias("bandwidth"), F.col("p_type").alias("codec")
    )


def ladder_rungs(spark, d):
    return ladder.ladder(_variants(spark, d), ["brand"], "n").select("brand", "n", "height", "bandwidth", "rung")


def active_rung(spark, d):
    rungs = ladder.ladder(_variants(spark, d), ["brand"], "n")
    playing = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), (F.col("p_size") * 36).alias("height"), (F.col("p_size") * 1000).alias("bandwidth"))
    return ladder.active_rung(playing, rungs, ["brand"]).select("p_partkey", "brand", "rung")


def mime_rewrite(spark, d):
    audio = F.when(F.col("p_size") % 2 == 0, ",mp4a.40.2").otherwise("")
    video = F.when(F.col("p_size") % 3 == 0, "avc1.640028").otherwise(F.concat(F.lit("hvc1.1.6.L"), F.col("p_size").cast("string")))
    m = _t(spark, d, "part").select("p_partkey", F.concat(F.lit('video/mp4; codecs="'), video, audio, F.lit('"')).alias("mime"))
    c = F.col("mime")
    return m.select("p_partkey", mime.is_muxed(c).alias("muxed"), mime.wants_transmux(c).alias("transmux"), mime.with_video_codec(c, F.lit("avc1.x")).alias("rewritten"))


def reference_lists(spark, d):
    k = F.col("c_custkey")
    c = _t(spark, d, "customer").select("c_custkey", F.array(k, k + 1).alias("before"), F.array(k + 2).alias("after"), F.array(k + 3).alias("long_term"), (k % 7 + 1).cast("int").alias("n"))
    got = c.select("c_custkey", F.posexplode(references.reference_list(F.col("before"), F.col("after"), F.col("long_term"), F.col("n"))).alias("place", "picture"))
    return got


def tile_scan(spark, d):
    k = F.col("p_partkey")
    cells = _t(spark, d, "part").select("p_partkey", F.floor(k / 200).alias("picture"), (k % 20).cast("int").alias("x"), F.floor(k % 200 / 20).cast("int").alias("y"))
    got = references.tile_scan(cells, ["picture"], F.array(*map(F.lit, (0, 7, 13))), F.array(*map(F.lit, (0, 4))))
    return got.select("p_partkey", F.col("tile").cast("int").alias("tile"), F.col("scan").cast("int").alias("scan"))


def neighbour_cells(spark, d):
    k = F.col("p_partkey")
    cells = _t(spark, d, "part").select(F.floor(k / 200).alias("picture"), (k % 20).alias("gx"), F.floor(k % 200 / 20).alias("gy"), "p_size")
    return references.neighbours(cells, ["picture"], "p_size")


def generation_filter(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    e = ordering.sequence_number(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "generation")
    return ordered.current_generation(e, "user_id", "generation").select("user_id", "event_id", "generation")


def rebase_times(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("base"))
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("dts"), F.max("l_suppkey").alias("pts"), F.min("base").alias("base"))
    first = li.groupBy("l_orderkey").agg(F.min(F.when(F.col("base") > 10, F.col("base"))).alias("tfdt"))
    return ordered.rebase(li.drop("base").join(first, "l_orderkey"), ["l_orderkey"], "l_linenumber", ["dts", "pts"], "tfdt").select("l_orderkey", "l_linenumber", "dts", "pts")


NAMES = (
    rolling_speed, compute_aware_cap, counter_unwrap, sequence_number, display_order, next_gap_duration, contiguous_ranges, session_group,
    ladder_dedup, asof_config, ref_mark, ordinal_zip, inherit_last, frame_quality, codec_level, exp_golomb, chunk30, retention,
    block_transform, best_of_runs, segment_speed, ladder_rungs, active_rung, mime_rewrite, reference_lists, tile_scan, neighbour_cells,
    generation_filter, rebase_times,
)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}
