"""Sources, sinks, streams, table functions and scans of hot keys on the tables of the test data; their SQL is in stream_sql."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import spread
from ..functions import media
from ..operators import blocks, lookup, scans, segments
from ..operators.ordering import display_order
from ..scratch import folder
from ..sources import mp4, streams, tables
from ..streaming import metrics, stateful
from .media_queries import ORDER, _sets
from .queries import _t, _us

BATCHES = 3


def _timed(spark, d, *columns):
    """Events with ts as an instant."""
    return _t(spark, d, "events").withColumn("ts", F.timestamp_micros(_us())).select("user_id", "ts", "event_id", "event_type", "value", *columns)


# -- files


def _written_units(spark, d):
    """Eight streams of units, a unit for each event, in files; the folder."""
    body = F.encode(F.concat_ws("-", "event_type", "event_id"), "utf-8")
    head = F.unhex(F.concat(F.lit("00000001"), F.lpad(F.hex((F.col("event_id") % 32) * 2), 2, "0"), F.lit("01")))
    e = _t(spark, d, "events").select(F.concat(F.lit("s"), F.col("user_id") % 8).alias("stream"), "ts", "event_id", F.concat(head, body).alias("content"))
    path = folder(spark)
    streams.write_in_order(e, path, "stream", ORDER, "content", ".265")
    return path


def _told(units):
    got = scans.numbered(units, ["stream"], ["file", "offset"], "nal_idx")
    return got.select("stream", "nal_idx", "size", "type", "layer", "tid", F.decode("rbsp", "utf-8").alias("payload"))


def unit_files(spark, d):
    return _told(streams.read_units(spark, _written_units(spark, d), "folders", split_bytes=32_768))


def unit_files_followed(spark, d):
    path = _written_units(spark, d)
    streams.register(spark)
    follow = spark.readStream.format("units").option("streams", "folders").option("final", "true").option("splitBytes", 32_768)
    return _told(stateful.collected(follow.load(path)))


def units_of_types(spark, d):
    got = streams.read_units(spark, _written_units(spark, d), "folders", 32_768, ["stream", "size", "type"], type=[1, 19, 21], stream=["s1", "s3"])
    return got.groupBy("stream", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def _samples(spark, d):
    """Eight files of samples, one for each event."""
    e = _t(spark, d, "events").select(F.concat(F.lit("s"), F.col("user_id") % 8).alias("path"), *ORDER, "event_type")
    e = scans.numbered(e, ["path"], ORDER, "index")
    data = F.encode(F.concat_ws("-", "event_type", "event_id"), "utf-8")
    return e.select("path", F.lit(1).alias("track"), "index", (F.col("index") * 512).alias("dts"), F.lit(512).cast("long").alias("duration"), (F.col("index") % 10 == 0).alias("key"), data.alias("data"))


def fragment_files(spark, d):
    made = mp4.remux(_samples(spark, d)).select("path", "sequence", "content")
    init = mp4.init_segment(640, 360, 12800, b"\1\x64\0\x28")
    heads = made.select("path").distinct().select("path", F.lit(0).alias("sequence"), F.lit(init).alias("content"))
    path = folder(spark)
    streams.write_in_order(made.unionByName(heads), path, "path", ["sequence"], "content", ".mp4")
    got = spark.read.format("samples").option("splitBytes", 32_768).load(path)
    return got.select(F.element_at(F.split("path", "/"), -2).alias("stream"), "track", "dts", "pts", "duration", "key", F.decode("data", "utf-8").alias("payload"))


def segments_restamped(spark, d):
    made = mp4.remux(_samples(spark, d), 7).select("path", "sequence", "content")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("sequence", F.hex("content").alias("x")))), lambda p: p["x"])
    files = made.groupBy("path").agg(F.unhex(F.array_join(parts, "")).alias("content"))
    return segments.restamped(files, 30, 90_000).select(F.col("path").alias("stream"), "sequence", "dts", "n")


def planar_bytes(spark, d):
    depth = F.when(F.col("vec_id") % 2 == 0, 8).otherwise(10)
    sample = lambda x: F.greatest(F.lit(0), F.least(F.call_function("shiftleft", F.lit(1), depth) - 1, F.floor((x.cast("double") + 1) * 128 * F.when(depth == 8, 1).otherwise(4)))).cast("int")
    return _t(spark, d, "embeddings").select("vec_id", F.lower(F.hex(media.packed_samples(F.transform("embedding", sample), depth))).alias("yuv"))


# -- hot keys: all events are one stream's


def hot_sequence_number(spark, d):
    e = _t(spark, d, "events").select(F.lit(0).alias("k"), *ORDER, "event_type")
    return scans.sequence_number(e, ["k"], ORDER, F.col("event_type") == "signup").select("event_id", "seq")


def hot_inherit_last(spark, d):
    e = _t(spark, d, "events").select(F.lit(0).alias("k"), *ORDER, "event_type", "value")
    return scans.inherit(e, ["k"], ORDER, F.when(F.col("event_type") == "view", F.col("value")), "inherited").select("event_id", "inherited")


def hot_counter_unwrap(spark, d):
    e = _t(spark, d, "events").select(F.lit(0).alias("k"), *ORDER, "event_type", (F.col("event_id") % 16).cast("int").alias("low"))
    return scans.unwrap_counter(e, ["k"], ORDER, "low", 16, F.col("event_type") != "click", F.col("event_type") == "signup").select("event_id", "full")


def hot_asof_config(spark, d):
    e = _t(spark, d, "events").select(F.lit(0).alias("k"), *ORDER, "event_type", "value")
    got = scans.as_of(e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'"), ["k"], ORDER, ["value"])
    return got.select("event_id", "value", F.col("asof_value").alias("config_value"))


def hot_slice_resolution(spark, d):
    e, pps, sps = (x.withColumn("user_id", F.lit(0)) for x in _sets(spark, d))
    slices = e.filter("event_type = 'purchase'").select("user_id", *ORDER, (F.col("event_id") % 3).alias("pps_id"))
    return lookup.resolve(slices, pps, sps, "user_id", ORDER, [], ["value"], scans.as_of).select("event_id", "pps_id", "sps_id", "sps_value")


# -- streams


def _sixteen(spark, d):
    """Events of sixteen sessions, numbered in each."""
    e = _timed(spark, d).withColumn("k", F.col("user_id") % 16)
    return display_order(e, ["k"], ORDER, "n").withColumn("n", F.col("n").cast("long") - 1)


def _play(df):
    return stateful.played(df, "ts", BATCHES).withWatermark("ts", "1 hour")


HOW = {"bucket_ms": 86_400_000, "idle_ms": 30 * 86_400_000}


def stream_reordered(spark, d):
    e = _sixteen(spark, d).select("k", "ts", "n", F.col("n").bitwiseXOR(F.lit(1).cast("long")).alias("poc"))
    return stateful.collected(stateful.reordered(_play(e), "k", "ts", "n", "poc", 2, **HOW))


def stream_caps(spark, d):
    e = _sixteen(spark, d).select("k", "ts", "n", (F.col("value") / 40).alias("speed"))
    out = stateful.collected(stateful.decided(_play(e), "k", "ts", "n", "speed", 4, 3, **HOW))
    return out.select("k", "n", F.coalesce("cap", F.lit(-1)).alias("cap"), F.round("mean_speed", 6).alias("mean_speed"), "reason")


def stream_init_cache(spark, d):
    e = _timed(spark, d).select("ts", "event_id", F.concat_ws("/", "event_type", F.col("user_id") % 5).alias("content"))
    e = scans.numbered(e.withColumn("k", F.lit(0)), ["k"], ORDER, "n").drop("k")
    return stateful.collected(stateful.cached(_play(e), "content", "ts", "n", "event_id", **HOW))


def stream_generation(spark, d):
    """Events come in order of their time, each with the generation that its number says."""
    e = _sixteen(spark, d).select("k", "ts", "n", (F.col("event_id") % 1000).alias("generation"))
    return stateful.collected(stateful.current(_play(e), "k", "ts", "n", "generation", **HOW))


def _queue(spark, d):
    return _sixteen(spark, d).select("k", "ts", "n", F.col("event_type").isin("click", "purchase").alias("done"))


def held_back(spark, d):
    return stateful.held_back(_queue(spark, d), "k", "n", "done")


def stream_held_back(spark, d):
    return stateful.collected(stateful.held_back_stream(_play(_queue(spark, d)), "k", "ts", "n", "done", **HOW))


def stream_correlated(spark, d):
    """An event of even number asks, the next one answers, a second later by a clock that these numbers are."""
    e = _t(spark, d, "events").select(F.expr("event_id div 2").alias("id"), "event_id", "event_type", F.timestamp_seconds(F.col("event_id") + 1_000_000).alias("ts"))
    asks = e.filter("event_id % 2 = 0").select("id", F.col("event_id").alias("request"), F.col("ts").alias("asked"))
    answers = e.filter("event_id % 2 = 1 and event_type <> 'error'").select("id", F.col("event_id").alias("response"), F.col("ts").alias("answered"))
    play = lambda df, at: stateful.played(df, at, BATCHES).withWatermark(at, "1 minute")
    got = stateful.correlated(play(asks, "asked"), play(answers, "answered"), "id", "asked", "answered", "10 seconds")
    return stateful.collected(got).filter("request is not null").select("id", "request", "response", "pending")


def observed_totals(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("ts"), "l_quantity", "l_extendedprice")
    some = stateful.played(li, "ts", BATCHES)
    got = metrics.observed(some, "segments", {"n": F.count("l_quantity"), "ms": F.sum(F.col("l_quantity").cast("long")), "dur": F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))})
    return got.agg(F.sum("n").alias("n"), F.sum("ms").alias("ms"), F.sum("dur").alias("dur")).withColumn("speed", F.round(F.col("dur") / F.col("ms"), 6))


# -- table functions


def prefixed_units(spark, d):
    tables.register(spark)
    with_length = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.length(c)), 4, "0")), F.encode(c, "utf-8"))
    spread(_t(spark, d, "part").select("p_partkey", F.concat(with_length("p_type"), with_length("p_brand")).alias("data"))).createOrReplaceTempView("framewright_prefixed")
    return spark.sql("SELECT p_partkey, i, decode(unit, 'utf-8') AS unit FROM framewright_prefixed AS p, LATERAL length_prefixed(p.data, 2)")


def stored_parameter_sets(spark, d):
    tables.register(spark)
    unit = lambda c: F.concat(F.lit("0001"), F.lpad(F.hex(F.length(c)), 4, "0"), F.hex(F.encode(c, "utf-8")))
    record = F.concat(F.hex(F.lit("hvcC")), F.lit("00" * 22 + "02" + "A1"), unit("p_type"), F.lit("22"), unit("p_brand"))
    spread(_t(spark, d, "part").select("p_partkey", F.unhex(record).alias("data"))).createOrReplaceTempView("framewright_records")
    return spark.sql("SELECT p_partkey, i, type, decode(unit, 'utf-8') AS unit FROM framewright_records AS p, LATERAL parameter_sets(p.data)")


def audio_configs(spark, d):
    tables.register(spark)
    inner = F.concat(F.lit("05"), F.lpad(F.hex(F.length("p_brand")), 2, "0"), F.hex(F.encode("p_brand", "utf-8")))
    outer = F.concat(F.lit("04"), F.lpad(F.hex(13 + F.length(F.unhex(inner))), 2, "0"), F.lit("40" + "00" * 12), inner)
    whole = F.concat(F.lit("03"), F.lpad(F.hex(3 + F.length(F.unhex(outer))), 2, "0"), F.lit("000000"), outer)
    spread(_t(spark, d, "part").select("p_partkey", F.unhex(whole).alias("esds"))).createOrReplaceTempView("framewright_descriptors")
    return spark.sql("SELECT p_partkey, decode(config, 'utf-8') AS config FROM framewright_descriptors AS p, LATERAL audio_config(p.esds)")


def table_digests(spark, d):
    tables.register(spark)
    _t(spark, d, "events").select(F.col("user_id").alias("key"), F.struct(*ORDER).alias("at"), F.col("event_type").alias("content")).createOrReplaceTempView("framewright_digested")
    return spark.sql("SELECT key AS user_id, digest, bytes FROM stream_digest(TABLE(framewright_digested))")


# -- blocks


def block_transforms(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000 + 0.5).cast("int")).alias("x"))
    n = 16
    y = v.select("vec_id", F.slice("x", 1, n).alias("x")).withColumn("y", blocks.forward(F.col("x"), n))
    z = blocks.inverse(F.transform("y", lambda c: F.shiftright(c, 10)), n)
    return y.select("vec_id", F.posexplode(F.arrays_zip("y", z.alias("back"))).alias("i", "z")).select("vec_id", "i", F.col("z.y").alias("y"), F.col("z.back").alias("back"))


NAMES = (
    unit_files, unit_files_followed, units_of_types, fragment_files, segments_restamped, planar_bytes, hot_sequence_number, hot_inherit_last, hot_counter_unwrap, hot_asof_config,
    hot_slice_resolution, stream_reordered, stream_caps, stream_init_cache, stream_generation, held_back, stream_held_back, stream_correlated, observed_totals,
    prefixed_units, stored_parameter_sets, audio_configs, table_digests, block_transforms,
)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}
