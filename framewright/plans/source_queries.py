"""Formats on the tables of the test data: what is written is read again, and what is read is what the tables say; their SQL is in source_sql."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import cli
from ..common import ship, spread
from ..functions.syntax import Writer, dump_headers, parse_parameter_sets
from ..operators import pictures, references
from ..operators.ordering import display_order
from ..sources import annexb, manifests, mp4
from .media_queries import ORDER
from .queries import _t
from .stream_queries import _samples


def unit_names(spark, d):
    return annexb.name_units(_t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 64).cast("int").alias("type")))


def unescaped_units(spark, d):
    """Units with three bytes that an escape ends, where the next byte asks for it."""
    e = _t(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), F.unhex(F.concat(F.lit("000001020111000003"), F.lpad(F.hex(F.col("event_id") % 6), 2, "0"), F.lit("80"))).alias("content"))
    got = annexb.split_streams(e)
    return got.select(F.col("stream").cast("long").alias("event_id"), "nal_idx", "offset", "type", F.lower(F.hex("rbsp")).alias("rbsp"), F.size("epb").alias("escapes"), annexb.plain_place(F.lit(5), F.col("epb")).alias("fifth"))


def manifest_variants(spark, d):
    p = _t(spark, d, "part").select("p_brand", "p_partkey", "p_size")
    line = F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), (F.col("p_partkey") + 1) * 1000, F.lit(",RESOLUTION="), F.col("p_size") * 16, F.lit("x"), F.col("p_size") * 9, F.lit(',CODECS="hvc1.1.6.L90.90,mp4a.40.2"\n'), "p_partkey", F.lit(".m3u8\n"))
    one = F.concat(F.lit('<Representation id="'), "p_partkey", F.lit('" width="'), F.col("p_size") * 16, F.lit('" height="'), F.col("p_size") * 9, F.lit('" bandwidth="'), (F.col("p_partkey") + 1) * 1000, F.lit('"/>'))
    both = p.groupBy("p_brand").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", x.alias("x")))), lambda r: r["x"]), "").alias(n) for n, x in (("hls", line), ("dash", one))))
    hls = both.select(F.concat(F.lit("hls "), "p_brand").alias("path"), F.concat(F.lit("#EXTM3U\n"), "hls").alias("content"))
    head, tail = '<MPD xmlns="urn:mpeg:dash:schema:mpd:2011"><Period><AdaptationSet codecs="hvc1.1.6.L90.90">', "</AdaptationSet></Period></MPD>"
    dash = both.select(F.concat(F.lit("dash "), "p_brand").alias("path"), F.concat(F.lit(head), "dash", F.lit(tail)).alias("content"))
    got = manifests.variants(hls.unionByName(dash).withColumn("content", F.encode("content", "utf-8")))
    return got.select("path", "position", "variant_id", "height", "width", "bandwidth", "codecs")


def _inits(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_size") * 16).alias("width"), (F.col("p_size") * 9).alias("height"), (F.col("p_partkey") % 7 * 1000 + 12800).alias("scale"), "p_partkey")
    sound = F.col("p_partkey") % 2 == 0
    return mp4.init_segments(p.select("path", "width", "height", "scale", F.when(sound, 48000).alias("rate"), F.lit(2).alias("channels"), F.lit(b"\1\x64\0\x28").alias("record"), F.lit(b"\x11\x90").alias("config")))


def init_tracks(spark, d):
    return mp4.track_table(_inits(spark, d)).select(F.col("path").cast("long").alias("p_partkey"), "track", "handler", "codec", "timescale", "width", "height")


def sniffed_segments(spark, d):
    kinds = F.array(*map(F.lit, ("ftyp", "moov", "moof", "free", "mdat")))
    p = _t(spark, d, "part").select("p_partkey", F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")).alias("kind"))
    boxes = p.select("p_partkey", F.when(F.col("p_partkey") % 11 > 0, F.concat(F.unhex(F.lit("00000008")), F.encode("kind", "utf-8"))).alias("content"))
    return mp4.sniffed(boxes).select("p_partkey", "begins_media", "begins_file", F.hex(mp4.or_free(F.col("content"))).alias("sent"))


def decode_times(spark, d):
    """Fragments of 30 samples; those of every other stream begin at more than 32 bits can tell."""
    late = F.when(F.substring("path", 2, 1).cast("int") % 2 == 1, 1 << 33).otherwise(0)
    made = mp4.remux(_samples(spark, d).withColumn("dts", F.col("dts") + late))
    told = mp4.decode_times(made.select(F.concat_ws("/", "path", "sequence").alias("path"), "content"))
    at = F.split("path", "/")
    return told.select(at[0].alias("stream"), at[1].cast("int").alias("sequence"), "time")


def _both_tracks(spark, d):
    s = _samples(spark, d).withColumn("sequence", F.floor(F.col("index") / 20).cast("int") + 1)
    sound = s.filter("index % 3 = 0").withColumns({"track": F.lit(2), "dts": F.floor(F.col("index") / 3) * 1024, "duration": F.lit(1024).cast("long"), "key": F.lit(True)})
    return s.unionByName(sound)


def two_track_segments(spark, d):
    made = mp4.media_segments(_both_tracks(spark, d))
    got = mp4.sample_table(made.select(F.concat_ws("/", "path", "sequence").alias("path"), "content"))
    at = F.split("path", "/")
    return got.select(at[0].alias("stream"), at[1].cast("int").alias("sequence"), "track", "dts", "duration", "key", F.decode("data", "utf-8").alias("payload"))


# -- headers


def _sps(width: int, height: int, poc: int = 4) -> bytes:
    w = Writer().u(0, 4).u(0, 3).u(1, 1).u(0, 2).u(0, 1).u(3, 5).u(0, 32).u(0, 48).u(30, 8)
    w.ue(0).ue(1).ue(width).ue(height).u(0, 1).ue(0).ue(0).ue(poc).u(1, 1).ue(4).ue(2).ue(0)
    w.ue(0).ue(3).ue(0).ue(3).ue(1).ue(1)
    return w.u(0, 1).u(0, 1).u(1, 1).u(0, 1).ue(0).u(0, 1).u(1, 1).u(1, 1).u(0, 1).u(0, 1).done()


def _pps(init_qp: int) -> bytes:
    return Writer().ue(1).ue(0).u(1, 1).u(0, 1).u(0, 3).u(0, 2).ue(0).ue(0).se(init_qp - 26).u(0, 3).se(0).se(0).u(0, 4).u(0, 2).u(0, 4).ue(0).u(0, 2).done()


def _slice(poc: int, by_qp: int) -> bytes:
    """A P slice with one picture before it."""
    return Writer().u(1, 1).ue(1).ue(1).u(poc % 256, 8).u(0, 1).ue(1).ue(0).ue(0).u(1, 1).u(0, 1).u(3, 2).u(0, 1).ue(3).se(by_qp).u(1, 1).done()


def _written(df, schema: str, row):
    """What `row` makes of each row's values."""
    ship(df.sparkSession)
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            cols = list(zip(*(row(*x) for x in zip(*(c.to_pylist() for c in batch.columns))))) or [[]] * len(to)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, to)], schema=to)

    return spread(df).mapInArrow(run, schema)


UNITS = "stream string, nal_idx int, type int, tid int, offset long, size long, rbsp binary"


def parsed_parameter_sets(spark, d):
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_size") % 8 * 8).alias("width"), (F.col("p_size") * 8).alias("height"))
    units = _written(p, UNITS, lambda k, w, h: (str(k), 0, 33, 0, 0, 0, _sps(int(w), int(h))))
    got = parse_parameter_sets(units)
    return got.select(F.col("stream").cast("long").alias("p_partkey"), "sps_id", "width", "height", "log2_max_poc_lsb", "max_dpb", F.col("problem").isNotNull().alias("refused"))


def _unit_stream(spark, d):
    """Eight streams: a sequence and a picture parameter set, and a slice for each event."""
    e = display_order(_t(spark, d, "events").withColumn("k", F.col("user_id") % 8), ["k"], ORDER, "n").select("k", "n", "event_id")
    slices = _written(e, UNITS, lambda k, n, i: (f"s{k}", n + 1, 1, 0, 0, 0, _slice(i, i % 5 - 2)))
    heads = e.select("k").distinct().select("k", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    sets = _written(heads, UNITS, lambda k, n: (f"s{k}", n, 34 if n else 33, 0, 0, 0, _pps(30 + k % 4) if n else _sps(64, 8 * (k + 1))))
    return slices.unionByName(sets)


def dumped_slices(spark, d):
    return pictures.dump_slices(_unit_stream(spark, d)).select("stream", "nal_idx", "first", "slice_type", "qp", "poc_lsb", F.col("problem").isNotNull().alias("refused"))


def dumped_headers(spark, d):
    got = dump_headers(_unit_stream(spark, d))
    return got.select("stream", "nal_idx", "id", "refers_to", F.regexp_extract("text", r"\bheight=(\d+)", 1).alias("height"), F.regexp_extract("text", r"init_qp=(\d+)", 1).alias("init_qp"))


def dumped_units(spark, d):
    return cli.dump_units(_unit_stream(spark, d)).select("stream", "nal_idx", "type", "type_name", "tid", "au_id")


def long_term_sets(spark, d):
    """A reset every eight pictures; that picture is kept as a long-term one by its count or by its count modulo 16, in turn, as is one that nothing has."""
    e = display_order(_t(spark, d, "events").select("user_id", *ORDER), ["user_id"], ORDER, "n").select("user_id", (F.col("n").cast("long") - 1).alias("decode_idx"))
    n, first = F.col("decode_idx"), F.col("decode_idx") - F.col("decode_idx") % 8
    by = lambda p, used: F.struct(F.when(n % 2 == 0, p).otherwise(p % 16).alias("poc"), F.when(n % 2 == 1, 16).cast("long").alias("span"), F.lit(used).alias("used"))
    far = F.array(by(first, True), F.struct((first + 100).alias("poc"), F.lit(None).cast("long").alias("span"), F.lit(False).alias("used")))
    near = F.array(F.struct(F.lit(-1).alias("delta"), F.lit(True).alias("used")))
    named = e.select("user_id", "decode_idx", n.alias("poc"), near.alias("deltas"), (n % 8 == 0).alias("resets"), far.alias("long_term"))
    got = references.derive_sets(named.withColumn("deltas", F.when(n % 8 > 1, F.col("deltas"))), "user_id")
    return got.select("user_id", "decode_idx", *(F.concat_ws(",", c).alias(c) for c in ("before", "long_use", "long_keep", "missing")))


NAMES = (
    unit_names, unescaped_units, manifest_variants, init_tracks, sniffed_segments, decode_times, two_track_segments, parsed_parameter_sets, dumped_slices, dumped_headers,
    dumped_units, long_term_sets,
)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}
