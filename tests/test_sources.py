"""Headers, files of samples, and the data sources that read by byte ranges and write in order."""

import glob
import io
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framewright import cli
from framewright.functions.syntax import (
    Bits, Writer, dump_headers, parse_pps, parse_slice_header, parse_sps, parse_vps, ref_set, scaling_lists,
)
from framewright.operators import segments
from framewright.operators.pictures import dump_slices
from framewright.sources import annexb, files, mp4, streams

from .test_operators import sps_bytes

# The sequence and picture parameter set of a stream of one picture, and how its slice begins.
SPS = "0103700000009000000000001ea020810596e92930b80400000fa000000fa020"
PPS = "c07181a480"
SLICE = "ad400427dafffd92aa112fbf157c1c3df8fbe296939f06fae8d34dbd8655559bfedabcfdcc82"
TOY = ((33, SPS), (34, PPS), (20, SLICE))


def escaped(x):
    out, zeros = bytearray(), 0
    for c in x:
        if zeros >= 2 and c <= 3:
            out.append(3)
            zeros = 0
        out.append(c)
        zeros = zeros + 1 if c == 0 else 0
    return bytes(out)


def toy(units=TOY):
    return b"".join(b"\0\0\0\1" + bytes([k << 1, 1]) + escaped(bytes.fromhex(x)) for k, x in units)


def test_headers(spark):
    vps = bytes.fromhex("0c01ffff03700000009000000000001eba0240")
    assert parse_vps(vps).max_dpb == 3
    s, p = parse_sps(sps_bytes()), parse_pps(bytes.fromhex(PPS))
    assert (s.ref_sets, s.pcm, s.sao, s.depth_intra, s.strong_smoothing) == ([], None, True, 1, True)
    units = spark.createDataFrame([("s", 0, 32, bytearray(vps)), ("s", 1, 33, bytearray(sps_bytes())), ("s", 2, 34, bytearray(bytes.fromhex(PPS))), ("s", 3, 34, None), ("s", 4, 1, None)], "stream string, nal_idx int, type int, rbsp binary")
    got = dump_headers(units).orderBy("nal_idx").collect()
    assert [(r["id"], r["refers_to"]) for r in got] == [(0, None), (0, 0), (0, 0), (None, None)] and got[3]["problem"] and "width=64" in got[1]["text"]
    # a set given outright, one by what changes against it, and one in a slice
    b = Bits(Writer().ue(2).ue(1).ue(0).u(1, 1).ue(1).u(0, 1).ue(3).u(1, 1).done())
    one = ref_set(b, 0, [], 2, 15)
    assert (one.before, one.after) == ([(-1, True), (-3, False)], [(4, True)])
    b = Bits(Writer().u(1, 1).u(1, 1).ue(1).u(1, 1).u(0, 2).u(1, 1).u(0, 1).u(1, 1).done())
    two = ref_set(b, 1, [one], 2, 15)
    assert (two.before, two.after) == ([(-2, False), (-3, True)], [(2, True)])
    with pytest.raises(ValueError):
        ref_set(Bits(Writer().ue(9).ue(9).done()), 0, [], 1, 15)
    lists = scaling_lists(Bits(Writer().u(0, 1).ue(0).u(0, 1).ue(1).u(1, 1).se(4).u(0, 0).done() + b"\xff" * 400))
    assert lists.lists[0][0] == [16] * 16 == lists.lists[0][1] and lists.lists[0][2][0] == 12
    h = parse_slice_header(bytes.fromhex(SLICE), 20, p, parse_sps(bytes.fromhex(SPS)))
    assert (h.first, h.slice_type, h.qp, h.data_at, h.deblock_off) == (True, 2, 27, 2, True)
    with pytest.raises(ValueError):
        parse_slice_header(Writer().u(1, 1).u(0, 1).ue(0).ue(7).done(), 20, p, s)


def test_slices_are_read_with_the_sets_before_them(spark):
    rows = [(f"stream {i}", n, k, bytearray(bytes.fromhex(x))) for i in range(2) for n, (k, x) in enumerate(TOY) if i == 0 or k != 34]
    heads = sorted(dump_slices(spark.createDataFrame(rows, "stream string, nal_idx int, type int, rbsp binary")).collect())
    assert [(r["stream"], r["slice_type"], r["qp"]) for r in heads] == [("stream 0", "I", 27), ("stream 1", None, None)] and heads[1]["problem"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(toy())
    assert cli.main([str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--dump-nals", "--dump-headers"], spark) == 0
    read = lambda name: [json.loads(x) for p in sorted(glob.glob(f"{tmp_path}/out/{name}/*.json")) for x in Path(p).read_text().splitlines()]
    assert [r["type_name"] for r in read("nals")] == ["SPS_NUT", "PPS_NUT", "IDR_N_LP"] and len(read("headers")) == 2 and read("slices")[0]["qp"] == 27
    assert "3 units" in capsys.readouterr().out


def test_demux_and_remux(spark):
    init = mp4.init_segment(640, 360, 12800, b"\1\x64\0\x28")
    media = b"".join(mp4.fragment(k + 1, [(1, 1000 + 3 * 512 * k, [(bytes([k, i]) * (i + 1), 512, i == 0) for i in range(3)])]) for k in range(25))
    rows = list(mp4.demux(init + media))
    assert len(rows) == 75 and [r[2] for r in rows] == [1000 + 512 * i for i in range(75)] and rows[4][5:] == (False, b"\1\1\1\1")
    assert [r[1] for r in rows] == list(range(75))
    assert [r[:4] for r in mp4.demux(media, init)] == [r[:4] for r in rows]
    # fields from a fragment's header and from the track's defaults, a shift that is negative, a first sample's own flags
    trun = mp4.full_box(b"trun", 1, 0x805, (2).to_bytes(4, "big"), (0).to_bytes(4, "big"), (0).to_bytes(4, "big"), (7).to_bytes(4, "big"), (-5).to_bytes(4, "big", signed=True))
    tfhd = mp4.full_box(b"tfhd", 0, 0x20038, (1).to_bytes(4, "big"), (40).to_bytes(4, "big"), (3).to_bytes(4, "big"), (0x10000).to_bytes(4, "big"))
    make = lambda offset: mp4.box(b"moof", mp4.box(b"traf", tfhd, mp4.tfdt(1 << 33), trun[:16] + offset.to_bytes(4, "big") + trun[20:]))
    data = make(len(make(0)) + 8) + mp4.box(b"mdat", b"abcdef")
    assert list(mp4.demux(data, init)) == [(1, 0, 1 << 33, (1 << 33) + 7, 40, True, b"abc"), (1, 1, (1 << 33) + 40, (1 << 33) + 35, 40, False, b"def")]
    # samples that moov lists itself
    words = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    full = lambda kind, *x: mp4.full_box(kind, 0, 0, words(*x))
    stbl = lambda at: mp4.box(b"stbl", full(b"stsd", 0), full(b"stts", 1, 3, 10), full(b"stsc", 1, 1, 2, 1), full(b"stsz", 0, 3, 1, 2, 3), full(b"stco", 2, at, at + 3), full(b"stss", 1, 1))
    trak = lambda at: mp4.box(b"trak", full(b"tkhd", 0, 0, 7, *[0] * 18), mp4.box(b"mdia", full(b"mdhd", 0, 0, 90000, 0, 0), mp4.full_box(b"hdlr", 0, 0, words(0), b"vide"), mp4.box(b"minf", stbl(at))))
    whole = mp4.box(b"moov", trak(len(mp4.box(b"moov", trak(0))) + 8)) + mp4.box(b"mdat", b"abbccc")
    assert list(mp4.demux(whole)) == [(7, 0, 0, 0, 10, True, b"a"), (7, 1, 10, 10, 10, False, b"bb"), (7, 2, 20, 20, 10, False, b"ccc")]
    files = spark.createDataFrame([("a", bytearray(init + media)), ("b", bytearray(whole)), ("c", None)], "path string, content binary")
    assert {(r["path"], r["track"], r["codec"], r["timescale"], r["width"]) for r in mp4.track_table(files).collect()} == {("a", 1, "avc1", 12800, 640), ("b", 7, None, 90000, 0)}
    samples = mp4.sample_table(files)
    assert samples.count() == 78
    got = sorted(mp4.remux(samples.filter("path = 'a'")).collect(), key=lambda r: r["sequence"])
    assert [(r["sequence"], r["dts"], r["n"]) for r in got] == [(1, 1000, 30), (2, 1000 + 30 * 512, 30), (3, 1000 + 60 * 512, 15)]
    again = list(mp4.demux(b"".join(bytes(r["content"]) for r in got), init))
    assert [r[2:] for r in again] == [r[2:] for r in rows]


def test_many_small_rows_are_many_tasks_work(spark):
    """Init segments of a table that one task reads, and their tracks."""
    part = spark.range(0, 600, 1, 1)
    sizes = part.select(F.col("id").cast("string").alias("path"), (F.col("id") % 5 * 16).alias("width"), F.lit(360).alias("height"), F.lit(12800).alias("scale"), F.when(F.col("id") % 2 == 0, 48000).alias("rate"), F.lit(2).alias("channels"), F.lit(b"\1").alias("record"), F.lit(b"\2").alias("config"))
    inits = mp4.init_segments(sizes)
    per_task = [n for n, in inits.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(per_task) == 600 and max(per_task) < 100
    got = mp4.track_table(inits).select("path", "track", "width").collect()
    assert sorted(map(tuple, got)) == sorted((str(i), k, i % 5 * 16 if k == 1 else 0) for i in range(600) for k in (1, 2) if k == 1 or i % 2 == 0)


def test_segments_are_restamped(spark):
    init = mp4.init_segment(640, 360, 12800, b"\1\x64\0\x28")
    media = b"".join(mp4.fragment(k + 1, [(1, 1000 + 4 * 500 * k, [(bytes([k, i]), 512, i == 0) for i in range(4)])]) for k in range(10))
    files = spark.createDataFrame([("a", bytearray(init + media)), ("b", bytearray(init))], "path string, content binary")
    got = sorted(segments.restamped(files, 30, 90_000).collect(), key=lambda r: r["sequence"])
    assert [(r["path"], r["sequence"], r["n"]) for r in got] == [("a", 1, 30), ("a", 2, 10)]
    rows = list(mp4.demux(b"".join(bytes(r["content"]) for r in got), init))
    # fragments are 2,000 ticks apart, so that a fragment's samples of 512 each end 48 after the next begins
    want = [90_000 + 2000 * k + 512 * i for k in range(10) for i in range(4)]
    assert [r[2] for r in rows] == want and [r[6] for r in rows] == [bytes([k, i]) for k in range(10) for i in range(4)]
    assert [r[4] for r in rows] == [b - a for a, b in zip(want, want[1:])] + [512]
    done = spark.createDataFrame([(1, 500.0, 1000.0), (2, 0.0, 1000.0)], "seq long, total double, media double")
    assert [(r["seq"], r["speed"]) for r in segments.published(done, "total", "media").collect()] == [(1, 2.0)]


def some_stream(n, rng):
    out = b"" if rng.random() < 0.5 else b"junk"
    for _ in range(n):
        body = bytes(rng.choice((0, 0, 1, 2, 3, 77)) for _ in range(rng.choice((0, 1, 5, 40, 400))))
        out += rng.choice((b"\0\0\1", b"\0\0\0\1", b"\0\0\0\0\1")) + bytes([rng.randrange(40) << 1, 1]) + escaped(body)
    return out + b"\0" * rng.randrange(3)


def test_ranges_of_any_size_give_each_unit_once():
    rng = random.Random(8)
    for _ in range(60):
        data = some_stream(rng.randrange(12), rng)
        want = annexb.units(data)
        for split in (1, 2, 3, 7, 50, 1000):
            for chunk in (3, 11, 1 << 20):
                got = [u for a, b in files.ranges(len(data), split) for u in streams.units_between(io.BytesIO(data), a, b, chunk)]
                assert got == want
        code = data.rfind(b"\0\0\1")
        assert streams.last_code(io.BytesIO(data), 0, len(data), 5) == (code if code >= 0 else None)


def test_units_source(spark, tmp_path):
    rng = random.Random(3)
    for k in range(3):
        (tmp_path / f"{k}.265").write_bytes(some_stream(300 * k, rng))
    (tmp_path / "_hidden").write_bytes(toy())
    plain = annexb.read_streams(spark, str(tmp_path) + "/[0-9].265").withColumn("stream", F.regexp_replace("stream", "^file:/*", "/"))
    got = streams.read_units(spark, str(tmp_path), split_bytes=2000)
    assert got.rdd.getNumPartitions() > 10
    rows = lambda df: sorted(map(str, df.select("stream", "offset", "size", "type", "layer", "tid", "rbsp", "epb").collect()))
    assert rows(got) == rows(plain) and got.count() > 500
    # options choose files and units; fewer columns may be asked for
    few = streams.read_units(spark, str(tmp_path), split_bytes=2000, stream=[str(tmp_path / "1.265")], type=[1, 19])
    assert rows(few) == rows(plain.filter(F.col("stream").endswith("1.265") & F.col("type").isin(1, 19))) and few.rdd.getNumPartitions() < got.rdd.getNumPartitions()
    narrow = streams.read_units(spark, str(tmp_path), split_bytes=2000, columns=["offset", "type"])
    assert narrow.columns == ["offset", "type"] and narrow.count() == got.count()
    (tmp_path / "none").mkdir()
    assert streams.read_units(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        streams.read_units(spark, str(tmp_path / "nowhere")).count()


def test_samples_source(spark, tmp_path):
    init = mp4.init_segment(640, 360, 12800, b"\1\x64\0\x28")
    media = b"".join(mp4.fragment(k + 1, [(1, 1000 + 3 * 512 * k, [(bytes([k, i]) * (i + 20), 512, i == 0) for i in range(3)])]) for k in range(25))
    (tmp_path / "a.mp4").write_bytes(init + media)
    (tmp_path / "b.mp4").write_bytes(init)
    streams.register(spark)
    got = spark.read.format("samples").option("splitBytes", 600).load(str(tmp_path))
    assert got.rdd.getNumPartitions() > 5
    want = [r for r in mp4.demux(init + media)]
    rows = sorted(got.collect(), key=lambda r: (r["fragment"], r["index"]))
    assert [(r["track"], r["dts"], r["pts"], r["duration"], r["key"], bytes(r["data"]), r["timescale"], r["codec"]) for r in rows] == [(x[0], *x[2:], 12800, "avc1") for x in want]
    few = spark.read.format("samples").option("splitBytes", 600).option("files", json.dumps([str(tmp_path / "a.mp4")])).option("key", "[true]").load(str(tmp_path))
    assert few.count() == 25 and spark.read.format("samples").option("files", '["elsewhere"]').load(str(tmp_path)).count() == 0
    # a fragment that doesn't tell its time can be read with those before it only
    bare = lambda k: mp4.box(b"moof", mp4.box(b"traf", mp4.full_box(b"tfhd", 0, 0x020000, (1).to_bytes(4, "big")))) + mp4.box(b"mdat", b"x" * 900)
    (tmp_path / "c").mkdir()
    lone = mp4.fragment(1, [(1, 0, [(b"x" * 900, 5, True)])]).replace(b"tfdt", b"free")
    (tmp_path / "c" / "c.mp4").write_bytes(init + lone + lone + bare(0))
    assert [r["dts"] for r in spark.read.format("samples").option("splitBytes", 0).load(str(tmp_path / "c")).orderBy("dts").collect()] == [0, 5]
    with pytest.raises(Exception, match="no decode time"):
        spark.read.format("samples").option("splitBytes", 500).load(str(tmp_path / "c")).count()


def content(folder, stream):
    return b"".join(Path(p).read_bytes() for p in sorted(glob.glob(f"{folder}/{stream}/part-*")))


def test_files_are_in_order_and_there_only_once_all_is_done(spark, tmp_path):
    df = spark.range(0, 5000).select((F.col("id") % 3 == 0).alias("hot"), "id").select(
        F.when(F.col("hot"), "a/b").when(F.col("id") % 7 == 0, None).otherwise("c").alias("s"), "id", F.concat(F.col("id").cast("string"), F.lit(";")).alias("x"))
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as it is, it goes to many tasks
    streams.write_in_order(df, out, "s", ["id"], "x", ".txt")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = lambda keep: "".join(f"{i};" for i in range(5000) if keep(i)).encode()
    assert content(out, "a%2Fb") == want(lambda i: i % 3 == 0) and content(out, "__null__") == want(lambda i: i % 3 and i % 7 == 0)
    assert content(out, "c") == want(lambda i: i % 3 and i % 7) and not glob.glob(out + "/_staging*")
    assert len(glob.glob(out + "/*/part-*")) > 3

    before = sorted(glob.glob(out + "/**", recursive=True))
    fails = df.withColumn("x", F.when(F.col("id") < 4000, F.col("x")).otherwise(F.raise_error(F.lit("torn"))))
    with pytest.raises(Exception, match="torn"):
        streams.write_in_order(fails, out, "s", ["id"], "x", ".txt")
    assert sorted(glob.glob(out + "/**", recursive=True)) == before
    streams.write_in_order(df.filter("id < 3"), out, "s", ["id"], "x", ".txt", "overwrite")
    assert content(out, "a%2Fb") == b"0;" and content(out, "c") == b"1;2;"
    assert sorted(files.stream_of(p) for p, _ in files.listed(out)) == ["a/b", "c"]
