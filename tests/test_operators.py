import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import bits, media
from framewright.functions.syntax import Bits, Writer, parse_parameter_sets, parse_pps, parse_slice_header, parse_sps
from framewright.operators import blocks, control, lookup, ordering, quality, references, sessions
from framewright.operators.control import Controller, Settings
from framewright.sources import annexb, manifests, mp4
from framewright.streaming import ordered


def test_controller_waits_for_a_full_window():
    c = Controller(Settings(window=8))
    c.resize(4)
    assert all(c.observe(0.5, 3)[::2] == (None, "init") for _ in range(7))
    assert c.observe(0.5, 3)[::2] == (2, "lower")


def test_controller_holds_in_the_dead_band_and_raises_after_a_streak():
    c = Controller(Settings(window=4, lower_after=2, raise_after=2))
    c.resize(5)
    assert {c.observe(1.15, 3)[2] for _ in range(16)} == {"init", "hold"}
    seen = []
    while not seen or seen[-1] != "lower":
        seen.append(c.observe(0.5, 3)[2])
    assert c.cap == 2
    while seen[-1] != "raise":
        seen.append(c.observe(2.0, 3)[2])
    assert c.cap == 3


def test_controller_never_raises_before_lowering_clamps_and_reverts():
    c = Controller(Settings(window=1, raise_after=1))
    c.resize(4)
    assert [c.observe(3.0, 2)[2] for _ in range(5)] == ["hold"] * 5
    assert c.observe(0.1, 3)[::2] == (2, "lower")
    c.revert()
    assert c.cap is None
    c.observe(0.1, 3)
    c.resize(2)
    assert c.cap == 1
    c.reset()
    assert c.cap is None and c.ladder == 2
    with pytest.raises(ValueError):
        Settings(target=1.0)


def speeds(spark, n=400):
    rng = random.Random(4)
    return spark.createDataFrame([(i % 7, i, rng.choice([0.4, 0.9, 1.1, 1.6, 3.0])) for i in range(n)], "k long, t long, x double")


def test_controller_as_sql_fold_and_as_sorted_scan_agree(spark):
    df = speeds(spark)
    for s in (Settings(), Settings(window=3, raise_after=2, lower_after=2)):
        a = control.decide(df, "k", ["t"], "x", 4, 3, s).select("k", "t", "cap", F.round("mean_speed", 9), "reason")
        b = control.decide_sql(df, "k", ["t"], "x", 4, 3, s).select("k", "t", "cap", F.round("mean_speed", 9), "reason")
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_null_speeds_and_keys_are_alike_in_both_controllers(spark):
    rows = [(k, t, x) for k in (1, None) for t, x in enumerate([0.5, None, 0.5, 0.5, None, None, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "k long, t long, x double")
    for s in (Settings(), Settings(window=3, raise_after=2, lower_after=2)):
        a, b = (f(df, "k", ["t"], "x", 4, 3, s).select("k", "t", "cap", F.round("mean_speed", 9), "reason") for f in (control.decide, control.decide_sql))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 16


def test_rows_of_null_key_stay(spark):
    df = spark.createDataFrame([(None, 1, 5, 100), (None, 2, 8, None), (1, 1, 7, 50)], "s long, o int, t int, b int")
    got = sorted((str(r["s"]), r["o"], r["t"]) for r in ordered.rebase(df, ["s"], "o", ["t"], "b").collect())
    assert got == [("1", 1, 50), ("None", 1, 100), ("None", 2, 103)]
    assert ordered.current_generation(df, "s", "o").count() == 2 and ordering.retained(df, ["s"], "t", F.lit(1)).count() == 2
    got = {(r["k"], r["made_for"]) for r in lookup.cached(spark.createDataFrame([(1, None), (2, None), (3, "x")], "k int, c string"), "c", ["k"], "k").collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}


def test_reorder_emits_in_order_and_loses_nothing(spark):
    rng = random.Random(2)
    rows = []
    for k in range(3):
        order = list(range(60))
        for i in range(0, 60, 5):
            part = order[i : i + 5]
            rng.shuffle(part)
            order[i : i + 5] = part
        rows += [(k, at, p) for at, p in enumerate(order)]
    got = ordered.reorder_batch(spark.createDataFrame(rows, "k long, at long, p long"), "k", "at", "p", 5).collect()
    for k in range(3):
        assert [r["p"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["emitted"])] == list(range(60))


def test_unwrap_counter(spark):
    rng = random.Random(1)
    rows, full, resets = [], 5, 0
    for i in range(300):
        reset = i % 97 == 0 and i > 0
        full = rng.randint(0, 3) if reset else full + rng.randint(-2, 5)
        rows.append((1, i, full % 16, full, reset))
    df = spark.createDataFrame(rows, "s long, i long, low int, full long, reset boolean")
    got = ordering.unwrap_counter(df, ["s"], ["i"], "low", 16, F.lit(True), F.col("reset"), "back").orderBy("i").collect()
    assert all((r["back"] - r["full"]) % 16 == 0 for r in got)
    prev, msb = 0, 0
    for r in got:
        low = r["low"]
        if r["reset"]:
            want, prev, msb = low, 0, 0
        else:
            msb += 16 if low < prev and prev - low >= 8 else -16 if low > prev and low - prev > 8 else 0
            want, prev = msb + low, low
        assert r["back"] == want


def test_durations_and_ranges(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 25), ("b", 7)], "s string, t long")
    got = {(r["s"], r["t"]): r["duration"] for r in ordering.durations(df, ["s"], ["t"], "t").collect()}
    assert got == {("a", 0): 10, ("a", 10): 15, ("a", 25): 10, ("b", 7): None}
    r = spark.range(1).select(F.expr("array(named_struct('start', 0D, 'end', 1D), named_struct('start', 1.02D, 'end', 2D), named_struct('start', 5D, 'end', 6D))").alias("r"))
    got = r.select(sessions.join_ranges(F.col("r"), 0.05).alias("j"), sessions.total_buffered(F.col("r")).alias("t")).first()
    assert [tuple(x) for x in got["j"]] == [(0.0, 2.0), (5.0, 6.0)] and abs(got["t"] - 2.98) < 1e-9


def test_lookups(spark):
    facts = spark.createDataFrame([("a", 5, 1), ("a", 2, 2), ("b", 1, 3)], "k string, t int, f int")
    versions = spark.createDataFrame([("a", 2, "x"), ("a", 4, "y"), ("b", 1, "z")], "k string, t int, v string")
    got = {(r["k"], r["t"]): r["asof_v"] for r in lookup.as_of(facts, versions, ["k"], ["t"], ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 2): None, ("b", 1): None}


def test_frame_difference(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3]), ([10, 0, 0], [10, 4, 0])], "a array<int>, b array<int>")
    q = [r["q"] for r in df.select(quality.frame_difference(F.col("a"), F.col("b"), 255).alias("q")).collect()]
    assert tuple(q[0]) == (0.0, 0, None, float("inf"))
    assert q[1]["n_diff"] == 1 and q[1]["first_diff"] == 1 and abs(q[1]["psnr"] - 10 * np.log10(255**2 / (16 / 3))) < 1e-9


def test_bits(spark):
    df = spark.range(0, 2000).withColumn("code", bits.ue_code(F.col("id")))
    assert df.filter((bits.ue_value(F.col("code")) != F.col("id")) | (F.length("code") != bits.ue_length(F.col("id")))).count() == 0
    w = Writer()
    values = [0, 1, -1, 5, -1000, 77]
    for v in values:
        w.se(v)
    b = Bits(w.done())
    assert [b.se() for _ in values] == values and not b.more_data()
    got = spark.createDataFrame([(40000,), (-40000,), (32767,)], "x int").select(bits.wrap16(F.col("x"))).collect()
    assert [r[0] for r in got] == [-25536, 25536, 32767]


def test_codec_strings(spark):
    df = spark.createDataFrame([("hvc1.1.6.L93.B0",), ("hev1.1.6.L120.90",), ("hvc1.2.4.H153",), ("odd",)], "c string")
    assert [r[0] for r in df.select(media.codec_for_level(F.col("c"))).collect()] == ["avc1.640028", "avc1.64002a", "avc1.640033", "avc1.640033"]


def nal(kind, body, code=b"\0\0\0\1"):
    return code + bytes([kind << 1, 1]) + body


def test_annexb_splits_and_unescapes(spark, tmp_path):
    assert annexb.units(b"no start code") == []
    data = nal(32, b"\x11\0\0\3\1\x80") + nal(1, b"\x80\0\0\3\5\x80", b"\0\0\1") + b"\0\0"
    (tmp_path / "a.265").write_bytes(data)
    got = annexb.name_units(annexb.read_streams(spark, str(tmp_path))).orderBy("nal_idx").collect()
    assert [(r["type"], r["layer"], r["tid"], bytes(r["rbsp"]), r["epb"], r["type_name"]) for r in got] == [
        (32, 0, 0, b"\x11\0\0\1\x80", [3], "VPS_NUT"), (1, 0, 0, b"\x80\0\0\3\5\x80", [], "TRAIL_R"),
    ]
    q = annexb.feed_streams(spark, str(tmp_path), 1).writeStream.format("memory").queryName("fed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fed").count() == 2
    assert annexb.plain_offset(7, [3]) == 6
    assert annexb.length_prefixed(b"\0\0\0\2ab\0\0\0\x09c", 4) == [b"ab"]


def sps_bytes(width=64, height=64, poc=4):
    w = Writer().u(0, 4).u(0, 3).u(1, 1).u(0, 2).u(0, 1).u(3, 5).u(0, 32).u(0, 48).u(30, 8)
    w.ue(0).ue(1).ue(width).ue(height).u(1, 1).ue(0).ue(1).ue(0).ue(2).ue(0).ue(0).ue(poc).u(1, 1).ue(4).ue(2).ue(0)
    w.ue(0).ue(3).ue(0).ue(3).ue(1).ue(1)
    return w.u(0, 1).u(0, 1).u(1, 1).u(0, 1).ue(0).u(0, 1).u(1, 1).u(1, 1).u(0, 1).u(0, 1).done()


def test_parameter_sets(spark):
    s = parse_sps(sps_bytes())
    assert (s.width, s.height, s.shown, s.profile, s.level, s.log2_max_poc_lsb, s.max_dpb, s.max_reorder, s.log2_ctb) == (64, 64, (62, 60), 3, 30, 8, 5, 2, 6)
    p = parse_pps(Writer().ue(1).ue(0).u(1, 1).u(0, 1).u(0, 3).u(0, 2).ue(0).ue(0).se(4).u(0, 3).se(0).se(0).u(0, 4).u(0, 2).u(0, 4).ue(0).u(0, 2).done())
    assert (p.pps_id, p.sps_id, p.dependent_slices, p.init_qp) == (1, 0, True, 30)
    # a P slice of picture 37 with two pictures before it, of which it may use one
    x = parse_slice_header(Writer().u(1, 1).ue(1).ue(1).u(37, 8).u(0, 1).ue(2).ue(0).ue(0).u(1, 1).ue(1).u(0, 1).u(0, 1).u(3, 2).u(0, 1).ue(3).se(-2).u(1, 1).done(), 1, p, s)
    assert (x.first, x.slice_type, x.poc_lsb, x.max_merge, x.qp, x.sao_chroma) == (True, 1, 37, 2, 28, True)
    assert x.ref_set.before == [(-1, True), (-3, False)] and x.n_refs == [1]
    with pytest.raises(ValueError):
        parse_sps(sps_bytes(width=0))
    df = spark.createDataFrame([("s", 0, 33, bytearray(sps_bytes())), ("s", 1, 33, bytearray(b"\1\2"))], "stream string, nal_idx int, type int, rbsp binary")
    got = parse_parameter_sets(df).orderBy("nal_idx").collect()
    assert got[0]["width"] == 64 and got[0]["problem"] is None and got[1]["width"] is None and got[1]["problem"]


def test_access_units_and_pictures(spark):
    kinds = [(32, False), (33, False), (34, False), (19, True), (19, False), (1, True), (35, False), (39, False), (1, True), (1, False), (36, False), (1, True), (40, False), (39, False), (1, True), (60, False), (19, True)]
    df = spark.createDataFrame([("s", i, k, f) for i, (k, f) in enumerate(kinds)], "stream string, nal_idx int, type int, first_slice boolean")
    got = sessions.pictures(sessions.access_units(df)).orderBy("nal_idx").collect()
    assert [r["au_id"] for r in got] == [0, 0, 0, 0, 0, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 5, 5]
    assert [r["picture_id"] for r in got] == [None, None, None, 0, 0, 1, None, None, 2, 2, None, 3, None, None, 4, None, 5]


def test_fragments_round_trip_and_decode_times():
    tracks = [(1, 434000, [(b"abcd", 512, True), (b"efghi", 512, False)]), (2, (1 << 32) + 500, [(b"xy", 1024, True), (b"zzz", 1024, True)])]
    data = mp4.fragment(7, tracks)
    got = mp4.samples(data)
    assert [(t, at, d, k, x) for t, _, at, d, k, x in got] == [(1, 434000, 512, True, b"abcd"), (1, 434512, 512, False, b"efghi"), (2, (1 << 32) + 500, 1024, True, b"xy"), (2, (1 << 32) + 1524, 1024, True, b"zzz")]
    assert mp4.decode_time(data) is None
    assert mp4.decode_time(mp4.fragment(1, tracks[:1])) == 434000
    assert mp4.decode_time(mp4.fragment(1, tracks[1:])) == (1 << 32) + 500
    assert mp4.decode_time(mp4.box(b"mdat", mp4.fragment(1, tracks[:1]))) is None
    odd = mp4.box(b"moof", mp4.box(b"traf", mp4.full_box(b"tfdt", 2, 0, b"\0" * 8)))
    assert mp4.decode_time(odd) is None
    assert mp4.is_init(mp4.box(b"ftyp", b"isom")) and mp4.is_init(mp4.box(b"moov")) and not mp4.is_init(mp4.box(b"moov"), moov=False)
    esds = mp4.descriptor(3, b"\0\0\0" + mp4.descriptor(4, b"\x40" + b"\0" * 12 + mp4.descriptor(5, b"\x12\x10")) + mp4.descriptor(6, b"\2"))
    assert mp4.audio_config(esds) == b"\x12\x10" and mp4.descriptor(5, b"a" * 200)[:3] == b"\5\x81\x48"
    record = b"hvcC" + b"\0" * 22 + b"\1" + bytes([33, 0, 1, 0, 2]) + b"hi"
    assert mp4.parameter_sets(record) == [(33, b"hi")]


def test_transforms(spark):
    for n in (4, 8, 16, 32):
        t = np.array(blocks.cosine_matrix(n))
        assert (t[0] == 64).all() and np.abs(t @ t.T - np.diag(np.diag(t @ t.T))).max() <= 0.01 * (t @ t.T)[0, 0]
        x = [(7 * i * i) % 91 - 45 for i in range(n)]
        got = spark.createDataFrame([(x,)], "x array<int>").select(blocks.forward(F.col("x"), n).alias("y"))
        y = got.first()["y"]
        assert y == (t @ np.array(x)).tolist()
        back = got.select(blocks.inverse(F.col("y"), n, 12 + n.bit_length() - 1).alias("z")).first()["z"]
        assert max(abs(p - q) for p, q in zip(back, x)) <= 1
    assert blocks.cosine_matrix(4) == [list(r) for r in blocks.DCT4]
    with pytest.raises(ValueError):
        blocks.cosine_matrix(12)
    got = spark.createDataFrame([([1, 2, 3, 4],)], "x array<int>").select(blocks.inverse4(blocks.transform4(F.col("x")), shift=14).alias("y")).first()["y"]
    assert got == [1, 2, 3, 4]


def test_samples_as_bytes(spark):
    rows = [([0, 255, 7], 8), ([1023, 5], 10), ([], 8), ([1, None], 8), (None, 8)]
    got = [r[0] for r in spark.createDataFrame(rows, "s array<int>, d int").select(media.packed_samples(F.col("s"), F.col("d")).alias("b")).collect()]
    assert [None if x is None else bytes(x) for x in got] == [b"\0\xff\x07", b"\xff\x03\x05\0", b"", None, None]


def test_reference_sets(spark):
    d = "array<struct<delta:int,used:boolean>>"
    rows = [("s", 0, 0, [], True), ("s", 1, 4, [(-4, True)], False), ("s", 2, 2, [(-2, True), (2, True)], False), ("s", 3, 8, [(-4, True), (-6, False), (-8, True), (-7, True)], False), ("s", 4, 6, [(-2, True), (2, True)], False), ("s", 5, 0, [], True)]
    df = spark.createDataFrame(rows, f"stream string, decode_idx int, poc int, deltas {d}, resets boolean")
    got = {r["decode_idx"]: (r["before"], r["after"], r["follow"], r["missing"]) for r in references.derive_sets(df).collect()}
    assert got[1] == ([0], [], [], []) and got[2] == ([0], [4], [], [])
    assert got[3] == ([4, 0], [], [2], [1]) and got[4] == ([4], [8], [], []) and got[5] == ([], [], [], [])
    far = "array<struct<poc:long,span:long,used:boolean>>"
    rows = [("s", 0, 0, [], True, None), ("s", 1, 20, [], False, [(0, None, True)]), ("s", 2, 37, [(-17, True)], False, [(0, 16, False), (5, 16, True)]), ("s", 3, 38, [], False, [(5, 32, True)])]
    df = spark.createDataFrame(rows, f"stream string, decode_idx int, poc int, deltas {d}, resets boolean, long_term {far}")
    got = {r["decode_idx"]: (r["before"], r["long_use"], r["long_keep"], r["missing"]) for r in references.derive_sets(df).collect()}
    assert got[1] == ([], [0], [], []) and got[2] == ([20], [], [0], [5]) and got[3] == ([], [37], [], [])


def test_manifests(spark):
    hls = '#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=800000,AVERAGE-BANDWIDTH=700000,RESOLUTION=854x480,CODECS="hvc1.1.6.L90.90,mp4a.40.2"\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=5000000\nhigh.m3u8\n'
    dash = '<MPD xmlns="urn:mpeg:dash:schema:mpd:2011"><Period><AdaptationSet codecs="hev1"><Representation id="a" width="640" height="360" bandwidth="500000"/></AdaptationSet></Period></MPD>'
    df = spark.createDataFrame([("h", bytearray(hls.encode())), ("d", bytearray(dash.encode())), ("x", bytearray(b"<")), ("n", None)], "path string, content binary")
    got = sorted((r["path"], r["variant_id"], r["height"], r["bandwidth"], r["codecs"]) for r in manifests.variants(df).collect())
    assert got == [("d", "a", 360, 500000, "hev1"), ("h", "high.m3u8", None, 5000000, None), ("h", "low.m3u8", 480, 800000, "hvc1.1.6.L90.90,mp4a.40.2")]


def test_init_segment():
    data = mp4.init_segment(1280, 720, 12800, b"\1\x64\0\x28", audio=(48000, 2, b"\x11\x90"))
    assert mp4.is_init(data, moov=False) and [k for k, _, _ in mp4.boxes(data)] == [b"ftyp", b"moov"]
    assert len(mp4.find(data, (b"moov", b"trak"))) == 2 and len(mp4.find(data, (b"moov", b"mvex", b"trex"))) == 2
    (a, b), = mp4.find(data, (b"moov", b"mvhd"))
    assert b - a == 100
    at = data.index(b"esds")
    assert mp4.audio_config(data[at + 8 : at - 4 + int.from_bytes(data[at - 4 : at], "big")]) == b"\x11\x90"
    assert b"avcC\1\x64\0\x28" in data and mp4.FREE == b"\0\0\0\x08free"


def test_output_order(spark):
    rng = random.Random(12)
    d = "array<struct<delta:int,used:boolean>>"
    rows, want = [], {}
    for s in ("a", "b"):
        at = 0
        for sequence in range(3):
            pocs = [0] + [p for g in range(1, 17, 4) for p in (g + 3, g + 1, g, g + 2)]  # groups of four, the last first
            for k, p in enumerate(pocs):
                rows.append((s, at, p, [] if k == 0 else [(q - p, True) for q in pocs[max(0, k - 3) : k]], k == 0))
                at += 1
            want.setdefault(s, []).extend((sequence, p) for p in sorted(pocs))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"stream string, decode_idx int, poc int, deltas {d}, resets boolean")
    got = references.output_order(df, 2, 9).collect()
    for s in want:
        mine = sorted((r for r in got if r["stream"] == s), key=lambda r: r["shown"])
        assert [(r["sequence"], r["poc"]) for r in mine] == want[s]
        assert any(r["shown_after"] is None for r in mine) and any(r["shown_after"] is not None for r in mine)


def test_picture_buffer_is_bounded_and_incremental_equals_batch():
    from framewright.functions.buffer import PictureBuffer

    rng = random.Random(3)
    for _ in range(50):
        b, out, n = PictureBuffer(rng.randint(0, 3), rng.randint(8, 16)), [], 0
        recent: list[int] = []
        for p in range(60):
            poc = p ^ 1
            out += b.add(poc, set(recent[-2:]), p == 0)
            recent.append(poc)
            n = max(n, len(b.held))
        out += b.flush()
        assert sorted(out) == [(0, p) for p in range(60)] and n <= b.max_size + 1
        if b.max_reorder:
            assert out == sorted(out)


def test_folds_keep_null_and_large_keys(spark):
    big = 9007199254740993
    rows = [(k, t, 0.5) for k in (big, None, big - 1) for t in range(4)] + [(big, 4, None)]
    got = control.decide(spark.createDataFrame(rows, "k long, t long, x double"), "k", ["t"], "x", 4, 3).collect()
    caps = lambda k: [r["cap"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["t"])]
    assert caps(None) == caps(big - 1) == caps(big)[:4] == [None, 2, 2, 1] and caps(big)[4] == 1
    out = ordered.reorder_batch(spark.createDataFrame([(None, 0, 5), (None, 1, 4), (1, 0, None), (big, 0, big)], "k long, at long, p long"), "k", "at", "p", 1).collect()
    assert sorted(map(str, ((r["k"], r["p"], r["emitted"], r["flushed"]) for r in out))) == sorted(map(str, [(None, 4, 0, False), (None, 5, 1, True), (big, big, 0, True)]))


def test_a_failing_listener_leaves_the_others_alone(spark):
    seen = []

    def fails(batch, n):
        raise RuntimeError("no")

    ordered.publish(fails, lambda batch, n: seen.append((n, batch.count())))(spark.range(3), 7)
    assert seen == [(7, 3)]


def test_operators_take_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, t, t % 4, "x", "y", "z") for t in range(8)], "k long, t long, low long, run string, step string, newest string")
    assert ordering.unwrap_counter(df, ["k"], ["t"], "low", 4, F.lit(True), F.lit(False)).columns == [*df.columns, "full"]
    assert ordering.retained(df, ["k"], "t", F.lit(3)).count() == 4
    assert ordered.current_generation(df, "k", "low").columns == df.columns
