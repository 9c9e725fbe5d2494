"""Scans of hot keys and operators on streams against what they do on whole tables, with rows dealt to micro-batches at random."""

import random

import pytest
from pyspark.sql import functions as F

from framewright.operators import control, lookup, ordering, scans
from framewright.scratch import folder
from framewright.sources import annexb, streams, tables
from framewright.streaming import metrics, ordered, stateful

HOW = {"bucket_ms": 10_000, "idle_ms": 600_000}


def same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    rows = lambda d: sorted(map(repr, d.select(*names).collect()))
    got, want = rows(a), rows(b)
    assert got == want
    return len(got)


@pytest.fixture(scope="module")
def events(spark):
    """Streams of one hot, one small and one null key; times ascend with at, some are equal."""
    rng, rows = random.Random(9), []
    for at in range(900):
        k = rng.choice((1, 1, 1, 1, 2, None))
        rows.append((k, at, at // 3 * 2, rng.choice(("a", "b", "c", "c")), rng.choice((None, 0.4, 0.9, 1.1, 1.6, 3.0)), rng.randrange(16)))
    df = spark.createDataFrame(rows, "k long, at long, s long, kind string, x double, low int")
    return df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000))


def test_scans_in_parts_equal_windows(spark, events):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # eight parts
    try:
        parts = scans.Parts(events, ["k"], ["at"])
        assert parts.rows.select(parts.part).distinct().count() > 4
        w, k, at = F.col("kind") == "a", ["k"], ["at"]
        assert same(scans.sequence_number(events, k, at, w), ordering.sequence_number(events, k, at, w)) == 900
        same(scans.inherit(events, k, at, F.col("x"), "y"), lookup.inherit(events, k, at, F.col("x"), "y"))
        same(scans.numbered(events, k, at, "n"), ordering.display_order(events, k, at, "n").withColumn("n", F.col("n").cast("long") - 1))
        for reset in (w, F.lit(False)):
            args = (events, k, at, "low", 16, F.col("kind") != "b", reset)
            same(scans.unwrap_counter(*args), ordering.unwrap_counter(*args))
        facts, versions = events.filter("kind = 'c'").select("k", "at", "low"), events.filter("kind <> 'c'").select("k", "at", "x", "kind")
        assert same(scans.as_of(facts, versions, k, at, ["x", "kind"]), lookup.as_of(facts, versions, k, at, ["x", "kind"])) > 300
        ties = versions.unionByName(facts.select("k", "at", F.lit(7.0).alias("x"), F.lit("tie").alias("kind")))  # at equal places they aren't seen
        same(scans.as_of(facts, ties, k, at, ["kind"]), lookup.as_of(facts, ties, k, at, ["kind"]))
        assert scans.inherit(events.limit(0), k, at, F.col("x"), "y").count() == 0
        assert scans.as_of(facts.select("k", "at"), versions, k, at, ["x"]).columns == ["k", "at", "asof_x"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def dealt(spark, df, at, batches, seed, late=0):
    """df as a stream of micro-batches cut at random places of its order; each batch's rows are shuffled, and some come up to `late` rows later than they should."""
    rng, path = random.Random(seed), folder(spark)
    n = df.count()
    cuts = sorted(rng.sample(range(1, n), batches - 1))
    numbered = df.withColumn("_place", F.row_number().over(stateful_window(at)) + (F.rand(seed) * late).cast("int"))
    for a, b in zip([-1, *cuts], [*cuts, n + late + 1]):
        numbered.filter((F.col("_place") > a) & (F.col("_place") <= b)).drop("_place").orderBy(F.rand(seed)).coalesce(1).write.mode("append").parquet(path)
    values = {"ts": "2999-01-01", "k": -1}  # so that a watermark passes all else
    last = [F.lit(values.get(c)).cast(t).alias(c) for c, t in df.dtypes]
    spark.range(1).select(*last).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "20 seconds")


def stateful_window(at):
    from pyspark.sql import Window

    return Window.orderBy(at)


def test_streams_equal_tables_however_they_are_cut(spark, events):
    df = events.withColumn("p", F.col("at").bitwiseXOR(F.lit(3).cast("long")))
    play = lambda seed: dealt(spark, df, "at", 3 + seed, seed, late=5)
    run = stateful.collected
    assert same(run(stateful.reordered(play(1), "k", "ts", "at", "p", 4, **HOW)), ordered.reorder_batch(df, "k", "at", "p", 4)) == 900
    want = control.decide(df, "k", ["at"], "x", 4, 3)
    assert same(run(stateful.decided(play(2), "k", "ts", "at", "x", 4, 3, **HOW)).filter("at is not null"), want) == 900


def test_caches_and_generations_on_streams(spark, events):
    df = events.withColumn("content", F.concat("kind", "low")).withColumn("content", F.when(F.col("low") > 2, F.col("content")))
    got = stateful.collected(stateful.cached(dealt(spark, df, "at", 3, 5), "content", "ts", "at", "at", **HOW)).filter("at is not null")
    assert same(got, lookup.cached(df, "content", ["at"], "at").select("at", "made_for")) == 900
    got = {(r["k"], r["at"]) for r in stateful.collected(stateful.current(dealt(spark, df, "at", 3, 6), "k", "ts", "at", "low", **HOW)).collect()}
    want, top = set(), {}
    for r in sorted(events.collect(), key=lambda r: r["at"]):
        if r["low"] >= top.get(r["k"], 0):
            top[r["k"]] = r["low"]
            want.add((r["k"], r["at"]))
    assert got == want


def test_a_key_that_is_idle_ends_and_starts_anew(spark):
    rows = [(1, t, t, 9 - t) for t in range(4)] + [(1, t, t + 2000, t) for t in range(4, 8)]
    df = spark.createDataFrame(rows, "k long, at long, s long, p long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s")
    got = stateful.collected(stateful.reordered(dealt(spark, df, "at", 2, 1), "k", "ts", "at", "p", 10, bucket_ms=1000, idle_ms=60_000)).collect()
    assert sorted((r["p"], r["emitted"], r["flushed"]) for r in got) == sorted([(6, 0, True), (7, 1, True), (8, 2, True), (9, 3, True), (4, 0, True), (5, 1, True), (6, 2, True), (7, 3, True)])


def test_held_back_queue_is_bounded_and_in_order(spark, events):
    df = events.select("k", "at", "ts", (F.col("kind") == "a").alias("done"))
    table = stateful.held_back(df, "k", "at", "done", 2)
    rows = table.collect()
    assert all(1 <= r["busy"] <= 2 for r in rows) and len(rows) == df.filter("not done").count()
    for k in (1, 2, None):
        mine = sorted((r for r in rows if r["k"] == k), key=lambda r: r["at"])
        let_go = [r["released_at"] for r in mine if r["released_at"] is not None]
        assert let_go == sorted(let_go) and all(r["released_at"] is None for r in mine[len(let_go) :]) and all(r["released_at"] >= r["at"] for r in mine[: len(let_go)])
    got = stateful.collected(stateful.held_back_stream(dealt(spark, df, "at", 4, 3), "k", "ts", "at", "done", 2, **HOW)).filter("at is not null")
    same(got, table)


def test_correlated_streams(spark):
    ask = spark.createDataFrame([(i, i * 10) for i in range(40)] + [(None, 5)], "id long, t long")
    answer = spark.createDataFrame([(i, i * 10 + 1 + i % 4 * 3) for i in range(0, 40, 2)] + [(i, i * 10 + 2) for i in range(0, 40, 4)] + [(99, 7), (None, 6)], "id long, t long")
    when = lambda df, name: df.select("id", F.timestamp_seconds(F.col("t") + 1_000_000).alias("ts"), F.col("t").alias(f"t_{name}"))
    a, b = dealt(spark, when(ask, "ask"), "ts", 3, 1), dealt(spark, when(answer, "answer"), "ts", 4, 2)
    a, b = a.withColumnRenamed("ts", "asked"), b.withColumnRenamed("ts", "answered")
    got = stateful.collected(stateful.correlated(a, b, "id", "asked", "answered", "5 seconds")).filter("t_ask is not null").collect()
    assert len(got) == 41 and {r["id"] for r in got if not r["pending"]} == {i for i in range(0, 40, 2) if 1 + i % 4 * 3 <= 5 or i % 4 == 0}
    assert all(r["t_answer"] - r["t_ask"] <= 5 for r in got if not r["pending"]) and [r["pending"] for r in got if r["id"] is None] == [True]


def test_observed_metrics(spark, events):
    got = metrics.observed(dealt(spark, events, "at", 4, 2), "seen", {"n": F.count("at"), "most": F.max("at")}).collect()
    assert sum(r["n"] for r in got) == 900 and max(r["most"] for r in got if r["most"] is not None) == 899 and len(got) == 5


def test_followed_units_are_read_once(spark, tmp_path):
    """A file that grows, a query that stops and starts again, and little admitted at a time."""
    unit = lambda i: b"\0\0\1" + bytes([2, 1]) + b"%d;" % i
    source = tmp_path / "in"
    source.mkdir()
    streams.register(spark)
    done = 0

    def grow(a, b):
        with open(source / "a.265", "ab") as f:
            f.write(b"".join(unit(i) for i in range(a, b)))

    def run(final=False):
        reader = spark.readStream.format("units").option("admitted", str(tmp_path / "admitted")).option("maxBytes", 100).option("splitBytes", 64)
        q = reader.option("final", str(final).lower()).load(str(source)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q = q.option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(int(bytes(r["rbsp"])[:-1]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    grow(0, 20)
    first = run()
    assert first == list(range(len(first))) and 0 < len(first) <= 19  # the last unit may go on
    grow(20, 60)
    done = run()
    assert done == list(range(len(done))) and len(done) > len(first)
    (source / "b.265").write_bytes(b"".join(unit(i) for i in range(60, 80)))
    for _ in range(12):
        got = run(final=True)
        if len(got) >= 80:
            break
    assert got == list(range(80))
    with pytest.raises(Exception, match="admitted"):
        spark.readStream.format("units").option("maxBytes", 10).load(str(source)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).start().processAllAvailable()


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(1, bytearray(b"\0\2ab\0\1c\0\x09x")), (2, None), (3, bytearray())], "k int, data binary").createOrReplaceTempView("t")
    got = spark.sql("SELECT k, i, unit FROM t, LATERAL length_prefixed(data, 2)").collect()
    assert sorted((r["k"], r["i"], bytes(r["unit"])) for r in got) == [(1, 0, b"ab"), (1, 1, b"c")]
    assert spark.sql("SELECT * FROM t, LATERAL parameter_sets(data)").count() == spark.sql("SELECT * FROM t, LATERAL audio_config(data)").count() == 0
    with pytest.raises(Exception, match="1, 2 or 4"):
        spark.sql("SELECT * FROM t, LATERAL length_prefixed(data, 3)").collect()
    with pytest.raises(Exception, match="columns key, at and content"):
        spark.sql("SELECT * FROM stream_digest(TABLE(t))").collect()
    spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), (5, 1, None)], "key int, at int, content string").createOrReplaceTempView("d")
    got = {r["key"]: (r["digest"], r["bytes"]) for r in spark.sql("SELECT * FROM stream_digest(TABLE(d))").collect()}
    assert got == {None: ("187ef4436122d1cc2f40dc2b92f0eba0", 2), 5: ("d41d8cd98f00b204e9800998ecf8427e", 0)}
    assert annexb.length_prefixed(b"\1a", 1) == [b"a"]


def test_played_batches_are_many_files_and_come_whole(spark, monkeypatch):
    """Two of three micro-batches are cut in files; the last one has fewer rows than files, and still comes alone."""
    monkeypatch.setattr(stateful, "FILE_ROWS", 25, raising=False)
    df = spark.range(300).select("id", F.timestamp_seconds(F.least(F.col("id"), F.lit(150)) + F.when(F.col("id") > 297, 5).otherwise(0) + 1_000_000).alias("ts"))
    path, seen = folder(spark), []
    stream = stateful.played(df, "ts", 3)
    files = stream.select("id", F.input_file_name().alias("file"))

    def each(batch, number):
        got = batch.groupBy("file").count().collect()
        seen.append((sum(r["count"] for r in got), max((r["count"] for r in got), default=0)))

    files.writeStream.foreachBatch(each).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    edges = sorted(r["ts"] for r in df.collect())
    assert sum(n for n, _ in seen) == 301 and seen[-1] == (1, 1) and [n for n, _ in seen[:-1]] == _sizes(df, edges, 3)
    assert max(most for _, most in seen) <= 75 and len(seen) == 4 and seen[2][0] < 4


def _sizes(df, times, batches):
    cuts = df.select(F.percentile_approx("ts", [k / batches for k in range(1, batches)], 10_000).alias("q")).first()["q"]
    return [sum((a is None or t > a) and (b is None or t <= b) for t in times) for a, b in zip([None, *cuts], [*cuts, None])]


class Kept(dict):
    """Map state that counts the rows written to it."""

    written = 0

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self.get(k)

    def updateValue(self, k, v):
        self[k] = v
        if isinstance(v[0], list):
            Kept.written += len(v[0])

    def removeKey(self, k):
        del self[k]


def test_waiting_rows_are_written_once():
    """Rows of one bucket that come in many parts, as a growing stream's do, and what a timer then makes of them."""

    class Handle:
        timers: set = set()

        def getMapState(self, *a):
            return Kept()

        def getValueState(self, *a):
            class Value:
                got = None
                exists = lambda self: self.got is not None
                get = lambda self: self.got

                def update(self, v):
                    self.got = v

            return Value()

        def registerTimer(self, at):
            self.timers.add(at)

    class At:
        getExpiryTimeInMs = staticmethod(lambda: 1000)

    p = stateful._Folding(stateful.First, ["v0", "v1"], "v0: long, v1: long", 1, ["own", "first"], 1000, 5000)
    p.init(Handle())
    Kept.written = 0
    for a in range(0, 6000, 300):
        list(p.handleInputRows(("k",), iter([{"_ms": 5, "v0": 5999 - i, "v1": i} for i in range(a, a + 300)]), None))
    assert Kept.written == 6000 and Handle.timers == {1000, 6000}
    assert [tuple(r) for r in p.handleExpiredTimer(("k",), None, At)] == [(5999 - i, 5999) for i in range(6000)]
    assert not p.waiting and list(p.handleExpiredTimer(("k",), None, At)) == []
