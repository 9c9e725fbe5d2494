"""Counts of texts and decision lists against plain loops."""

import collections
import random
import re
import zlib

from pyspark.sql import functions as F

from framewright.llm import quality_rules as q
from framewright.llm.shared import MOST, share

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(6)
    out = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x x x x", "x x x", "#|# <> \x0b\x0c\r\n", "é ü 中文   z", "a\nb\na\n\nb \nb ", " lead a b c\ta b c ", "1 2 3!? 1 2 3"]
    out += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(60)]
    out += ["\n".join(rng.choice(("a b c d", "e f", " ", "a b c d ")) for _ in range(rng.randrange(9))) for _ in range(40)]
    return [*out, "word " * 20_000, " ".join(map(str, range(30_000)))]


def test_counts_equal_loops(spark):
    own = texts()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(own)], "doc_id long, text string, bits int, words int")
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in q.counted(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(own)}
    mixed = spark.createDataFrame([(t.split(" "),) for t in own[15:40] if t], "w array<string>")
    for r in mixed.select("w", q._starts(F.col("w"), q._place_bits(F.col("w"))).alias("a"), q._starts_of_mixed(F.col("w")).alias("b")).collect():
        assert len(r["w"]) < 4 or r["a"] == r["b"]


def labelled(n, seed):
    """Documents of low quality have symbols, or words over and over, or both; some labels are wrong, and some documents are short."""
    rng, rows, labels = random.Random(seed), [], []
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        low = rng.random() < 0.3
        if low and i % 2:
            own = [w + "###" if rng.random() < 0.5 else w for w in own]
        elif low:
            own = [w for w in own[: len(own) // 6] for _ in range(6)]
        rows.append((i, " ".join(own)))
        labels.append((i, int(not low)))
    return rows, labels


def test_rules_are_learned_and_tell_held_out_documents(spark):
    rows, labels = labelled(900, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 3], "doc_id long, quality int")
    rules = q.learned_from(docs, known)
    assert 1 <= len(rules) <= 6 and all(r.low >= q.LEAST and r.low >= q.PRECISION * (r.low + r.good) for r in rules)
    assert {c[0] for r in rules for c in r.conditions} <= set(q.STATISTICS)
    want = dict(labels)
    got = [r for r in q.judged(docs, rules).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0]
    assert len(got) > 200
    low = [r for r in got if not want[r["doc_id"]]]
    assert sum(not r["kept"] for r in low) >= 0.97 * len(low)
    good = [r for r in got if want[r["doc_id"]]]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    # the first rule that holds is told, and each says what it covers
    for r in got:
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)
    # what a rule was the first to cover is what it says
    fit = q.judged(docs.join(known, "doc_id").select("doc_id", "text"), rules).groupBy("rule").count().collect()
    assert {r["rule"]: r["count"] for r in fit if r["rule"]} == {r.text(): r.low + r.good for r in rules}


def test_growing_equals_a_plain_search(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        b = [rng.randrange(6) if rng.random() < 0.95 else None for _ in range(3)]
        low = b[0] is not None and b[0] > 2 and b[1] is not None and b[1] <= 3
        rows.append((low if rng.random() < 0.95 else not low, b))
    df = spark.createDataFrame(rows, "low boolean, bins array<int>")

    def covers(rule, b):
        return all(b[c.statistic] is not None and (b[c.statistic] > c.cut if c.above else b[c.statistic] <= c.cut) for c in rule)

    rule, prior = [], sum(x for x, _ in rows) / len(rows)
    while len(rule) < q.MAX_CONDITIONS:
        own = [(x, b) for x, b in rows if covers(rule, b)]
        worth = lambda r: (p := sum(x for x, b in own if covers(r, b)), n := sum(covers(r, b) for _, b in own), (p + q.PRIOR * prior) / (n + q.PRIOR))  # noqa: E731, B023
        if all(x for x, _ in own):
            break
        best, at = None, worth([])[2]
        for s in range(3):
            for cut in range(6):
                for above in (False, True):
                    p, _, w = worth([q.Condition(s, above, cut)])
                    if p >= q.LEAST and w > at + 1e-9:
                        best, at = q.Condition(s, above, cut), w
        if best is None:
            break
        rule.append(best)
    got = q._grown(df)
    assert got == rule and len(rule) >= 2
    assert q._covered(df, got) == [tuple(sum(covers(rule[: k + 1], b) and x == low for x, b in rows) for low in (True, False)) for k in range(len(rule))]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, "b " * 60), (2, "w" + " x y z" * 40), (3, " ".join(map(str, range(80))))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.learned_from(docs, none) == [] and q.judged(docs.limit(0), []).count() == 0
    nulls = spark.createDataFrame([(None, 0), (1, None)], "doc_id long, quality int")
    assert q.learned_from(docs, nulls) == []
    one = spark.createDataFrame([(3, 1), (3, 0), (9, 0)], "doc_id long, quality int")  # the lowest of several labels counts
    assert [tuple(r) for r in q.sampled(one, "doc_id", "quality", 10).orderBy("doc_id").collect()] == [(3, True), (9, True)] and q.learned_from(docs, one) == []
    got = sorted((str(r["doc_id"]), r["n_words"], r["base_failed"], r["kept"]) for r in q.judged(docs, []).collect())
    assert got == [("1", 0, True, False), ("1", 60, True, False), ("2", 121, True, False), ("3", 80, False, True), ("None", 1, True, False)]


def test_samples_of_any_share(spark):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    n = q.sampled(labels, "doc_id", "quality", 400).count()
    assert 300 < n < 500
    assert share(10, 5) == MOST and share(3000, 10**14) == (3000 << 63) // 10**14 > 0
