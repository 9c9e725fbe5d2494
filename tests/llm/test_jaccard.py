"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm.jaccard import DEALT, _batch, _prefix, _recurring, _suspects, jaccard_components, join_locally, merge_skip, one_of_each, scan_count

SCHEMA = "doc_id long, text string, n_chars long, key string"


def brute(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return sorted((d, len(s), least.get(x)) for (d, _), s, x in zip(rows, sets, label))


def corpus(seed=1, groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 9, 40, 120, 300]))]
        if g % 3 == 0:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for c in range(rng.choice([1, 2, 5, 15])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.2:
                own = own[: int(len(own) * rng.uniform(0.7, 1))]
            rows.append(" ".join(own).upper() if c % 4 == 3 else " ".join(own))
    rows += ["", "  \n", "one", "ONE", "a b c d", "é è", "É è"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("limits", [{}, {"group_bytes": 9000, "max_bits": 64, "block_bytes": 1 << 26}])
def test_equals_brute_force(spark, limits):
    count = lambda step: " ".join(f"y{i}" if step and i % step == 0 else str(i) for i in range(60_000))
    rows = [*corpus(), (1000, None), (1001, "x " * 50_000), (1002, "x " * 40_000), (1003, count(0)), (1004, count(60)), (1005, count(30))]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r)[:3] for r in jaccard_components(df, **limits).collect())
    assert got == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "z"), (None, "q r s")]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], SCHEMA)
    got = [tuple(r)[:3] for r in jaccard_components(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (7, 1, 7), (None, 1, None)], key=str)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_more_recurring_shingles_than_16_bits_count():
    size = 159_090  # two equal sets of so many, all in one block
    value = np.arange(_prefix(size), dtype=np.uint32)
    place = np.repeat(np.arange(2), len(value)).astype(np.uint16)
    again = _recurring(pa.Table.from_batches([_batch(DEALT, [[0], [0], [place.tobytes()], [np.tile(value, 2).tobytes()]])]))
    known = np.array([1, 2], np.int64).tobytes() + bytes(2) + np.full(2, size, np.int32).tobytes() + bytes(8) + bytes(32)
    meta = _batch(DEALT, [[0], [-1], [np.arange(2).tobytes()], [known]])
    assert _suspects(pa.concat_tables([pa.Table.from_batches([meta]), again])).column("near").to_pylist() == [True, True]


def test_merge_skip_finds_what_is_on_enough_lists():
    rng = random.Random(2)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(0, 25))) for _ in range(rng.randint(1, 12))]
        need = rng.randint(1, len(lists))
        values = [x for own in lists for x in own]
        ends = np.cumsum([len(own) for own in lists]).tolist()
        want = {x: n for x in range(40) if (n := sum(x in own for own in lists)) >= need}
        assert list(scan_count(np.array(values, np.int64), need)) == list(want.items())
        assert list(merge_skip([(e - len(own), e) for own, e in zip(lists, ends)], values, need)) == list(want.items())


def test_one_of_each_with_clashing_names(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (2, base + " more"), (9, "another text of its own with six words"), (None, None), (4, ""), (5, "")]
    df = spark.createDataFrame([(i, t, "k", "o", 1) for i, t in rows], "doc_id long, text string, key string, _key string, component_id int")
    got = one_of_each(df, max_bits=64)
    assert got.columns == df.columns
    assert {(r["doc_id"], r["text"], r["key"], r["_key"]) for r in got.collect()} == {(i, t, "k", "o") for i, t in rows if i != 3}
    assert one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [0, 1 << 40])
def test_groups_of_near_copies_at_the_threshold(dense, monkeypatch):
    monkeypatch.setattr("framewright.llm.jaccard.DENSE", dense)
    rng = np.random.default_rng(4)
    for share in (0.05, 0.2, 0.4):
        base, sets = rng.integers(0, 1 << 62, 80, dtype=np.uint64), []
        for _ in range(70):
            own = base[: rng.integers(60, 81)].copy()
            k = rng.integers(0, int(len(own) * share) + 1)
            own[rng.choice(len(own), k, replace=False)] = rng.integers(0, 1 << 62, k, dtype=np.uint64)
            sets.append(np.unique(own))
        want = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    want[want == want[j]] = want[i]
        groups = lambda x: sorted(tuple(np.flatnonzero(x == v)) for v in set(x.tolist()))
        assert groups(join_locally(sets, np.arange(len(sets)))) == groups(want)
