"""Merkle manifests against recursion over lists."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from framewright.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i % 2, level[i ^ 1] if i ^ 1 < len(level) else None))
        i //= 2
    return out


def plain(rows):
    """(doc_id, leaf): (subroot, root, path), of each row; rows: doc_id, source, lang, n_chars, text."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(((r[0] is not None, r[0] or 0), leaf(r)))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x for _, x in sorted(groups[k])]) for k in order}
    top = tree([trees[k][-1][0] for k in order])
    out = collections.defaultdict(list)
    for g, k in enumerate(order):
        for i, ((there, own), x) in enumerate(sorted(groups[k])):
            out[own if there else None, x].append((trees[k][-1][0], top[-1][0], path(trees[k], i) + path(top, g)))
    return out


def some(n, langs, rng):
    rows = [(i * 3, f"s{i % 4}", rng.choice(langs), i if i % 7 else None, f"text é {i}" if i % 5 else None) for i in range(n)]
    return rows + [(None, None, rng.choice(langs), 5, "no id")] * 2 + [rows[0]] * 3 + [(rows[0][0], "other", rows[0][2], 1, "same id")] if n > 1 else rows


@pytest.mark.parametrize("n, langs, step, sent", [(1, ["en"], 10, 1 << 15), (23, ["en", None, "de", "Ä", "z"], 2, 4), (90, ["en"] * 9 + [None, "fr"], 3, 8), (300, [f"l{i}" for i in range(150)], 4, 16)])
def test_equals_recursion(spark, n, langs, step, sent, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", step)
    monkeypatch.setattr(merkle, "SENT", sent)
    rows = some(n, langs, random.Random(n))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, at long, tree long")
    got = merkle.manifest(docs).proofs().collect()
    want, seen = plain(rows), collections.defaultdict(list)
    for r in got:
        steps = [(int(p["right"]), p["sibling"]) for p in r["path"]]
        seen[r["doc_id"], r["leaf"]].append((r["subroot"], r["root"], steps))
    key = lambda x: repr(x)
    assert len(got) == len(rows) and seen.keys() == want.keys()
    for k in want:
        assert sorted(seen[k], key=key) == sorted(want[k], key=key)


def test_tampered_rows_fail(spark):
    rows = some(200, ["en", "de", None], random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    folder = "/nowhere"
    import framewright.llm.merkle as m

    table, m.table = m.table, lambda *_: docs
    try:
        got = merkle.op13_merkle_manifest(spark, folder).collect()
    finally:
        m.table = table
    for r in got:
        struck = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        own = {x[3] for x in rows if x[0] == r["doc_id"] and leaf(x) == r["leaf"]}
        assert r["verified"] == (not struck or own == {None}) and (r["folded_root"] == r["root"]) == r["verified"]
    assert 0 < sum(not r["verified"] for r in got) < len(got) // 3
    one = plain(rows)
    r = next(r for r in got if r["doc_id"] == 3)
    assert r["proof_sha256"] == sha(*(s for _, s in one[3, r["leaf"]][0][2] if s))


def test_empty_manifest(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs).proofs().count() == 0


def test_levels_and_widths(spark):
    got = spark.range(1, 70).select("id", merkle.levels(F.col("id")).alias("k"), merkle.width(F.col("id"), F.lit(2)).alias("w")).collect()
    assert all(r["k"] == (r["id"] - 1).bit_length() and r["w"] == -(-r["id"] // 4) for r in got)
