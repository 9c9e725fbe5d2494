"""The text operators against brute force, and on odd tables."""

import binascii
import hashlib
import itertools
import random
import re
import sys
import textwrap
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import bloom
from framewright.llm.decontaminate import find_benchmark, normal, without_benchmark
from framewright.llm.edits import best_ending, masks, within
from framewright.llm.exact_dedup import exact_dedup
from framewright.llm.html_text import NAMES, blocks_of, extract_text, trained
from framewright.llm.language_id import identified, predict_language
from framewright.llm.licenses import TEMPLATES, scan_licenses
from framewright.llm.line_dedup import line_repeats, op5_line_dedup, repeated_lines, without_lines
from framewright.llm.packing import Words, best_two_fit, cut, pack_documents
from framewright.llm.toxicity import score_toxicity
from framewright.llm.url_filter import RULES, Rule, build_cascade, url_filter

# columns that an operator doesn't want, with names that it uses itself
DOCS = "doc_id long, text string, lang string, n_chars long, key string, rid string, line_no int, score string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", len(t or ""), "k", "r", 1, "s") for i, t in rows], DOCS).repartition(parts)


ODD = [(1, None), (2, ""), (3, "  \n\n "), (None, "some words here"), (4, "one"), (4, "one"), (5, "x" * 300_000), (6, "a b\n" * 30_000)]


# -- edit distances


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def best_part(p, t):
    r = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        q = [i]
        for j, y in enumerate(t, 1):
            q.append(min(r[j] + 1, q[-1] + 1, r[j - 1] + (x != y)))
        r = q
    return min(r)


def edited(rng, s, n, letters="abc"):
    b = list(s)
    for _ in range(n):
        i, kind = rng.randint(0, len(b)), rng.randint(0, 2)
        if kind == 0 or i == len(b):
            b.insert(i, rng.choice(letters))
        elif kind == 1:
            del b[i]
        else:
            b[i] = rng.choice(letters)
    return "".join(b)


def test_edit_distances():
    rng = random.Random(3)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        b, k = edited(rng, a, rng.randint(0, 5)), rng.randint(0, 5)
        assert within(a, b, k) == (lev(a, b) <= k)
        assert best_ending(masks(a), len(a), b)[0] == best_part(a, b)


# -- op1


def test_bloom_and_cascade_are_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("cast(substring(key, 2) as int) % 7 = 0")
    c = build_cascade(listed, universe, 3000)
    assert len(c.levels) > 2
    got = universe.withColumn("in", c.contains(F.col("key"))).filter("in <> (cast(substring(key, 2) as int) % 7 = 0)")
    assert got.count() == 0
    small = bloom.build(listed, "key", 429, 0.01, 0, max_bits=64)
    assert small.m == 64 and listed.filter(~small.might_contain(F.col("key"))).count() == 0


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://", "https://Example.COM/en/7?x", "https://a.example.com/en/6/y", "https://example.com/en/", "https://x.net/de/8",
        "https://b.example.net/de/81#t", "https://notexample.net/de/8", "ftp://c.org/es/", "https://org/es/", "https://c.org?/es/", "https://c.org/a://b.com/en/", "http://c.com\n/en/1", "http://éx.com/en/",
    ]

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
        fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.key), len(r.host)), default=None)
        return host, path, best.key if best else None, best.verdict if best else "allow"

    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string, rule string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(df).collect()}
    assert got == {(i, *want(u)) for i, u in enumerate([*urls, *urls])}
    assert url_filter(df.limit(0)).count() == 0
    table = spark.createDataFrame([(r.verdict, r.host, r.path, 1) for r in RULES], "verdict string, host string, path string, n int")
    parted = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(df, table, max_bits=64).collect()}
    assert parted == got
    assert url_filter(df, []).filter("verdict = 'allow' and rule is null").count() == df.count()
    none = url_filter(df, [Rule("block", "nowhere.test", "/")])
    assert none.filter("verdict = 'allow' and rule is null").count() == df.count()


def test_url_filter_by_its_contract(spark):
    """The rules' words as the contract lists them, and the verdicts and rules that follow."""
    assert [(r.verdict, r.key) for r in RULES] == [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    told = {
        "http://a.com/en/6": ("com/en/", "block"), "http://b.example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://b.Example.net/de/81?x": ("example.net/de/8", "block"), "http://org/es/": ("org/es/", "block"), "http://a.net/en/": (None, "allow"),
    }
    got = url_filter(spark.createDataFrame([(0, u) for u in told], "page_id long, url string")).collect()
    assert {r["url"]: (r["rule"], r["verdict"]) for r in got} == told


# -- op2


@pytest.mark.parametrize("bits", [bloom.MAX_BITS, 64])
def test_exact_dedup(spark, bits):
    rows = [*ODD, *((i, f"text {i % 40}") for i in range(100, 300)), (None, None), (9, "One"), (10, "one")]
    got = exact_dedup(docs(spark, rows), max_bits=bits).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    of = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in got:
        g = of[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["keep_id"] == max((x for x in g if x is not None), default=None)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup(docs(spark, [])).count() == 0


# -- op3


def test_words_encode_like_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    own, ref = Words(public_tokenizers.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    bits = ["a", "the", "Ünï", "x1", "42", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u3000", "!", "###", "日本", "🙂", ".", "\r\n", "\x1c", "_"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(x) for n in range(7) for x in itertools.product("a \t\n", repeat=n)]
    texts += ["Name\tAge  City", "x\ty ", "a\u00a0b  c", "a<|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|>  y", "!\x1c?\x85 z", "word " * 300 + "\n" * 700]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ref.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_take_bounded_memory(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(Words, "LIMIT", 1000)
    path, rng = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(3)
    own = Words(path)
    parts = [" " + "".join(map(chr, rng.choices(range(0x4E00, 0x9000), k=n))) for _ in range(500) for n in (1, 5, 250)]  # long ones take 4 kB with their ids
    once, again = own.encode("".join(parts)), own.encode("".join(parts))
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in own.items()) <= 310 * 1000
    assert once == again == b"".join(map(Words(path).encode, parts))

    text = "word\t a " * 600_000
    tracemalloc.start()
    got = own.encode(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(got) + (16 << 20)
    monkeypatch.setattr(Words, "BLOCK", 1 << 40, raising=False)
    assert got == own.encode(text)


def test_cut():
    assert cut(1, 5) == [(0, 1)] and cut(5, 5) == [(0, 5)] and cut(12, 5) == [(0, 2), (2, 5), (7, 5)] and cut(10, 5) == [(0, 5), (5, 5)]


def test_best_two_fit_packs_all_and_nearly_best():
    rng = random.Random(5)
    for _ in range(60):
        cap = rng.choice([10, 50, 200])
        counts = [0] + [rng.choice([0, 0, 1, 2, 30]) for _ in range(cap)]
        left = list(counts)
        bins = 0
        for contents, times in best_two_fit(counts, cap):
            assert sum(n * c for n, c in contents) <= cap and times > 0
            bins += times
            for n, c in contents:
                left[n] -= c * times
        assert not any(left)
        rooms = []  # first-fit decreasing, piece by piece
        for n in range(cap, 0, -1):
            for _ in range(counts[n]):
                i = next((i for i, r in enumerate(rooms) if r >= n), None)
                if i is None:
                    rooms.append(cap - n)
                else:
                    rooms[i] -= n
        assert bins <= len(rooms) * 1.06 + 2


def piecewise(lengths, cap):
    """Best-two-fit with one piece after the other: what each bin holds, as sorted lengths."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        own = []

        def fitting(room):
            return next((n for n in left if n <= room), None)

        while (n := fitting(cap - sum(own))) is not None:
            left.remove(n)
            own.append(n)
        if sum(own) < cap and len(own) > 1:
            gap, best, pair = cap - sum(own) + min(own), min(own), None
            for a in sorted(set(left), reverse=True):
                rest = list(left)
                rest.remove(a)
                b = next((n for n in rest if n <= min(gap - a, a)), None)
                if a < gap and b and a + b > best:
                    best, pair = a + b, (a, b)
            if pair:
                left.append(min(own))
                own.remove(min(own))
                for n in pair:
                    left.remove(n)
                    own.append(n)
                left.sort(reverse=True)
        out.append(sorted(own))
    return sorted(out)


def test_best_two_fit_packs_like_piece_by_piece():
    rng = random.Random(12)
    for _ in range(150):
        cap = rng.choice([7, 20, 60])
        counts = [0] + [rng.choice([0, 0, 1, 2, 7]) for _ in range(cap)]
        got = [sorted(n for n, c in contents for _ in range(c)) for contents, times in best_two_fit(counts, cap) for _ in range(times)]
        assert sorted(got) == piecewise([n for n, c in enumerate(counts) for _ in range(c)], cap)


@pytest.mark.parametrize("cell", [1 << 20, 3])
def test_packing(spark, cell):
    rows = [*ODD, *((100 + i, "word " * (i * 37 % 500)) for i in range(80)), (7, "tab\tand  runs "), (8, "<|endoftext|>"), (8, "same id")]
    got = pack_documents(docs(spark, rows), cell=cell).collect()
    pieces, seqs = {}, {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        ids = np.array([*ref.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (start, n) in enumerate(cut(len(ids), 2048)):
            want.setdefault((i, k), []).append((start, n, binascii.crc32(ids[start : start + n].tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert pack_documents(docs(spark, [])).count() == 0


# -- op4


def test_decontamination(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(25)]
    rows = []
    for i in range(120):
        body = [word() for _ in range(rng.randint(0, 60))]
        if i % 3:
            t = edited(rng, rng.choice(items)[1], rng.choice([0, 2, 5, 9, 14]))
            body.insert(rng.randint(0, len(body)), t.upper() if i % 2 else t)
        rows.append((i, "\n ".join(body)))
    rows.append((500, "most of it"))
    bench = spark.createDataFrame([*items, (90, None), (91, "Of  it"), (92, items[0][1]), (93, " \n")], "item_id long, text string")
    wanted = [*items, (91, "of it"), (92, items[0][1])]
    found = lambda t: {(k, best_part(normal(x), normal(t))) for k, x in wanted if best_part(normal(x), normal(t)) <= int(0.05 * len(normal(x)))}
    hits = {i: found(t) for i, t in rows}
    odd = [(1000 + n, t) for n, (_, t) in enumerate(ODD)]
    want = {(i, *h) for i, hs in hits.items() for h in hs}
    df = docs(spark, [*rows, *odd])
    texts, of = dict(wanted), {i: normal(t or "") for i, t in [*rows, *odd]}
    for block in (8_000_000, 1500):
        found = find_benchmark(df, bench, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found} == want and (500, 91, 0) in want
        assert all(lev(of[r["doc_id"]][r["start"] : r["start"] + r["length"]], normal(texts[r["item_id"]])) == r["distance"] for r in found)
        clean = without_benchmark(df, bench, block_chars=block)
        assert clean.columns == df.columns
        assert sorted(r["doc_id"] for r in clean.collect()) == sorted([*(i for i in hits if not hits[i]), *(i for i, _ in odd)])
    assert find_benchmark(docs(spark, []), bench).count() == 0 and find_benchmark(docs(spark, rows), bench.limit(0)).count() == 0


# -- op5


@pytest.mark.parametrize("bits,group", [(bloom.MAX_BITS, 4096), (64, 2)])
def test_line_dedup(spark, bits, group):
    rng = random.Random(9)
    line = lambda: "".join(rng.choice("abcd é") for _ in range(rng.randint(10, 60)))
    pool = [line() for _ in range(60)]
    rows = [(i, "\n".join(edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 3, 4]), "abcd") for _ in range(rng.randint(0, 6)))) for i in range(70)]
    rng.shuffle(rows)
    rows += [(500, None), (501, ""), (502, "\n\n")]
    placed = sorted((i, n, x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if len(x) >= 20)
    want = set()
    for k, (i, n, x) in enumerate(placed):
        first = next(((j, m) for j, m, y in placed[:k] if within(x, y, 2)), None)
        if first:
            want.add((i, n, *first))
    df = docs(spark, rows)
    assert {tuple(r) for r in repeated_lines(df, min_chars=20, max_bits=bits, group=group).collect()} == want and len(want) > 20
    found = line_repeats(df, min_chars=20, max_bits=bits, group=group)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in without_lines(df, found, max_bits=bits).collect()}
    gone = {(i, n) for i, n, *_ in want}
    for i, t in rows:
        if any(a == i for a, _ in gone):
            left = "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
            assert (i in got) == bool(left.strip()) and (i not in got or got[i] == (left, len(left)))
        else:
            assert got[i][0] == t
    assert repeated_lines(docs(spark, ODD)).count() == 0
    assert repeated_lines(docs(spark, [])).count() == 0


def test_lines_go_from_their_own_row(spark):
    long = "this line of more than forty characters is here twice"
    rows = [(1, long), (2, f"{long}\nand this is another line of the first row with the id two"), (2, "what stands here is nowhere else, though the id is used again\n" + long), (3, None)]
    df = spark.createDataFrame([(i, t, 9, "a", "b", 7) for i, t in rows], "doc_id long, text string, n_chars int, _lines string, key string, gone int")
    got = without_lines(df, line_repeats(df))
    assert got.columns == df.columns and got.dtypes == df.dtypes
    second, third = rows[1][1].split("\n")[1], rows[2][1].split("\n")[0]
    assert {(r["doc_id"], r["text"], r["n_chars"], r["_lines"], r["gone"]) for r in got.collect()} == {(1, long, 9, "a", 7), (2, second, len(second), "a", 7), (2, third, len(third), "a", 7), (3, None, 9, "a", 7)}


def test_line_keys_of_long_and_wide_lines():
    """Keys of a line of its own path (longer than a slab) and of lines side by side are the same."""
    from framewright.llm import line_dedup as own

    lines = ["é" * 50 + "x" * 700_000 + "日本" * 300_000, "short and ascii", "ünï" * 20, "z" * 70_000]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in lines]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    both = own._Lines(np.concatenate(raw), ends)
    spots = [(0, 49, 3), (0, 700_000, 100_000), (1, 0, 5), (2, 1, 7), (3, 69_000, 1000), (3, 5, 65_000)]
    assert both.total is None
    for i, start, size in spots:
        single = own._Lines(raw[i], np.array([0, len(raw[i])]))
        at = np.array([i]), np.array([start]), np.array([size])
        part = np.frombuffer(lines[i][start : start + size].encode(), np.uint8)
        whole = own._Lines(part, np.array([0, len(part)])).hashes(np.array([0]), np.array([0]), np.array([size]))
        assert both.hashes(*at) == single.hashes(np.array([0]), *at[1:]) == whole
    counts = lambda t: [sum(b & 15 == k for b in (c.encode()[-1] for c in t)) & 15 for k in range(16)]
    assert [[int(x) >> 4 * k & 15 for k in range(16)] for x in both.letters()] == [counts(t) for t in lines]


def test_line_dedup_of_short_equal_lines(spark, tmp_path):
    rows = [(1, "ab\n\n  \nShort line.\nAnd."), (2, "And.\nShort line\n  \n"), (3, "Short line.\nab\nx" + "y" * 50), (4, "x" + "y" * 51 + "\nAnd.")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(2, 0, 1, 4), (3, 0, 1, 3), (3, 1, 1, 0), (4, 0, 3, 2), (4, 1, 1, 4)}


# -- op6


def test_toxicity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ra", "ti", "en", "ol", "mus"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randint(0, len(w)), "grub" + word())
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    df, marks = docs(spark, [*rows, *ODD[:4]]), spark.createDataFrame([*labels, (3, 1, 0), (None, 1, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    for few in (2_000_000, 1):
        got = score_toxicity(df, marks, broadcast_rows=few).collect()
        assert len(got) == 904 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
        held = [r for r in got if r["held_out"] and r["doc_id"] is not None]
        assert {r["doc_id"] for r in held} == {i for i, _ in [*rows, *ODD[:3]] if zlib.crc32(str(i).encode()) % 5 == 0}
        assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held if r["doc_id"] > 6) >= 0.95 * len([r for r in held if r["doc_id"] > 6])
    assert score_toxicity(df, marks.limit(0)).filter("score <> 0 or predicted <> 0").count() == 0
    assert score_toxicity(df.limit(0), marks).count() == 0


def test_toxicity_keeps_all_grams_of_a_large_model(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ra", "ti", "en", "ol", "mus", "é"]) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join([word() for _ in range(rng.randint(5, 60))] + ["grub" + word()] * (i % 4 == 0))) for i in range(400)]
    df = docs(spark, [*rows, *ODD[:4], rows[7]])
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    of = lambda most, ask: sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 9), r["predicted"]) for r in score_toxicity(df, marks, max_grams=most, ask_bytes=ask).collect())
    assert of(200, 1 << 26) == of(200, 1 << 40) == of(600_000, 1)


# -- op7


def test_html_extraction(spark):
    pages = [
        (1, "u", None), (2, None, ""), (3, "u", "no tags at all, just one plain sentence."), (4, "u", "<div"), (5, "u", "<script>var a = '<p>x</p>';</script>"),
        (6, "u", "<html><body><nav><ul><li><a href='/'>home</a></li><li><a>about us</a></li></ul></nav><article><h1>A &amp; B</h1><p>First   paragraph,\n with <b>bold</b> text &eacute;.<p>Second one, which is longer than it was.</article><footer>&copy; us</footer></body></html>"),
        (7, "u", "<main>" + "<p>Word after word, and more of them.</p>" * 5000 + "</main>"),
    ]
    df = spark.createDataFrame([(*p, "t", 3) for p in [*pages, pages[5]]], "page_id long, url string, html string, text string, n_chars int")
    got = [r for r in extract_text(df).collect()]
    of = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 8 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert of[1] == of[2] == of[4] == of[5] == "" and of[3].startswith("no tags")
    assert of[6] == "A & B\nFirst paragraph, with bold text é.\nSecond one, which is longer than it was."
    assert of[7].count("\n") == 4999
    assert extract_text(df.limit(0)).count() == 0


def test_html_text_after_odd_tags():
    of = lambda page: [b.text for b in blocks_of(page)]
    assert of("<p>one <svg width='1' /> two</p><p>three</p>") == ["one two", "three"]
    assert of("<p>one <svg><title>t</title><text>x</text></svg> two</p><template><div>x</div></template><p>three</p>") == ["one two", "three"]
    assert of("<div><p>one</p><svg><g><p>two</p></div><div><template><b>x</div><p>three</p>") == ["one", "two", "three"]
    assert of("<article><object data='a'><p>one</p></article><p>two</p>") == ["one", "two"]
    assert of("<iframe title='a>b' src=\"x\"/><p>one</p><script src=/a/>var x</script><title-card>two</title-card>") == ["one", "two"]
    assert of("<p>one</p><3 apples") == ["one", "<3 apples"] and of("<p>one</p><div class='x") == ["one"]


def test_html_of_deep_nesting_is_read_in_time_that_grows_with_it():
    n = 20_000
    began = time.process_time()
    assert len(blocks_of("<p>" + "<b>x " * n)) == 1
    assert len(blocks_of("<div>x" * n + "</span>" * n)) == n
    assert time.process_time() - began < 10


def test_the_likeliest_labels_are_found():
    rng, field = np.random.default_rng(1), trained(60)
    for _ in range(200):
        x = rng.normal(size=(rng.integers(1, 8), len(NAMES))) / 2
        s = x @ field.state
        total = lambda y: sum(a[k] for a, k in zip(s, y)) + sum(field.change[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(field.decode(x)) == max(itertools.product((0, 1), repeat=len(x)), key=total)


# -- op8


def test_license_scan(spark):
    rows = [*ODD, (20, "some text\nReleased under the MIT License.\nmore"), (21, "Licensed under CC BY-NC 4.0."), (22, "All rights reserved."), (23, "his driving license was old\nthe rights of man"), (24, "licensed under the apache license, version 2.0"), (24, "licensed under the apache license, version 2.0")]
    got = sorted((r["doc_id"], r["line_no"], r["family"], r["confirmed"]) for r in scan_licenses(docs(spark, rows)).collect())
    assert got == [(20, 1, "MIT", True), (21, 0, "CC", True), (22, 0, "proprietary", True), (24, 0, "Apache", True), (24, 0, "Apache", True)]
    assert scan_licenses(docs(spark, [])).count() == 0


def test_licenses_wrapped_at_any_width(spark):
    prose = "he went along the river and saw that it was good."
    rows, want = [], {}
    for family, texts in TEMPLATES.items():
        for x in texts:
            for width in (60, 72, 80, 10_000):
                own = textwrap.wrap(x, width, break_long_words=False, break_on_hyphens=False)
                want[len(rows)] = (family, x, 2, 1 + len(own))
                rows.append((len(rows), "\n".join([prose, prose, *own, "", prose])))
    rows.append((len(rows), "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0"))
    got = {}
    for r in scan_licenses(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["family"], r["template"], r["line_no"], r["last_line_no"], r["confirmed"]))
    assert sorted(x[0] for x in got.pop(len(rows) - 1)) == ["Apache", "MIT"]
    assert {k: v for k, v in got.items() if v != [(*want[k], True)]} == {}
    assert got.keys() == want.keys()


# -- op10


def test_language_id(spark):
    rng = random.Random(6)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["üx", "tz", "sch"], "cc": ["по", "ка", "жи"]}
    text = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(1, 40)), lang) for i in range(300) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(400, None, "aa"), (401, "123 ... ²", "aa"), (402, "", "bb"), (None, text("bb", 9), "bb"), (403, text("cc", 5), None), (404, text("aa", 60_000), "aa")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, score string, held_out string").repartition(3)
    got = {r["doc_id"]: r for r in predict_language(df).collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows:
        r = got[i]
        assert 0 <= r["score"] <= 1 and r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if i in (400, 401, 402):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif lang:
            assert r["lang_pred"] == lang
    assert got[403]["lang_pred"] == "cc"
    few = predict_language(df, rows_per_lang=40)
    assert few.filter("lang_pred <> 'und'").count() == len(rows) - 3
    odd = spark.createDataFrame([(900, "नमस्ते दुनिया, यह किसी भी सीखी हुई भाषा में नहीं है।", None, "x", "y"), (901, "क", None, "x", "y")], df.schema)
    left = identified(df.unionByName(odd))
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {i for i, *_ in rows if i not in (400, 401, 402)} | {901}
    assert predict_language(df.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0
    assert predict_language(df.limit(0)).count() == 0


def test_a_share_below_a_millionth_still_draws(spark, monkeypatch):
    """As of tables of many billions of rows: what is drawn for the fit is little, but never nothing."""
    from framewright.llm import language_id, toxicity

    for m in (language_id, toxicity):
        monkeypatch.setattr(m, "share", lambda rows, n: (rows << 63) // (n * 10**12))
    rows = [(i, ("the quick brown fox and the lazy dog " if i % 2 else "der schnelle braune fuchs und der faule hund ") * 5, "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict_language(docs, rows_per_lang=10).collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in got)
    texts = [(i, ("kind words for all " if i % 2 else "vile foul rotten ") * 4) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(spark.createDataFrame(texts, "doc_id long, text string"), labels, calibrate_rows=50).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 2 == 0) for r in scored)


def test_hostile_markup_takes_time_in_proportion():
    import time

    from framewright.llm.html_text import blocks_of

    def seconds(page):
        best = 9.0
        for _ in range(3):
            began = time.process_time()
            blocks_of(page)
            best = min(best, time.process_time() - began)
        return best

    n = 20_000
    for make in (
        lambda n: "<![CDATA[" * n, lambda n: "<!" * n, lambda n: "<?" * n, lambda n: "<svg>" * n + "</x>" * n, lambda n: "<svg>" * n + "</svg>" * n,
        lambda n: "<p><td>" + "<b>" * n + "<h1>" * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "x > " + "<![CDATA[" * n + ">", lambda n: "<noscript>" * n + "</b>" * n,
    ):
        small, large = seconds(make(n)), seconds(make(2 * n))
        assert large < 3 * small + 0.05 and large < 5


def test_noscript_is_text_like_any_other():
    from framewright.llm.html_text import blocks_of

    assert [b.text for b in blocks_of("<article><p>one</p><noscript><p>two</p></noscript><p>three</p></article>")] == ["one", "two", "three"]


def test_an_item_without_id_is_told_as_one(spark):
    from framewright.llm.decontaminate import find_benchmark

    items = spark.createDataFrame([(None, "alpha beta gamma delta"), (-1, "epsilon zeta eta theta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so alpha beta gamma delta it is"), (2, "epsilon zeta eta theta alpha beta gamma delta")], "doc_id long, text string")
    got = sorted((r["doc_id"], str(r["item_id"])) for r in find_benchmark(docs, items).collect())
    assert got == [(1, "None"), (2, "-1"), (2, "None")]
