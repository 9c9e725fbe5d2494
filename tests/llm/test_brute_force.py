"""Models that SQL can't express, against plain versions of them: language ID, toxicity, licence paragraphs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from framewright.llm.bytegrams import blocks, counted
from framewright.llm.language_id import predict_language
from framewright.llm.licenses import SENTENCE_END, TEMPLATES, ngrams, scan_licenses, trained
from framewright.llm.toxicity import DISCOUNT, SMOOTH, Grams, Model, Values, features, in_words, lowered


def words(rng, n, parts):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


# -- op10


def code_length(text, trees, order):
    """Bits of a text's bytes, one after the other, by the longest context that has been seen."""
    raw, total = bytes(order) + text.encode(), 0.0
    for i in range(order, len(raw)):
        bits = 0.0
        for k in range(order, -1, -1):
            seen = trees[k].get(raw[i - k : i])
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if raw[i] in seen:
                bits -= math.log2(seen[raw[i]] / (n + kinds))
                break
            bits -= math.log2(kinds / (n + kinds))
        else:
            bits += 8
        total += bits
    return total


def test_language_id_equals_plain_code_lengths(spark):
    rng, order = random.Random(21), 3
    sounds = {"aa": ["ka", "lo", "mi", "é"], "bb": ["ka", "tz", "lo", "ü"], "cc": ["lo", "mi", "tz", "о"]}
    rows = [(i, words(rng, rng.randint(1, 12), sounds[lang]) + rng.choice(["", "!", "\n 7"]), lang) for i in range(150) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 !", "cc"), (203, "zzz?", None)]
    trees = {x: [defaultdict(Counter) for _ in range(order + 1)] for x in sounds}
    for i, t, lang in rows:
        if t and lang and zlib.crc32(str(i).encode()) % 4 != 2:
            raw = bytes(order) + t.encode()
            for at in range(order, len(raw)):
                for k in range(order + 1):
                    trees[lang][k][raw[at - k : at]][raw[at]] += 1
    got = {r["doc_id"]: r for r in predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, t, _ in rows:
        if not t or not re.search(r"[^\W\d_]", t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        bits = {x: code_length(t, trees[x], order) for x in sounds}
        best = min(bits.values())
        score = 1 / sum(2 ** (-(b - best) / math.sqrt(len(t.encode()))) for b in bits.values())
        assert bits[got[i]["lang_pred"]] <= best + 1e-3 * len(t) and abs(got[i]["score"] - score) < 1e-3


# -- op6


def test_toxicity_features_equal_plain_kneser_ney():
    rng, n = random.Random(8), 5
    clean = [words(rng, 20, ["ra", "ti", "en", "ol", "é"]) for _ in range(30)]
    toxic = [words(rng, 15, ["ra", "ti", "en"]) + " grub" + rng.choice(["s", "ol", ""]) for _ in range(15)]
    counts = []
    for texts in (toxic, clean):
        counts.append(dict(zip(*(x.tolist() for x in counted([in_words(*b[:3], n)[0] for b in blocks(lowered(texts), n)])))))
    grams = sorted({*counts[0], *counts[1]})
    model = Model(Grams(np.array(grams, np.uint64), *(np.array([c.get(g, 0) for g in grams]) for c in counts)), n)

    # plain: an n-gram is the bytes from a word's start on, n at most, zeros before it
    def plain(texts):
        out = Counter()
        for t in texts:
            for w in re.findall(rb"[^ ]+ *| +", t.lower().encode()):
                out.update((bytes(n) + w)[i + 1 : i + 1 + n] for i in range(len(w)))
        return out

    top = [plain(toxic), plain(clean)]
    lower, kinds = {n - 1: None}, set(top[0]) | set(top[1])
    for k in range(n - 1, 0, -1):
        lower[k] = Counter(g[-k:] for g in kinds)
        kinds = set(lower[k])

    def share(g, table, below):
        same = {x: c for x, c in table.items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return below
        return max(table.get(g, 0) - DISCOUNT, 0) / total + DISCOUNT * len(same) / total * below

    def ratio(g):
        p = 1 / 256
        for k in range(1, n):
            p = share(g[-k:], lower[k], p)
        return math.log(share(g, top[0], p) / share(g, top[1], p))

    texts = ["ra ti grubol", "enol  é", "", "grub grub", "zz ra " * 3]
    got = features(Values(model.ratio, 1, bits=12), lowered(texts), n)
    for t, row in zip(texts, got):
        scores, sums = [0.0, 0.0, 0.0], []
        for w in re.findall(rb"[^ ]+ *| +", t.encode()):
            total = sum(ratio((bytes(n) + w)[i + 1 : i + 1 + n]) for i in range(len(w)))
            sums.append(total)
            scores.append(total / (len(w) + SMOOTH))
        want = [*sorted(scores, reverse=True)[:3], sum(sums) / max(1, len(sums)), math.log1p(len(sums))]
        assert np.allclose(row, want, atol=1e-5), (t, row, want)


# -- op8


def plain_scan(text, model):
    """(first line, last line, family) of each paragraph with a licence."""
    index = {g: i for i, g in enumerate(model.vocabulary)}
    unknown = len(model.families) - 1

    def predicted(z):
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(z.argmax())
        return (k, p[k]) if k < unknown and p[k] >= model.threshold else None

    runs, before = [], None
    for n, line in enumerate(text.split("\n")):
        known = {g for g in ngrams(line) if g in index}
        if not any(" " not in g for g in known):
            continue
        z = model.weights[[index[g] for g in known]].sum(0)
        ends = bool(re.search(SENTENCE_END, line))
        if before is None or n > before[0] + 1 or before[1]:
            runs.append([])
        runs[-1].append((n, known, z))
        before = n, ends
    units = []
    for run in runs:
        alone = [predicted(z + model.bias) for _, _, z in run]
        whole = predicted(sum(z for _, _, z in run) + model.bias)
        if whole and {a[0] for a in alone if a} <= {whole[0]}:
            units.append([run[0][0], run[-1][0], whole[0], [(n, g) for n, g, _ in run]])
        else:
            units += [[n, n, a[0], [(n, g)]] for (n, g, _), a in zip(run, alone) if a]
    joined = []
    for u in units:
        if joined and joined[-1][2] == u[2] and u[0] <= joined[-1][1] + 1:
            joined[-1][1], joined[-1][3] = u[1], joined[-1][3] + u[3]
        else:
            joined.append(u)
    out = []
    for first, _, k, lines in joined:
        have, best = set().union(*(g for _, g in lines)), None
        for i, t in enumerate(TEMPLATES[model.families[k]]):
            own = set(ngrams(t))
            common = len(have & own)
            ok = common / len(own) >= 0.6
            near = [n for n, g in lines if g & own]
            key = (ok, common if ok else -1, common / len(own), -i)
            if best is None or key > best[0]:
                best = key, min(near, default=first), max(near, default=first), ok
        out.append((best[1], best[2], model.families[k], best[3]))
    return out


def test_licence_paragraphs_equal_a_plain_scan(spark):
    rng = random.Random(31)
    pieces = [t for x in TEMPLATES.values() for t in x] + ["the work of a copy", "he had the rights to it.", "", "nothing of use:", "source and version", "All seats are free."]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 7)):
            w = rng.choice(pieces).split()
            cut = rng.choice([len(w), len(w), rng.randint(0, len(w))])
            lines += [" ".join(w[:cut]), *([" ".join(w[cut:])] if cut < len(w) else [])]
        rows.append((i, "\n".join(lines)))
    got = defaultdict(list)
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r["doc_id"]].append((r["line_no"], r["last_line_no"], r["family"], r["confirmed"]))
    want = {i: sorted(x) for i, t in rows if (x := plain_scan(t, trained()))}
    assert {i: sorted(x) for i, x in got.items()} == want and len(want) > 100
