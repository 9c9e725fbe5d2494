"""Alignment of two tokenizers against loops over the tokenizers' own files."""

import collections
import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from framewright.llm import alignment
from framewright.llm.shared import keep

TEXTS = [
    None, "", " ", "a", "hello world", "hello world", "  two  spaces \n\ttab ", "ﬁne café 中文 😀 end", "▁ is no space", "<s> </s> <|endoftext|> <0x41>", "a\0b",
    "It's the weighted sum of 12345.678 and so on, isn't it?", "x" * 5000, "the the the the", "word " * 3000, "ünïcödé " * 20, "é   　",
]


@pytest.fixture(scope="module")
def tokenizers():
    import base64

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {int(j): base64.b64decode(i) for i, j in map(bytes.split, f)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def of(text):
        """(end, id) of the tokens of either, or None."""
        if not text:
            return None
        whole = (" " + text).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [ranks[i] for i in ids[0]], [piece(i) for i in ids[1]]
        if any(b"".join(x) != whole for x in parts):
            return None
        return [list(zip(np.cumsum([len(x) for x in p]).tolist(), i)) for p, i in zip(parts, ids)]

    return of


def plain(tokens, kind):
    """Groups and links of one text, by loops."""
    a, b = tokens
    shared = sorted({e for e, _ in a} & {e for e, _ in b})
    groups, start = [], 0
    for end in shared:
        groups.append(([i for e, i in a if start < e <= end], [i for e, i in b if start < e <= end]))
        start = end
    if kind == "groups":
        return groups, [(x, y) for g in groups for x in g[0] for y in g[1]]
    spans = lambda t: [(s, e, i) for (s, (e, i)) in zip([0, *(e for e, _ in t)], t)]
    own = [(x, y) for x in spans(a) for y in spans(b)]
    if kind == "ends":
        return groups, [(x[2], y[2]) for x, y in own if x[1] == y[1]]
    return groups, [(x[2], y[2]) for x, y in own if x[0] < y[1] and y[0] < x[1]]


@pytest.mark.parametrize("kind", alignment.LINKS)
@pytest.mark.parametrize("heavy", [alignment.HEAVY, 3])
def test_equals_loops(spark, tokenizers, kind, heavy, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 4000)
    texts = [t for t in TEXTS if kind == "ends" or len(t or "") < 2000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, rid string, pairs int").repartition(3)
    rows = keep(alignment.aligned(docs, links=kind))
    got = {r["doc_id"]: r for r in alignment.scored(rows, alignment.A_IDS, heavy).collect()}
    assert len(got) == len(texts)
    found = [tokenizers(t) for t in texts]
    each = [plain(x, kind) if x else ([], []) for x in found]
    counts = collections.Counter(x for _, links in each for x in links)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    detail = {r["doc_id"]: r for r in rows.collect()}
    for i, (t, (groups, links)) in enumerate(zip(found, each)):
        r = got[i if i != 3 else None]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        n_a, n_b = (len(x) for x in t) if t else (0, 0)
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, len(groups), len(links))
        assert (r["n_best"], r["count_sum"]) == (sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links))
        assert r["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if t else "")
        d = detail[i if i != 3 else None]
        assert d["a_ids"] == [x for g in groups for x in g[0]] and d["b_ids"] == [x for g in groups for x in g[1]]
        assert d["a_sizes"] == [len(g[0]) for g in groups] and d["b_sizes"] == [len(g[1]) for g in groups]
    assert any(f is None and t for f, t in zip(found, texts)) and sum(map(bool, found)) > 10


def test_empty_table_and_odd_links(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.scored(keep(alignment.aligned(none)), alignment.A_IDS).count() == 0
    with pytest.raises(ValueError):
        alignment.aligned(none, links="all")
