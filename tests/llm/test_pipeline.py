"""The pipeline: each stage's decisions against brute force on what it was given, and the whole run."""

import re

import corpus_pipeline
from framewright.llm.decontaminate import normal
from framewright.llm.edits import within

from .test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if name != "best_fit_packing":
            assert seen[-1].columns == columns
    text = [{r["doc_id"]: r["text"] for r in s.select("doc_id", "text").collect()} for s in seen[:5]]
    assert text[1] == {i: t for i, t in text[0].items() if t and re.search(r"[^\W\d_]", t)}

    lines = sorted((i, n, x) for i, t in text[1].items() for n, x in enumerate(t.split("\n")) if len(x) >= 40)
    gone = {(i, n) for k, (i, n, x) in enumerate(lines) if any(abs(len(x) - len(y)) < 3 and within(x, y, 2) for _, _, y in lines[:k])}
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in text[1].items()}
    assert text[2] == {i: t for i, t in left.items() if t.strip()}

    assert text[3] == {i: text[2][i] for i, _, c in brute(sorted(text[2].items())) if i == c}

    items = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, t in text[3].items() if any(x in normal(t) for x in items)}
    assert set(text[4]) <= set(text[3]) - whole and len(text[4]) >= 0.9 * len(text[3])
    assert all(text[4][i] == text[3][i] for i in text[4])

    packed = seen[5].collect()
    assert {r["doc_id"] for r in packed} == set(text[4])
    total = {}
    for r in packed:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert max(total.values()) <= 2048
    assert len(total) <= -(-sum(total.values()) // 2048) + 2
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, packed))


def test_stages_take_odd_rows_names_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, _key int, gone string, row_key double"
    long = "a line of its own that is longer than forty characters, to be sure"
    texts = [(1, None), (2, ""), (3, " \n\t"), (None, f"some words of no id\n{long}"), (4, "one"), (4, "one"), (4, f"{long}\nanother text of the same id"), (5, "x" * 200_000), (6, "tab\tand  two spaces <|endoftext|>  ")]
    rows = [(i, t, "en", "s", len(t or ""), "k", 1, "g", 0.5) for i, t in texts]
    rows += [(100 + i, "the same words again and again in this text " * (1 + i % 3), "en", "s", 40, "k", 2, "g", 0.5) for i in range(12)]
    docs = seen = spark.createDataFrame(rows, schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, docs.limit(0), SF)
        assert nothing.count() == 0
        stage(spark, seen, SF).write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert seen.columns == docs.columns == nothing.columns
    assert seen.select("doc_id").distinct().count() >= 5
    left = {(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "benchmark_decontamination")).collect()}
    assert (None, texts[3][1]) in left and (4, "another text of the same id") in left and (6, texts[8][1]) in left and not {1, 2, 3} & {i for i, _ in left}
