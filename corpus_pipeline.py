"""A corpus from raw documents to packed sequences: five stages, each of one operator.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it has kept.  All but the last return the
columns of documents; the last returns one row per packed piece.  An empty table passes as an empty one; columns of any other
name are kept as they are; rows of null doc_id or repeated rows are rows like any other; what null and empty texts come to
is said by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.decontaminate import without_benchmark
from framewright.llm.jaccard import one_of_each
from framewright.llm.language_id import identified
from framewright.llm.line_dedup import line_repeats, without_lines
from framewright.llm.packing import pack_documents
from framewright.llm.shared import keep, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: null ones, those without a letter, and those that no language's trees code in fewer bits than their bytes."""
    return identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that repeat an earlier one go, and documents of which nothing is left; null texts stay."""
    return without_lines(docs, line_repeats(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; null and empty texts link with nothing."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences; null and empty texts are the end token alone."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark),
    ("best_fit_packing", packing),
]

#: Trained models, edit distances, components and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
