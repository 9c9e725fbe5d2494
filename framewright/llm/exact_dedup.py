"""Exact dedup by two-pass Bloom filtering, in DataFrame operations alone."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bloom
from .shared import keep, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as empty.  The row with the largest id
    stays; of rows with the same text and the same id, exactly one stays, and null ids are the
    smallest.  Other columns of docs are ignored, so their names can't clash.  An empty table gives
    an empty result.

    Pass 1 is a Bloom filter of all hashes, of 64 bits or more to a hash and one position each.  Its words of 64 bits are
    or-ed in each task first and then in a table hash-partitioned by word, so no place ever holds the whole filter.  A word to which
    more hashes were added than it has bits set holds one that may be repeated.  Pass 2 packs those words' numbers in a
    filter that is sent to the tasks.  Rows it doesn't know are unique and pass straight through; only the rest is shuffled,
    and as ids and hashes.  A filter of more than max_bits is cut by ranges of words: each range reads the ids and hashes, not the
    texts, once.
    """
    spark = docs.sparkSession
    rows = keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    n = rows.count()
    m1 = 1 << math.ceil(math.log2(64 * max(n, 2)))
    pos = F.pmod(F.xxhash64("text_sha256"), F.lit(m1))
    rows = rows.withColumn("word", F.shiftright(pos, 6))
    bits = rows.select("word", F.call_function("shiftleft", F.lit(1).cast("long"), (pos % 64).cast("int")).alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("c"))
    twice = keep(words.filter(F.col("c") > F.bit_count("bits")).select("word"))
    n2 = twice.count()
    parts = max(1, math.ceil(bloom.shape(n2, 0.01)[0] / max_bits))
    again, once = [], []
    for p in range(parts):
        mine = F.pmod(F.xxhash64("word", F.lit(1)), F.lit(parts)) == p
        known = bloom.build(twice.filter(mine), "word", -(-n2 // parts), 0.01, seed=2).might_contain(F.col("word"))
        own = rows.filter(mine) if parts > 1 else rows
        again.append(own.filter(known))
        once.append(own.filter(~known))
    again, once = reduce(DataFrame.unionByName, again), reduce(DataFrame.unionByName, once)
    groups = keep(
        again.groupBy("text_sha256").agg(
            F.max(F.struct("doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size")
        )
    )
    found = again.join(groups, "text_sha256").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        "text_sha256",
    )
    return once.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    ).unionByName(found)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
