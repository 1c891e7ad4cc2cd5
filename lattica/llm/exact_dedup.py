"""Exact dedup by content sort, in DataFrame operations alone.

Sampled splitters (Spark's range partitioner) deal out the normalised texts by their leading characters, a content hash and, for
hot texts only, a part of the identifier. Each task sorts its rows externally by the whole text, so equal texts stand next to each
other, and every row is compared in full with its neighbour. A run of equal neighbours keeps its smallest identifier. Runs of a hot
text, which lie in several tasks, are merged from one row per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), common.GAP, " ")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; empty texts are equal to each other. A null doc_id sorts last, so it is kept only where every row of
    the group has none. Of repeated rows with the smallest doc_id one is kept. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm")).withColumn("h", F.xxhash64("norm"))
    hot = common.hot_values(base, "h", rows=docs.count(), share=1 / (4 * n))
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    dealt = base.select("doc_id", "norm", F.substring("norm", 1, prefix_chars).alias("prefix"), "h")
    place = ["prefix", "h"]
    if hot:
        dealt = dealt.withColumn("sub", F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(2 * n))).otherwise(F.lit(0)).cast("long"))
        place.append("sub")
    # the windows below are over these columns, so they stand on the ranges as they are
    dealt = dealt.repartitionByRange(n, *place)
    w = Window.partitionBy(*place).orderBy(F.col("norm"), F.col("doc_id").asc_nulls_last())
    fresh = F.lag("norm").over(w).isNull() | (F.lag("norm").over(w) != F.col("norm"))
    runs = (
        dealt.select("doc_id", *place, "norm", fresh.alias("head"), F.row_number().over(w).alias("at"))
        .withColumn("run", F.last(F.when(F.col("head"), F.struct("at", "doc_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .select("doc_id", *place, "head", "run", F.sha2("norm", 256).alias("text_sha256"))
    )
    runs = runs.select(
        "doc_id", "h", "head", F.col("run.doc_id").alias("keep_id"), F.count(F.lit(1)).over(Window.partitionBy(*place, "run.at")).alias("group_size"), "text_sha256"
    )
    if not hot:
        return runs.select("doc_id", "keep_id", "group_size", F.col("head").alias("kept"), "text_sha256")
    runs = common.saved(runs)
    whole = runs.where(is_hot).groupBy("text_sha256").agg(F.min("keep_id").alias("hot_id"), F.count(F.lit(1)).alias("hot_size"))
    # as many rows as there are hot texts: bounded by hot_values()
    out = runs.join(F.broadcast(whole), "text_sha256", "left").withColumn("first_id", F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_id")))
    return out.select(
        "doc_id", F.col("first_id").alias("keep_id"), F.coalesce("hot_size", "group_size").alias("group_size"),
        (F.col("head") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("kept"), "text_sha256",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
