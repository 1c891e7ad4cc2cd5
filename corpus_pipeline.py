"""From raw documents to packed sequences, each stage on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. Null and
empty texts pass every stage (packing makes them sequences' pieces of their end id alone). Rows without a doc_id, and rows that repeat one
with other texts, are documents of their own; rows that repeat as a whole are kept, or go, together. Ties go to the smaller doc_id. Extra
columns pass all stages but the last. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common, line_dedup, mixing, near_dedup, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects (score 0.5 or more)."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.scored(docs, model, out="_toxic").where("_toxic < 0.5").drop("_toxic")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that are much like an earlier one. Every document stays."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id (null first). Different texts are different documents, whatever their ids."""
    own = common.row_key()
    rows = docs.select(own.alias("_row"), "doc_id").distinct()
    found = near_dedup.near_dedup(docs.select(own.alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    each = common.saved(found.join(rows, "_row"))
    stays = each.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_stays"))
    gone = each.join(stays, "component_id").where("_row <> _stays").select("_row")
    return docs.withColumn("_row", own).join(gone, "_row", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target weights; a document that is taken twice is there twice."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: SQL can't express the classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        now = common.saved(stage(spark, docs, sf_dir))
        if before is not None:
            common.free(before)
        docs = before = now
    return docs
