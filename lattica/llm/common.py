"""What the operators of this subpackage share: reading, shared storage, hot keys, running sums."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the contracts (space, tab, line feed, vertical tab, form feed, carriage return).
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the corpus, pruned to the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def row_key() -> Column:
    """64 bits that tell apart rows without a doc_id and rows that repeat one with different texts. Equal rows have one."""
    return F.xxhash64("doc_id", "text")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where that is unset, as in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
    return base


def saved(df: DataFrame, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Removes saved() tables that nothing reads any more: what came of them is saved itself.

    The collection has Spark remove the shuffles that led to them, which it does once the driver has dropped their plans.
    """
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def _marked(df: DataFrame, key: str, members: DataFrame, bits: int) -> DataFrame:
    """df with _in: whether its 64-bit hash `key` may be in the one column of members. Broadcast are at most 2 ** (bits - 6) rows of 16
    bytes, whatever the input: one for each 64 places of a bitmap."""
    def spot(c: str) -> tuple[Column, Column]:
        at = F.pmod(F.col(c), F.lit(1 << bits))
        return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))

    word, mask = spot(members.columns[0])
    words = members.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    word, mask = spot(key)
    out = df.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return out.withColumn("_in", F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False)))


def perhaps_in(df: DataFrame, key: str, members: DataFrame, bits: int = 26) -> DataFrame:
    """The rows of df whose 64-bit hash `key` may be in the one column of members: all that are, and the fewer others the fewer members.

    For use before a join that decides, so that most rows needn't be shuffled.
    """
    return _marked(df, key, members, bits).where("_in").select(*df.columns)


def surely_not_in(df: DataFrame, key: str, members: DataFrame, bits: int = 26) -> DataFrame:
    """The rows of df that perhaps_in() leaves out."""
    return _marked(df, key, members, bits).where("not _in").select(*df.columns)


def hot_values(df: DataFrame, key: str, *, rows: int, share: float) -> list:
    """Values of key that hold more than about `share` of the rows, found in a sample.

    The list is bounded by 25 / share whatever the input. It only decides how work is dealt out; results never depend on it.
    """
    need = 25
    fraction = min(1.0, 2 * need / share / max(rows, 1))
    seen = df.select(key).where(F.col(key).isNotNull()).sample(fraction, seed=7).groupBy(key).count()
    least = need if fraction < 1 else max(2, int(share * rows))
    return [r[0] for r in seen.where(F.col("count") >= least).orderBy(F.desc("count")).limit(int(25 / share)).collect()]


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same group before this one, in the order (bucket, *order).

    Rows of one group are dealt out by bucket, so no group, however large, meets in one task: sums within buckets, then over the
    buckets' totals, of which a group has as many as it has buckets.
    """
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = df.groupBy(*group, bucket).agg(F.sum(value).cast("long").alias("_total"))
    before = totals.select(*group, bucket, F.coalesce(F.sum("_total").over(across), zero).alias("_before"))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, bucket)]
    on = keys[0]
    for k in keys[1:]:
        on &= k
    inner = df.withColumn("_within", F.coalesce(F.sum(value).over(within), zero))
    return inner.alias("l").join(before.alias("r"), on).select("l.*", (F.col("_within") + F.col("_before")).cast("long").alias(out)).drop("_within")
