"""Push ingest: blocks of rows arrive one after the other, by hand or as a stream, are staged, and become an archive when they end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import IncompatibleSchema
from lattica.functions import dtypes
from lattica.functions.runtime import shared_dir
from lattica.operators import structure
from lattica.sources import archive, store


class PushWriter:
    """Blocks of rows in ascending order -> an archive.

    A block is (rows, entries): how many rows it has, and their entries with row_id from 0 within it. Each is checked and staged by
    itself; a block that is rejected leaves nothing behind, and the writer goes on. Until finalize() there is no archive; abort(), or
    leaving the context by an error, removes what is staged.
    """

    def __init__(self, spark: SparkSession, path: str, *, n_vars: int, value_dtype: str, codec: str | None = None, overwrite: bool = False):
        self.spark, self.path, self.n_vars, self.value_dtype, self.overwrite = spark, path, n_vars, value_dtype, overwrite
        self.codec = dtypes.declared_codec(value_dtype, codec)
        self.staging, self.n_obs, self.blocks, self.open = f"{path.rstrip('/')}-push-{uuid.uuid4().hex}", 0, 0, True

    def add_block(self, rows: int, entries: DataFrame) -> None:
        """Stages a block, or raises and leaves the writer as it was."""
        if not self.open:
            raise ValueError("the writer is closed")
        structure.check_entries(entries, self.n_vars)
        if not entries.where((F.col("row_id") < 0) | (F.col("row_id") >= rows)).isEmpty():
            raise IncompatibleSchema(f"a block of {rows} rows has entries of others")
        if self.codec == "integer":
            dtypes.decide_codec(dtypes.count_faults(dtypes.value_stats(entries)).first()[0], self.value_dtype, "integer")
        cells = entries.select((F.col("row_id") + F.lit(self.n_obs)).cast("long").alias("row_id"), F.col("col_id").cast("long").alias("col_id"), F.col("value").cast(dtypes.SPARK[self.value_dtype]).alias("value"))
        cells.write.mode("overwrite").parquet(f"{self.staging}/block={self.blocks}")
        self.n_obs, self.blocks = self.n_obs + rows, self.blocks + 1

    def finalize(self, *, obs: DataFrame, var: DataFrame, uns: dict | None = None, **options) -> archive.Archive:
        """The archive of all blocks. obs has a row for each row, var one for each column."""
        if not self.open:
            raise ValueError("the writer is closed")
        for what, df, n in (("obs", obs, self.n_obs), ("var", var, self.n_vars)):
            if df.count() != n:
                raise IncompatibleSchema(f"{what} has {df.count()} rows for {n}")
        empty = self.spark.createDataFrame([], f"row_id long, col_id long, value {dtypes.SPARK[self.value_dtype]}")
        x = self.spark.read.schema(empty.schema).parquet(*[f"{self.staging}/block={b}" for b in range(self.blocks)]) if self.blocks else empty
        out = archive.write(self.spark, self.path, archive.Matrix(obs, var, {"x": x}, self.value_dtype, uns=uns or {}), codec=self.codec, overwrite=self.overwrite, **options)
        self.abort()
        return out

    def abort(self) -> None:
        """Removes what is staged. Nothing can be added afterwards."""
        self.open = False
        data = store.Dataset(self.spark, self.staging)
        data.fs.delete(store._at(self.spark, self.staging), True)

    def __enter__(self) -> PushWriter:
        return self

    def __exit__(self, *_) -> None:
        if self.open:
            self.abort()


def stage(stream: DataFrame, folder: str) -> None:
    """Appends a stream to a folder until what is there now is read. A batch that is run again replaces itself."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def ingest(spark: SparkSession, source: str, columns: list[str]) -> DataFrame:
    """All rows of a Parquet source, by way of the stream."""
    folder = f"{shared_dir(spark)}/push-{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).select(*columns).schema
    either = f"{source[:-1]}[{source[-1]}]"  # as a pattern, so that a single file serves as well as a folder
    stage(spark.readStream.schema(schema).parquet(either), folder)
    return spark.read.parquet(f"{folder}/rows").select(*columns)


def finish(rows: DataFrame, *, row: str, col: str) -> DataFrame:
    """row_id, col_id, value: entries of a row and column are counted."""
    return rows.groupBy(F.col(row).alias("row_id"), F.col(col).alias("col_id")).agg(F.count(F.lit(1)).alias("value"))
