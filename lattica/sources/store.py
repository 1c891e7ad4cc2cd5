"""Datasets on disk: Parquet tables and a manifest, published when they are whole.

A dataset is a folder of tables, each in a folder of its own, and versions of the manifest. A version is written last, so a folder
without one is no dataset; a reader takes the tables that the latest version names. What a later version no longer names is removed
after it is published, so a failure before that leaves the dataset as it was, and a dataset may be rewritten from its own tables.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import DatasetCorrupt, DatasetExists, DatasetLocked, IncompatibleSchema


def _at(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _at(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Dataset:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = _fs(spark, self.path)

    def exists(self) -> bool:
        return self.fs.exists(_at(self.spark, f"{self.path}/manifest"))

    def manifest(self) -> dict:
        if not self.exists():
            raise DatasetCorrupt(f"{self.path} has no manifest")
        rows = self.spark.read.text(f"{self.path}/manifest").collect()  # one short line a version
        return max((json.loads(r[0]) for r in rows), key=lambda m: m["version"])

    def publish(self, manifest: dict, before: dict | None) -> None:
        """Makes a version the latest; then removes the tables that only the one before names."""
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/manifest")
        for folder in set((before or {}).get("tables", {}).values()) - set(manifest["tables"].values()):
            self.fs.delete(_at(self.spark, f"{self.path}/{folder}"), True)

    def lock(self, stale_after: float | None = None) -> Lock:
        return Lock(self, stale_after)

    def table(self, name: str) -> DataFrame:
        tables = self.manifest()["tables"]
        if name not in tables:
            raise KeyError(f"no table {name!r}; there are {sorted(tables)}")
        return self.spark.read.parquet(f"{self.path}/{tables[name]}")

    def put(self, df: DataFrame, name: str, as_it_is: bool = False) -> str:
        """Writes a table to a fresh folder, which no version names yet. With a row_id it is range-partitioned and sorted by it, unless it is so already."""
        folder = f"{name}-{uuid.uuid4().hex}"
        if "row_id" in df.columns and not as_it_is:
            df = df.repartitionByRange("row_id").sortWithinPartitions("row_id", *[c for c in ("col_id",) if c in df.columns])
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return folder

    def update(self, name: str, df: DataFrame, *, key: str | None = None, changes: Callable[[dict], dict] = lambda m: {}) -> None:
        """A new version of one table; the others stay as they are. With `key`, the rows must be those that are there, by that column."""
        with self.lock():
            before = self.manifest()
            if key is not None:
                old, new = (t.groupBy(key).count() for t in (self.table(name), df))
                faults = old.withColumnRenamed("count", "n").join(new, old[key].eqNullSafe(new[key]), "full_outer").where("n is null or count is null or n <> count")
                if not faults.isEmpty():
                    raise IncompatibleSchema(f"the new {name} doesn't have the rows of the old one by {key}")
            self.publish(before | {"version": before["version"] + 1, "tables": before["tables"] | {name: self.put(df, name)}} | changes(before), before)


class Lock:
    """One writer at a time: a file that only one can create, with its holder in it. One older than `stale_after` seconds is taken over."""

    def __init__(self, dataset: Dataset, stale_after: float | None = None):
        self.dataset, self.file, self.stale_after = dataset, f"{dataset.path}.lock", stale_after

    def holder(self) -> dict:
        stream = self.dataset.fs.open(_at(self.dataset.spark, self.file))
        text = self.dataset.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) if text else {"time": 0}

    def __enter__(self):
        at, fs = _at(self.dataset.spark, self.file), self.dataset.fs
        if self.stale_after is not None and fs.exists(at) and time.time() - self.holder()["time"] > self.stale_after:
            fs.delete(at, False)
        try:
            stream = fs.create(at, False)
        except Exception as e:
            if fs.exists(at):
                raise DatasetLocked(f"{self.file} is held by {self.holder()}") from e
            raise
        stream.write(bytearray(json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "time": time.time()}).encode()))
        stream.close()
        return self

    def __exit__(self, *_):
        self.dataset.fs.delete(_at(self.dataset.spark, self.file), False)


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame], *, overwrite: bool = False, about: dict | None = None, as_it_is: set[str] = frozenset()) -> Dataset:
    """Writes the tables as one version; `about` goes into the manifest. Tables in `as_it_is` are in the order of rows already."""
    ds = Dataset(spark, path)
    with ds.lock():
        there = ds.exists()
        if there and not overwrite:
            raise DatasetExists(path)
        before = ds.manifest() if there else None
        folders = {name: ds.put(df, name, name in as_it_is) for name, df in tables.items()}
        ds.publish({"version": (before or {"version": 0})["version"] + 1, "tables": folders} | (about or {}), before)
    return ds


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often, whatever their order. Columns or types that differ make them differ."""
    if sorted((f.name, f.dataType.simpleString()) for f in a.schema) != sorted((f.name, f.dataType.simpleString()) for f in b.schema):
        return False
    keys = a.columns
    n, m = (t.select(F.struct(*keys).alias("row")).groupBy(F.to_json("row").alias("row")).count() for t in (a, b))
    return n.withColumnRenamed("count", "n").join(m, "row", "full_outer").where("n is null or count is null or n <> count").isEmpty()
