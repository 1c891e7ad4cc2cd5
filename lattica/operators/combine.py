"""Several datasets or matrices as one: concatenation, block diagonals, families."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import IncompatibleSchema


def offsets(sizes: DataFrame) -> DataFrame:
    """sizes(part, n) -> part, first: rows in the parts before. One row for each part."""
    up = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(up), F.lit(0)).cast("long").alias("first"))


def concat(parts: list[DataFrame]) -> DataFrame:
    """Parts of the same columns, one after the other, with `part`. Columns or types that differ are an error."""
    if len({tuple((f.name, f.dataType) for f in p.schema) for p in parts}) > 1:
        raise IncompatibleSchema("parts differ in their columns")
    out = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("part", F.lit(i)))
    return out


def shifted(rows: DataFrame, first: DataFrame, columns: list[str]) -> DataFrame:
    """rows(part, ...) with the columns moved behind the parts before. `first` has a row for each part."""
    out = rows.join(F.broadcast(first), "part")
    for c in columns:
        out = out.withColumn(c, (F.col(c) + F.col("first")).cast("long"))
    return out.drop("first")


#: Names of the families' roles, and the characters that a folder's name may have.
ROLES = ("x", "raw", "layer", "modality")
UNSAFE = r"[^0-9A-Za-z._-]"


def family_key(role: str, name: str = "", owner: str = "x") -> str:
    return {"x": "x", "raw": "raw", "layer": f"layer:{name}" if owner == "x" else f"{owner}:layer:{name}", "modality": f"modality:{name}"}[role]


def family_folder(key: str) -> str:
    return re.sub(UNSAFE, "_", key)


def families(matrices: dict[str, DataFrame]) -> DataFrame:
    """family, row_id, col_id, value of all matrices."""
    if len({family_folder(k) for k in matrices}) < len(matrices):
        raise IncompatibleSchema("two families share a folder name")
    frames = [m.select(F.lit(k).alias("family"), "row_id", "col_id", F.col("value").cast("double").alias("value")) for k, m in matrices.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def one_family(all_: DataFrame, key: str) -> DataFrame:
    return all_.where(F.col("family") == key).select("row_id", "col_id", "value")


def is_primary(key: str) -> bool:
    """Whether a family belongs to the primary matrix: x, raw, or a layer of x."""
    return key in ("x", "raw") or key.startswith("layer:")


def reassembled(all_: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """families() taken apart again: one table of entries for each key."""
    return {k: one_family(all_, k) for k in keys}


def side_by_side(all_: DataFrame, keys: list[str]) -> DataFrame:
    """row_id, col_id and a column for each family with the value that it holds there; null where it has no entry."""
    cols = [F.max(F.when(F.col("family") == k, F.col("value"))).alias(family_folder(k)) for k in keys]
    return all_.where(F.col("family").isin(keys)).groupBy("row_id", "col_id").agg(*cols)


def check_aligned(primary: DataFrame, others: dict[str, DataFrame], name: str) -> None:
    """Modalities have the rows of the primary one: the same names at the same row_id."""
    for key, obs in others.items():
        pairs = primary.select("row_id", F.col(name).alias("a")).join(obs.select("row_id", F.col(name).alias("b")), "row_id", "full_outer")
        if not pairs.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty():
            raise IncompatibleSchema(f"modality {key} has other rows than the primary one")
