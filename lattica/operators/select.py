"""Retrieval: gathers, ranges, groups, annotated subsets, induced subgraphs."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.runtime import numbered


def row_ids(request, n_obs: int) -> list[int]:
    """A request as row ids: one int, ints, or a mask of n_obs bools. Duplicates and order stay."""
    if isinstance(request, bool):
        raise TypeError("a bool is no row id")
    if isinstance(request, int):
        request = [request]
    request = list(request)
    if request and all(isinstance(x, bool) for x in request):
        if len(request) != n_obs:
            raise IndexError(f"a mask needs {n_obs} entries, not {len(request)}")
        return [i for i, x in enumerate(request) if x]
    if any(isinstance(x, bool) or not isinstance(x, int) for x in request):
        raise TypeError("row ids are integers")
    if any(not 0 <= x < n_obs for x in request):
        raise IndexError(f"row ids are from 0 to {n_obs - 1}")
    return request


def key_rows(key, n_obs: int) -> range | list[int]:
    """A key as rows in their order: a slice without a step as a range within the rows, an id, ids or a mask as sorted ids."""
    if isinstance(key, slice):
        if key.step not in (None, 1):
            raise NotImplementedError("slices have no step")
        lo, hi = (d if x is None else x for x, d in ((key.start, 0), (key.stop, n_obs)))
        if lo < 0 or hi < 0:
            raise IndexError("negative rows")
        return range(min(lo, n_obs), max(min(lo, n_obs), min(hi, n_obs)))
    return sorted(row_ids(key, n_obs))


def request_table(spark: SparkSession, ids: Sequence[int]) -> DataFrame:
    """pos, row_id: what was asked for, in order. As large as the request, which the caller holds."""
    return spark.createDataFrame([(i, int(r)) for i, r in enumerate(ids)], "pos long, row_id long")


def gather(x: DataFrame, request: DataFrame, *, ordered: bool = True) -> DataFrame:
    """pos, row_id, col_id, value of the requested rows; rows without entries give none. With ordered=False positions follow row ids."""
    if not ordered:
        request = numbered(request.withColumnRenamed("pos", "_asked"), [F.col("row_id"), F.col("_asked")], "pos").select("pos", "row_id")
    return request.join(x, "row_id").select("pos", "row_id", "col_id", "value")


def rows_where(x: DataFrame, order: DataFrame, mask: Column) -> DataFrame:
    return x.join(order.where(mask).select("row_id"), "row_id", "left_semi").select("row_id", "col_id", "value")


def rows_between(x: DataFrame, start: int, stop: int) -> DataFrame:
    """A range of rows as literals, which Parquet's statistics prune. An empty or reversed range gives no rows."""
    return x.where((F.col("row_id") >= start) & (F.col("row_id") < stop)).select("row_id", "col_id", "value")


def group_range(spans: DataFrame, label: str) -> tuple[int, int]:
    """The rows of one group, from the short table of spans."""
    found = spans.where(F.col("label") == label).select("start", "stop").limit(2).collect()
    if not found:
        near = difflib.get_close_matches(label, [r[0] for r in spans.select("label").limit(10_000).collect()])
        raise KeyError(f"no group {label!r}; close to it: {near}")
    if len(found) > 1:
        raise ValueError(f"group {label!r} is ambiguous")
    return found[0]["start"], found[0]["stop"]


def read_group(x: DataFrame, spans: DataFrame, label: str) -> DataFrame:
    return rows_between(x, *group_range(spans, label))


def reference_count(spans: DataFrame) -> DataFrame:
    return spans.where("role = 'reference'").agg(F.max("stop").alias("n"))


def read_reference(x: DataFrame, spans: DataFrame) -> DataFrame:
    return rows_between(x, 0, reference_count(spans).first()[0] or 0)


def annotate(request: DataFrame, order: DataFrame, columns: list[str]) -> DataFrame:
    return request.join(order, "row_id").select("pos", "row_id", *columns)


def subgraph(edges: DataFrame, request: DataFrame) -> DataFrame:
    """edges(src, dst, weight) with both ends requested, by position; repeated rows repeat their edges."""
    src = request.select(F.col("pos").alias("src_pos"), F.col("row_id").alias("src"))
    dst = request.select(F.col("pos").alias("dst_pos"), F.col("row_id").alias("dst"))
    return edges.join(src, "src").join(dst, "dst").select("src_pos", "dst_pos", "weight")
