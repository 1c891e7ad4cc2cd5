"""Storage order of rows: grouped, reference first; spans of groups; packing into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.runtime import numbered

MISSING = "nan"
#: The band that a shard's target size lies in unless another is given, in bytes.
BAND = (512 << 20, 4 << 30)
ROW_CHUNK = 4096


def check_sort(group_by: str | None, sort_within_group: list[str] | None, sort_order: str | None) -> None:
    """Sort settings belong to a grouped layout, and the order is one of the two that there are."""
    if group_by is None and sort_within_group:
        raise ValueError("sort_within_group needs group_by")
    if group_by is None and sort_order is not None:
        raise ValueError("sort_order needs group_by")
    if sort_order not in (None, "natural", "alphabetical"):
        raise ValueError(f"sort_order is natural or alphabetical, not {sort_order!r}")


def size_band(target: int, *, least: int | None = None, most: int | None = None) -> tuple[int, int]:
    """(least, most) bytes of a shard, which must hold the target."""
    lo, hi = min(BAND[0], target) if least is None else least, max(BAND[1], target) if most is None else most
    if target < 0 or not lo <= target <= hi:
        raise ValueError(f"target {target} isn't between {lo} and {hi}")
    return lo, hi


def is_mask(reference, n_obs: int) -> bool:
    """Whether a reference is a mask of rows: bools, or as many zeros and ones as there are rows."""
    some = list(reference)
    if some and all(isinstance(x, bool) for x in some):
        return True
    return len(some) == n_obs and all(isinstance(x, (bool, int)) and x in (0, 1) for x in some)


def with_reference(obs: DataFrame, reference, *, label: str, position: str) -> DataFrame:
    """obs with is_ref. The reference is null, a label, labels, a mask in the order of `position` from 0, or a Column.

    A label that no row has, and a mask of another length, are errors. A mask is as large as the caller's list.
    """
    if reference is None:
        return obs.withColumn("is_ref", F.lit(False))
    if isinstance(reference, Column):
        return obs.withColumn("is_ref", F.coalesce(reference, F.lit(False)))
    given = [reference] if isinstance(reference, str) or reference is None else list(reference)
    n = obs.count()
    if is_mask(given, n):
        if len(given) != n:
            raise ValueError(f"a mask of {len(given)} rows for {n}")
        rows = obs.sparkSession.createDataFrame([(i,) for i, x in enumerate(given) if x], "_pos long")
        return obs.join(rows, F.col(position) == F.col("_pos"), "left").withColumn("is_ref", F.col("_pos").isNotNull()).drop("_pos")
    want = {MISSING if x is None else str(x) for x in given}
    have = {r[0] for r in obs.select(label_text(label).alias("l")).where(F.col("l").isin(sorted(want))).distinct().collect()}  # of those asked for only
    if want - have:
        some = [r[0] for r in obs.select(label_text(label).alias("l")).distinct().orderBy("l").limit(50).collect()]
        raise ValueError(f"no rows have the labels {sorted(want - have)}; there are {some}")
    return obs.withColumn("is_ref", label_text(label).isin(sorted(want)))


def check_reference(obs: DataFrame, label: str) -> None:
    """obs(label, is_ref): a reference takes whole labels, and a missing label has no text of its own beside it."""
    split = obs.groupBy(label_text(label).alias("l")).agg(F.countDistinct("is_ref").alias("n")).where("n > 1").limit(5).collect()
    if split:
        raise ValueError(f"the reference splits the labels {[r[0] for r in split]}")
    missing = F.col(label).isNull()
    if obs.agg((F.bool_or(missing) & F.coalesce(F.bool_or(F.col(label).cast("string") == MISSING), F.lit(False))).alias("c")).first()[0]:
        raise ValueError(f"missing labels stand beside the label {MISSING!r}")


def label_text(label: str) -> Column:
    """Labels as text; a missing one is `nan`."""
    return F.coalesce(F.col(label).cast("string"), F.lit(MISSING))


def storage_order(
    obs: DataFrame, *, label: str, position: str, reference: list[str] = (), secondary: list[str] = (), sort_order: str = "natural", categories: list[str] | None = None
) -> DataFrame:
    """obs with row_id, label and role: stable order by reference first, label, the secondary columns, input position.

    sort_order "natural" compares values, "alphabetical" their text; `categories` gives an order of labels of its own. With a column
    is_ref, as with_reference() gives it, that says which rows are the reference.
    """
    check_sort(label, list(secondary), sort_order)
    text = label_text(label)
    first = F.when(F.col("is_ref"), 0).otherwise(1) if "is_ref" in obs.columns else F.when(text.isin(list(reference)), 0).otherwise(1) if reference else F.lit(1)
    if categories:
        rank = F.coalesce(*[F.when(text == c, i) for i, c in enumerate(categories)], F.lit(len(categories)))
        keys = [rank]
    else:
        keys = [text if sort_order == "alphabetical" else F.coalesce(F.col(label), F.lit(MISSING))]
    more = [F.col(c).cast("string") if sort_order == "alphabetical" else F.col(c) for c in secondary]
    named = [k.alias(f"_k{i}") for i, k in enumerate([first, *keys, *more, F.col(position)])]
    out = numbered(obs.select("*", *named), [F.col(f"_k{i}").asc_nulls_last() for i in range(len(named))], "row_id")
    role = F.when(F.col("_k0") == 0, "reference").otherwise("group")
    return out.withColumn("label", text).withColumn("role", role).drop(*[f"_k{i}" for i in range(len(named))])


def group_spans(order: DataFrame) -> DataFrame:
    """ord, label, start, stop, role of each group. In storage order a label's rows are contiguous, so its span is that of its row ids."""
    g = order.groupBy("label", "role").agg(F.min("row_id").alias("start"), (F.max("row_id") + 1).alias("stop"))
    ord_ = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("start")) - 1
    return g.select(ord_.cast("long").alias("ord"), "label", "start", "stop", "role")


def group_bytes(spans: DataFrame, nnz: DataFrame, bytes_each: int) -> DataFrame:
    """spans with the bytes of each group; nnz has row_id, label and nnz."""
    return spans.join(nnz.groupBy("label").agg((F.sum("nnz") * bytes_each).cast("long").alias("bytes")), "label")


def pack_shards(groups: DataFrame, *, target: int) -> DataFrame:
    """groups(ord, label, role, bytes) with `shard`: whole groups in order, cut where the next one would pass the target.

    The fold runs over the list of groups, never over rows, and keeps the cuts alone: reference groups stay together and apart from the
    others. A group whose rows are all empty, ahead of one that passes the target, is sealed by itself.
    """
    items = F.sort_array(F.collect_list(F.struct("ord", "bytes", "role", "label")))
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit("").alias("role"), F.lit(False).alias("any"), F.array().cast("array<bigint>").alias("cuts"))

    def step(a, g):
        plain = g["role"] != "reference"
        full = plain & ((a["role"] == "reference") | ((a["size"] + g["bytes"] > target) & a["any"]))
        size = F.when(full, F.lit(0).cast("long")).otherwise(a["size"]) + g["bytes"]
        cuts = F.when(full, F.concat(a["cuts"], F.array(g["ord"]))).otherwise(a["cuts"])
        return F.struct(size.alias("size"), g["role"].alias("role"), F.lit(True).alias("any"), cuts.alias("cuts"))

    folded = groups.agg(items.alias("items")).select("items", F.aggregate("items", start, step)["cuts"].alias("cuts"))
    each = folded.select("cuts", F.explode("items").alias("g"))
    return each.select("g.label", "g.ord", F.size(F.filter("cuts", lambda c: c <= F.col("g.ord"))).cast("long").alias("shard"))


def shard_bounds(packed: DataFrame, spans: DataFrame) -> DataFrame:
    """shard, row_start, row_stop."""
    return packed.join(spans.select("label", "start", "stop"), "label").groupBy("shard").agg(F.min("start").alias("row_start"), F.max("stop").alias("row_stop"))


def shard_of_rows(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """rows(row_id) with their shard, by an equi-join on stretches of ROW_CHUNK rows, of which a shard covers some."""
    stretch = lambda c: F.floor(F.col(c) / ROW_CHUNK)
    b = bounds.where("row_stop > row_start").select("shard", "row_start", "row_stop", F.explode(F.sequence(stretch("row_start"), F.floor((F.col("row_stop") - 1) / ROW_CHUNK))).alias("_stretch"))
    return rows.withColumn("_stretch", stretch("row_id")).join(F.broadcast(b), "_stretch").where("row_id >= row_start and row_id < row_stop").select(*rows.columns, "shard")


def shards_of_range(bounds: DataFrame, start: int, stop: int) -> DataFrame:
    return bounds.where((F.col("row_start") < stop) & (F.col("row_stop") > start)).select("shard")


def split_even(total: DataFrame, shards: int) -> DataFrame:
    """total(n): shard, row_start, row_stop of an ungrouped split; split points round half to even."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    edge = lambda i: F.bround(i * F.col("n") / shards, 0).cast("long")
    return total.select("n", k.alias("shard")).select("shard", edge(F.col("shard")).alias("row_start"), edge(F.col("shard") + 1).alias("row_stop"))


def batches(shards: DataFrame, size: int) -> DataFrame:
    """shards(shard): runs of at most `size` consecutive shards, numbered. Runs are numbered without a sort in one task."""
    placed = numbered(shards.select("shard"), [F.col("shard")], "n")
    run = placed.select("shard", (F.col("shard") - F.col("n")).alias("run"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("shard")) - 1
    chunk = run.select("shard", "run", F.floor(place / size).alias("chunk"))
    heads = numbered(chunk.select("run", "chunk").distinct(), [F.col("run"), F.col("chunk")], "batch")
    return chunk.join(heads, ["run", "chunk"]).select(F.col("batch").cast("long").alias("batch"), "shard")


def shard_count(nnz: int, bytes_each: int, target: int, n_obs: int) -> int:
    """Shards of an ungrouped layout: as many as the target asks for, no more than rows, one at least."""
    return max(1, min(n_obs, -(-nnz * bytes_each // max(1, target))))


def local_slices(packed: DataFrame, spans: DataFrame) -> DataFrame:
    """shard, label, lo, hi of each non-reference group within its shard."""
    s = packed.join(spans, ["label", "ord"])
    first = F.min("start").over(Window.partitionBy("shard"))
    return s.where("role <> 'reference'").select("shard", "label", (F.col("start") - first).alias("lo"), (F.col("stop") - first).alias("hi"))
