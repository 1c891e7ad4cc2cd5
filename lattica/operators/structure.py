"""Row structure, container conversion, digests and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import ColumnOutOfBounds, DuplicateEntries
from lattica.functions.runtime import numbered


def row_nnz(x: DataFrame, order: DataFrame) -> DataFrame:
    """row_id, nnz; empty rows have 0."""
    n = x.groupBy("row_id").agg(F.count(F.lit(1)).alias("nnz"))
    return order.select("row_id").join(n, "row_id", "left").select("row_id", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"))


def indptr(nnz: DataFrame, chunk: int = 4096) -> DataFrame:
    """row_id, indptr: entries in all rows before. Sums within chunks of rows, then over the chunks' totals."""
    c = F.floor(F.col("row_id") / chunk)
    within = Window.partitionBy("chunk").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = nnz.withColumn("chunk", c)
    up = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("chunk").agg(F.sum("nnz").alias("t")).select("chunk", F.coalesce(F.sum("t").over(up), F.lit(0)).alias("first"))
    inner = rows.withColumn("w", F.coalesce(F.sum("nnz").over(within), F.lit(0)))
    return inner.join(totals, "chunk").select("row_id", (F.col("first") + F.col("w")).cast("long").alias("indptr"))


def delta_gaps(x: DataFrame) -> DataFrame:
    """row_id, k, gap: differences of a row's sorted columns, the first from 0."""
    w = Window.partitionBy("row_id").orderBy("col_id")
    return x.select("row_id", (F.row_number().over(w) - 1).cast("long").alias("k"), (F.col("col_id") - F.coalesce(F.lag("col_id").over(w), F.lit(0))).cast("long").alias("gap"))


def columns_from_gaps(gaps: DataFrame) -> DataFrame:
    """row_id, k, col_id: the inverse of delta_gaps()."""
    w = Window.partitionBy("row_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return gaps.select("row_id", "k", F.sum("gap").over(w).cast("long").alias("col_id"))


def blocks(nnz: DataFrame, *, most: int) -> DataFrame:
    """block, lo, hi: runs of rows cut where a row's start passes a multiple of most / 2 entries. nnz(row_id, indptr).

    So no block has more than `most` entries as long as no row has more than half of that. The cuts follow from each row's own start,
    so no task walks over all rows.
    """
    b = F.floor(F.col("indptr") * 2 / most)
    g = nnz.groupBy(b.alias("b")).agg(F.min("row_id").alias("lo"), (F.max("row_id") + 1).alias("hi"))
    return numbered(g, [F.col("lo")], "block").select(F.col("block").cast("long").alias("block"), "lo", "hi")


#: Ids of rows whose dense cells come column by column, at most, and dense cells that are enough for a task however few partitions the session has.
BATCH_ROWS, TASK_CELLS = 256, 1 << 26


def dense_cells(x: DataFrame, order: DataFrame, columns: DataFrame) -> DataFrame:
    """row_id, col_id, value of every cell of the chosen rows and columns(col_id); unstored cells are 0; of repeated cells the last by `k` counts.

    The list of columns is one row, as wide as the dense rows that were asked for; it goes to every task, whatever size Spark takes it to have,
    so that stored cells of other columns are not shuffled. Stored cells meet batches of rows, and zeros are filled in behind that join: what is
    shuffled grows with the rows and the stored cells, not with the dense ones, and the number of tasks with the dense ones. A batch has
    the rows of neighbouring ids. Its cells come column by column: in runs of one column and with row ids that soon recur, a multiple of 8 apart
    as Parquet packs them, so that the result takes little room there.
    """
    size, parts = order.count() * (n := columns.count()), int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(size // TASK_ENTRIES + 1, max(parts, -(-size // TASK_CELLS)))
    batch = F.floor(F.col("row_id") / max(min(BATCH_ROWS, TASK_ENTRIES // max(n, 1)) // 8 * 8, 1)).alias("batch")
    last = x.join(F.broadcast(columns), "col_id", "left_semi").groupBy("row_id", "col_id").agg(F.max_by("value", "k").alias("value"))
    last = last.where("row_id is not null").withColumn("row_id", F.col("row_id").cast(order.schema["row_id"].dataType))
    cells = last.select(batch, "row_id", "col_id", "value").repartition(tasks, "batch").groupBy("batch", "col_id")
    cells = cells.agg(F.map_from_entries(F.collect_list(F.struct("row_id", "value"))).alias("stored"))
    cells = cells.groupBy("batch").agg(F.collect_list(F.struct("col_id", "stored")).alias("cells"))
    none = lambda c: F.struct(c.alias("col_id"), F.lit(None).cast(cells.schema["cells"].dataType.elementType["stored"].dataType).alias("stored"))
    ids = F.sort_array(F.collect_set("col_id"))
    wide = columns.select(F.col("col_id").cast(x.schema["col_id"].dataType)).agg(ids.alias("cols")).select("cols", F.transform("cols", none).alias("empty"))
    rows = order.select(batch, "row_id").repartition(tasks, "batch").groupBy("batch").agg(F.collect_list(F.struct("row_id")).alias("rows"))
    both = rows.join(cells, "batch", "left").crossJoin(F.broadcast(wide))
    rest = F.transform(F.array_except("cols", F.col("cells.col_id")), none)
    each = both.select(F.col("rows.row_id").alias("rows"), F.inline(F.when(F.col("cells").isNull(), F.col("empty")).otherwise(F.concat("cells", rest))))
    dense = each.select(F.explode("rows").alias("row_id"), "col_id", "stored")
    return dense.select("row_id", "col_id", F.coalesce(F.element_at("stored", F.col("row_id")), F.lit(0).cast(x.schema["value"].dataType)).alias("value"))


def stored_cells(dense: DataFrame, vector: str, id_col: str) -> DataFrame:
    """row_id, col_id, value of the non-zero components of a vector column."""
    return dense.select(F.col(id_col).alias("row_id"), F.posexplode(vector).alias("col_id", "value")).where("value <> 0")


#: Entries in a task at most, on average, where rows are made from them.
TASK_ENTRIES = 1 << 20


def tasks_for(x: DataFrame) -> int | None:
    """How many partitions hold x by TASK_ENTRIES each; none where the session's own number is enough."""
    n = -(-x.count() // TASK_ENTRIES)
    return n if n > int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def row_cells(x: DataFrame, tasks: int | None = None) -> DataFrame:
    """row_id, cells: a row's entries as one array, in the order of columns."""
    fields = F.struct("col_id", *[c for c in x.columns if c not in ("row_id", "col_id")])
    x = x.repartition(tasks, "row_id") if tasks else x
    return x.groupBy("row_id").agg(F.sort_array(F.collect_list(fields)).alias("cells"))


def in_layout(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """rows(row_id, ...) range-partitioned and sorted by row_id."""
    return rows.repartitionByRange(*([tasks] if tasks else []), "row_id").sortWithinPartitions("row_id")


def cells_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse of row_cells(): an entry's columns, in the order of rows."""
    return rows.select("row_id", F.inline("cells")).select(*columns)


def digest_of(cells: str, kind: str | None = None) -> Column:
    """The sha256 of row_digest() from row_cells(), with values as a type of their own."""
    value = lambda c: c["value"].cast(kind) if kind else c["value"]
    return F.sha2(F.array_join(F.transform(cells, lambda c: F.concat(c["col_id"].cast("string"), F.lit(":"), value(c).cast("string"))), ","), 256)


def row_digest(x: DataFrame) -> DataFrame:
    """row_id, sha256 of "col:value" in the order of columns, joined by commas."""
    return row_cells(x.select("row_id", "col_id", "value")).select("row_id", digest_of("cells").alias("sha256"))


def verify(x: DataFrame, digests: DataFrame) -> DataFrame:
    """One row: whether every row's digest is the recorded one."""
    pairs = row_digest(x).alias("a").join(digests.alias("b"), "row_id", "full_outer")
    return pairs.agg((F.count_if(~F.col("a.sha256").eqNullSafe(F.col("b.sha256"))) == 0).alias("ok"))


def out_of_bounds(x: DataFrame, n_vars: int) -> DataFrame:
    return x.where((F.col("col_id") < 0) | (F.col("col_id") >= n_vars)).select("row_id", "col_id")


def repeated_entries(x: DataFrame) -> DataFrame:
    return x.groupBy("row_id", "col_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def tiling_faults(spans: DataFrame, n_obs: Column) -> DataFrame:
    """Spans that don't begin where the one before ends, are empty, or leave rows at the end."""
    w = Window.partitionBy(F.lit(0)).orderBy("start")
    s = spans.select("label", "start", "stop", F.coalesce(F.lag("stop").over(w), F.lit(0)).alias("due"), F.lead("start").over(w).isNull().alias("is_last"))
    return s.where((F.col("start") != F.col("due")) | (F.col("stop") <= F.col("start")) | (F.col("is_last") & (F.col("stop") != n_obs))).select("label")


def split_labels(obs: DataFrame, label: str, is_reference: Column) -> DataFrame:
    """Labels of which a reference holds some rows but not all."""
    return obs.groupBy(F.col(label).alias("label")).agg(F.countDistinct(is_reference).alias("n")).where("n > 1").select("label")


def missing_beside_text(obs: DataFrame, label: str) -> DataFrame:
    """One row: whether missing labels stand beside the text that is to stand for them."""
    return obs.agg((F.bool_or(F.col(label).isNull()) & F.coalesce(F.bool_or(F.col(label) == "nan"), F.lit(False))).alias("collision"))


def check_entries(x: DataFrame, n_vars: int, *, unique: bool = True) -> None:
    """Entries of columns that there are, each cell once; else ColumnOutOfBounds or DuplicateEntries, with some of them."""
    bad = out_of_bounds(x, n_vars).limit(3).collect()
    if bad:
        raise ColumnOutOfBounds(f"columns are from 0 to {n_vars - 1}: {[tuple(r) for r in bad]}")
    if unique:
        twice = repeated_entries(x).limit(3).collect()
        if twice:
            raise DuplicateEntries(f"stored more than once: {[(r[0], r[1]) for r in twice]}")
