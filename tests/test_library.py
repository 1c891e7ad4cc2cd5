import pytest
from pyspark.sql import functions as F

from lattica.errors import DatasetExists, DatasetLocked, IncompatibleSchema, LossyCast
from lattica.functions import dtypes, runtime
from lattica.operators import combine, layout, select, structure
from lattica.sources import store


def test_selectors():
    assert select.row_ids([2, 0, 2], 3) == [2, 0, 2]
    assert select.row_ids([True, False, True], 3) == [0, 2]
    assert select.row_ids(1, 3) == [1] and select.row_ids([], 3) == []
    for bad, error in (([1.5], TypeError), ([3], IndexError), ([-1], IndexError), ([True], IndexError), (True, TypeError)):
        with pytest.raises(error):
            select.row_ids(bad, 3)


def test_numbering_is_global(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    rows = runtime.numbered(df, [F.col("v")], "n").collect()
    assert sorted((r["v"], r["n"]) for r in rows) == [(i, i) for i in range(1000)]


def packed(spark, groups, target):
    df = spark.createDataFrame([(i, f"g{i}", "reference" if i in groups["ref"] else "group", b) for i, b in enumerate(groups["bytes"])], "ord long, label string, role string, bytes long")
    return [r["shard"] for r in layout.pack_shards(df, target=target).orderBy("ord").collect()]


def test_packing_cuts_at_group_edges(spark):
    assert packed(spark, {"ref": [0], "bytes": [5, 4, 4, 4, 20, 1]}, 10) == [0, 1, 1, 2, 3, 4]
    assert packed(spark, {"ref": [], "bytes": [0, 20, 1]}, 10) == [0, 1, 2]  # an empty group before a large one is sealed alone


def test_group_errors(spark):
    spans = spark.createDataFrame([(0, "alpha", 0, 3, "group")], "ord long, label string, start long, stop long, role string")
    assert select.group_range(spans, "alpha") == (0, 3)
    with pytest.raises(KeyError, match="alpha"):
        select.group_range(spans, "alpa")
    with pytest.raises(ValueError):
        select.group_range(spans.union(spans), "alpha")


def test_lossless_cast(spark):
    x = spark.createDataFrame([(1.0,), (300.0,)], "value double")
    assert [r[0] for r in dtypes.lossless_cast(x, "uint16").collect()] == [1, 300]
    for bad in ("uint8",):
        with pytest.raises(LossyCast):
            dtypes.lossless_cast(x, bad)
    with pytest.raises(LossyCast):
        dtypes.lossless_cast(spark.createDataFrame([(float("nan"),)], "value double"), "int")


def test_store(spark, tmp_path):
    path = str(tmp_path / "d")
    x = spark.createDataFrame([(0, 1, 5), (1, 0, 7)], "row_id long, col_id long, value long")
    ds = store.write(spark, path, {"x": x})
    assert sorted(map(tuple, ds.table("x").collect())) == [(0, 1, 5), (1, 0, 7)]
    with pytest.raises(DatasetExists):
        store.write(spark, path, {"x": x})
    ds.update("x", x.where("row_id = 1"))
    assert ds.table("x").count() == 1 and ds.manifest()["version"] == 2
    with ds.lock(), pytest.raises(DatasetLocked), ds.lock():
        pass
    assert store.write(spark, path, {"x": x}, overwrite=True).table("x").count() == 2


def test_concat_needs_equal_columns(spark):
    with pytest.raises(IncompatibleSchema):
        combine.concat([spark.range(1), spark.range(1).withColumnRenamed("id", "x")])


def test_verify_sees_a_change(spark):
    x = spark.createDataFrame([(0, 1, 5), (0, 2, 7)], "row_id long, col_id long, value long")
    digests = structure.row_digest(x)
    assert structure.verify(x, digests).first()[0]
    assert not structure.verify(x.withColumn("value", F.col("value") + 1), digests).first()[0]


def test_dense_cells_shuffle_rows_not_cells(spark):
    x = spark.createDataFrame([(1, 2, 5.0, "a"), (1, 2, 6.0, "b"), (1, 9, 1.0, "a"), (3, 4, None, "a"), (8, 2, 7.0, "a")], "row_id long, col_id long, value double, k string")
    columns = spark.createDataFrame([(2,), (4,), (2,)], "col_id long")
    dense = structure.dense_cells(x, spark.range(4).withColumnRenamed("id", "row_id"), columns)
    assert sorted(map(tuple, dense.collect())) == [(r, c, {(1, 2): 6.0}.get((r, c), 0.0)) for r in range(4) for c in (2, 4)]
    plan = dense._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # zeros are made above all joins
    assert structure.dense_cells(x, spark.range(4).withColumnRenamed("id", "row_id"), columns.limit(0)).count() == 0


def test_dense_cells_leave_other_columns_unshuffled(spark):
    x = spark.createDataFrame([(1, 2, 5.0, "a"), (1, 9, 1.0, "a"), (3, 4, 2.0, "a"), (3, 4, 3.0, "b")], "row_id long, col_id long, value double, k string")
    columns = spark.createDataFrame([(2,), (4,)], "col_id long")
    key, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")  # as where the tables that columns come from are taken to be too large
    try:
        dense = structure.dense_cells(x, spark.range(4).withColumnRenamed("id", "row_id"), columns)
        plan = dense._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, dense.collect())) == [(r, c, {(1, 2): 5.0, (3, 4): 3.0}.get((r, c), 0.0)) for r in range(4) for c in (2, 4)]
    finally:
        spark.conf.set(key, was)
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert len(semi) == 1 and "BroadcastHashJoin" in semi[0] and "hashpartitioning(col_id" not in plan


def test_dense_cells_take_little_room_and_many_tasks(spark, tmp_path):
    x = spark.createDataFrame([(r, c, 1.0 + r, "a") for r in (0, 7, 999) for c in (0, 5, 5999)], "row_id long, col_id long, value double, k string")
    dense = structure.dense_cells(x, spark.range(1000).withColumnRenamed("id", "row_id"), spark.range(6000).withColumnRenamed("id", "col_id"))
    dense.write.parquet(path := str(tmp_path / "dense"))
    files = list((tmp_path / "dense").glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 6_000_000 // 4  # of 6 million cells
    assert len(files) > 1  # though the rows that are shuffled would fit in one task
    back = spark.read.parquet(path)
    assert back.count() == back.distinct().count() == 6_000_000
    assert sorted(map(tuple, back.where("value <> 0").collect())) == [(r, c, 1.0 + r) for r in (0, 7, 999) for c in (0, 5, 5999)]


def test_dense_cells_of_odd_rows(spark):
    x = spark.createDataFrame([(-3, 1, 4.0, "a"), (None, 1, 5.0, "a"), (700, 2, 6.0, "b"), (700, 2, None, "c"), (700, 2, 8.0, None), (9, 1, 1.0, "a")], "row_id int, col_id int, value double, k string")
    order = spark.createDataFrame([(-3,), (700,), (700,), (None,), (2**40,)], "row_id long")
    columns = spark.createDataFrame([(1,), (2,), (1,)], "col_id long")
    dense = structure.dense_cells(x, order, columns)
    assert [f.dataType.simpleString() for f in dense.schema] == ["bigint", "int", "double"]
    cells = {(-3, 1): 4.0}  # of a cell without a value, none; of rows without an id, none
    expected = [(r, c, cells.get((r, c), 0.0)) for r in (-3, 700, 700, None, 2**40) for c in (1, 2)]
    assert sorted(map(tuple, dense.collect()), key=str) == sorted(expected, key=str)
