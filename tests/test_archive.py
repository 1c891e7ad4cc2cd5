"""Archives: what a writer refuses, what a reader checks, what concatenation needs, and that reads prune."""

import pytest
from pyspark.sql import functions as F

from lattica.errors import ColumnOutOfBounds, DatasetCorrupt, DatasetLocked, DuplicateEntries, IncompatibleSchema, LossyCast, NonIntegerCounts
from lattica.functions import dtypes
from lattica.operators import combine, layout, select, structure
from lattica.sources import archive, store
from lattica.streaming import push

CELLS = [(0, 0, 5), (0, 2, 1), (1, 1, 7), (3, 0, 2), (3, 3, 9), (5, 2, 4)]
LABELS = ["b", "a", None, "b", "ref", "a"]


def matrix(spark, cells=CELLS, labels=LABELS, value="long", dtype="int64", **more):
    obs = spark.createDataFrame([(i, x, f"cell{i}") for i, x in enumerate(labels)], "row_id long, grp string, name string")
    var = spark.createDataFrame([(i, f"gene{i}") for i in range(4)], "col_id long, gene string")
    x = spark.createDataFrame(cells, f"row_id long, col_id long, value {value}")
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(len(labels))], "row_id long, vec array<double>")
    graph = spark.createDataFrame([(0, 3, 0.5), (3, 0, 0.5), (1, 5, 2.0), (2, 4, 1.0)], "src long, dst long, weight double")
    parts = {"obsm": {"pca": vec}, "obsp": {"near": graph}, "uns": {"run": 1}} | more
    return archive.Matrix(obs, var, {"x": x}, dtype, **parts)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def grouped(spark, tmp_path_factory):
    return archive.write(spark, str(tmp_path_factory.mktemp("a") / "g"), matrix(spark), group_by="grp", reference="ref", target_bytes=8)


def test_layout_and_groups(grouped):
    assert grouped.shape == (6, 4) and grouped.is_grouped and grouped.about["reference"] == ["ref"]
    spans = [tuple(r) for r in grouped.group_spans().orderBy("ord").select("label", "start", "stop", "role").collect()]
    assert spans == [("ref", 0, 1, "reference"), ("a", 1, 3, "group"), ("b", 3, 5, "group"), ("nan", 5, 6, "group")]
    assert [r["name"] for r in grouped.obs().orderBy("row_id").collect()] == ["cell4", "cell1", "cell5", "cell0", "cell3", "cell2"]
    assert grouped.reference_row_count() == 1 and grouped.read_reference().count() == 0
    assert rows(grouped.read_group("b"), "row_id", "col_id", "value") == [(3, 0, 5), (3, 2, 1), (4, 0, 2), (4, 3, 9)]
    with pytest.raises(KeyError):
        grouped.read_group("c")
    assert rows(grouped.group_annotated("b")["obsp"]["near"], "src_pos", "dst_pos", "weight") == [(0, 1, 0.5), (1, 0, 0.5)]


def test_annotated_gather(grouped):
    got = grouped.annotated([4, 3, 4])
    assert rows(got["x"], "pos", "col_id", "value") == [(0, 0, 2.0), (0, 3, 9.0), (1, 0, 5.0), (1, 2, 1.0), (2, 0, 2.0), (2, 3, 9.0)]
    assert rows(got["obs"], "pos", "name") == [(0, "cell3"), (1, "cell0"), (2, "cell3")]
    assert rows(got["obsm"]["pca"], "pos", "vec") == [(0, [3.0, 1.0]), (1, [0.0, 1.0]), (2, [3.0, 1.0])]
    assert rows(got["obsp"]["near"], "src_pos", "dst_pos") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert got["var"].count() == 4 and got["uns"] == {"run": 1}
    assert grouped.gather([]).count() == 0 and grouped.gather([True] + [False] * 5).count() == 0
    with pytest.raises(IndexError):
        grouped.gather([6])


def test_shards(grouped, spark):
    tiles = [tuple(r) for r in grouped.table("shards").orderBy("shard").select("row_start", "row_stop", "nnz").collect()]
    assert tiles[0][0] == 0 and tiles[-1][1] == 6 and sum(t[2] for t in tiles) == 6 and all(a[1] == b[0] for a, b in zip(tiles, tiles[1:], strict=False))
    assert rows(grouped.shard(2), "row_id", "col_id") == [(0, 0), (0, 2), (1, 0), (1, 3)]
    seen = [(n, sorted(r["label"] for r in s.collect()), x.count()) for n, s, x in grouped.group_shards()]
    assert [s[1] for s in seen] == [["a"], ["b"], ["nan"]] and sum(s[2] for s in seen) == 6
    assert grouped.reference_shard().count() == 0 and rows(grouped.shards_between(2, 4), "shard") == [(1,), (2,)]
    assert layout.shard_count(100, 4, 90, 1000) == 5 and layout.shard_count(100, 4, 1, 7) == 7 and layout.shard_count(0, 4, 90, 10) == 1
    with pytest.raises(KeyError):
        grouped.shard(9)


def test_keys(grouped):
    assert select.key_rows(slice(2, 99), 6) == range(2, 6) and select.key_rows(slice(9, 12), 6) == range(6, 6) and select.key_rows([3, 1, 3], 6) == [1, 3, 3]
    assert rows(grouped[3:5], "row_id", "col_id") == [(3, 0), (3, 2), (4, 0), (4, 3)] and grouped[4].count() == 2
    for bad, error in ((slice(0, 4, 2), NotImplementedError), (slice(-2, None), IndexError), ([-1], IndexError)):
        with pytest.raises(error):
            select.key_rows(bad, 6)


def test_reads_prune(grouped):
    for df in (grouped.read_group("b"), grouped[2:4], grouped.gather([1, 4])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "row_id" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_a_writer_refuses(spark, tmp_path):
    def put(m, **o):
        archive.write(spark, str(tmp_path / "no"), m, **o)

    for cells, error in (([(0, 4, 1)], ColumnOutOfBounds), ([(0, -1, 1)], ColumnOutOfBounds), ([(0, 1, 1), (0, 1, 2)], DuplicateEntries), ([(0, 1, -1)], NonIntegerCounts), ([(0, 1, 1 << 33)], ValueError)):
        with pytest.raises(error):
            put(matrix(spark, cells))
    for options in ({"sort_order": "natural"}, {"sort_within_group": ["name"]}, {"reference": "ref"}, {"group_by": "grp", "sort_order": "random"}, {"group_by": "grp", "reference": ["zzz"]}, {"group_by": "grp", "reference": [1, 0, 0, 0, 0, 0]}, {"min_bytes": 1 << 40}, {"group_by": "grp", "reference": [True, False]}):
        with pytest.raises(ValueError):
            put(matrix(spark), **options)
    with pytest.raises(ValueError):
        put(matrix(spark, labels=["nan", None, "a", "a", "a", "a"]), group_by="grp")
    assert not (tmp_path / "no").exists()
    fractional = matrix(spark, [(0, 1, 0.5)], value="double", dtype="float64")
    a = archive.write(spark, str(tmp_path / "f"), fractional)
    assert (a.about["codec"], a.about["value_dtype"]) == ("float", "float64") and not a.is_grouped and a.read_reference() is None
    with pytest.raises(NonIntegerCounts):
        put(fractional, codec="integer")
    with pytest.raises(LossyCast):
        put(matrix(spark, [(0, 1, 0.1)], value="double", dtype="float64"), data_dtype="float32")


def test_references(spark):
    obs = matrix(spark).obs
    got = lambda r: [x["is_ref"] for x in layout.with_reference(obs, r, label="grp", position="row_id").orderBy("row_id").collect()]
    assert got(None) == [False] * 6 and got("b") == [True, False, False, True, False, False] == got([1, 0, 0, 1, 0, 0]) == got([True, False, False, True, False, False])
    assert got([None, "a"]) == [False, True, True, False, False, True] == got(F.col("grp").isNull() | (F.col("grp") == "a"))
    assert layout.size_band(100) == (100, 4 << 30) and layout.is_mask([0, 1], 2) and not layout.is_mask([0, 2], 2)


def test_updates_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "u")
    a = archive.write(spark, path, matrix(spark), group_by="grp")
    a.update("obs", a.obs().withColumn("name", F.upper("name")))
    assert archive.open_(spark, path).obs().where("name = 'CELL0'").count() == 1
    with pytest.raises(IncompatibleSchema):
        a.update("obs", a.obs().where("row_id > 0"))
    with pytest.raises(ValueError):
        a.update("x", a.family())
    again = archive.write(spark, path, a.as_matrix(), overwrite=True)  # from its own tables
    assert again.verify() and again.family().count() == 6 and again.shape == (6, 4)
    again.data.update("x", again.family().withColumn("value", F.col("value") + 1))
    assert not archive.Archive(spark, path).verify()
    again.data.update("shards", again.table("shards").where("row_start > 0"))
    with pytest.raises(DatasetCorrupt):
        archive.open_(spark, path)
    with pytest.raises(DatasetCorrupt):
        archive.open_(spark, str(tmp_path / "none"))
    ds = store.Dataset(spark, path)
    with ds.lock():
        with pytest.raises(DatasetLocked, match="pid"), ds.lock():
            pass
        with ds.lock(stale_after=-1):
            pass


def test_concat(spark, tmp_path):
    one = archive.write(spark, str(tmp_path / "1"), matrix(spark), group_by="grp", reference="ref")
    two = archive.write(spark, str(tmp_path / "2"), matrix(spark, [(0, 0, 70_000)]), group_by="grp", reference="ref")
    both = archive.concat(spark, [one, two], str(tmp_path / "12"))
    assert both.shape == (12, 4) and both.about["value_dtype"] == "uint32" and both.reference_row_count() == 2
    assert both.part("obsm", "pca").count() == 12 and both.part("obsp", "near").count() == 8 and "_ref" not in both.obs().columns
    names = [r["name"] for r in both.obs().orderBy("row_id").collect()]
    assert names[:2] == ["cell4", "cell4"] and names[2:6] == ["cell1", "cell5", "cell1", "cell5"]
    assert archive.concat(spark, [one, two], str(tmp_path / "d"), annotations="drop").keys("obsm") == []
    bad = [
        matrix(spark, uns={"run": 2}), matrix(spark, obsm={}), matrix(spark, obsm={"pca": spark.createDataFrame([(0, [1.0])], "row_id long, vec array<double>")}),
        matrix(spark, [(0, 1, 0.5)], value="double", dtype="float64"),
    ]
    for k, m in enumerate(bad):
        with pytest.raises(IncompatibleSchema):
            archive.concat(spark, [one, archive.write(spark, str(tmp_path / f"b{k}"), m, group_by="grp", reference="ref")], str(tmp_path / "x"))
    with pytest.raises(ValueError):
        archive.concat(spark, [one, archive.write(spark, str(tmp_path / "plain"), matrix(spark))], str(tmp_path / "x"))


def test_push_writer(spark, tmp_path):
    var = matrix(spark).var
    block = lambda *cells: spark.createDataFrame(list(cells), "row_id long, col_id long, value long")
    with push.PushWriter(spark, str(tmp_path / "p"), n_vars=4, value_dtype="uint16") as w:
        w.add_block(2, block((0, 1, 3), (1, 2, 4)))
        for bad, error in ((block((0, 4, 1)), ColumnOutOfBounds), (block((2, 0, 1)), IncompatibleSchema), (block((0, 0, -1)), NonIntegerCounts), (block((0, 0, 1), (0, 0, 1)), DuplicateEntries)):
            with pytest.raises(error):
                w.add_block(2, bad)
        w.add_block(1, block((0, 3, 9)))
        obs = spark.range(3).select(F.col("id").alias("row_id"))
        with pytest.raises(IncompatibleSchema):
            w.finalize(obs=obs.limit(2), var=var)
        a = w.finalize(obs=obs, var=var)
    assert rows(a.family(), "row_id", "col_id", "value") == [(0, 1, 3), (1, 2, 4), (2, 3, 9)]
    with pytest.raises(RuntimeError), push.PushWriter(spark, str(tmp_path / "q"), n_vars=4, value_dtype="uint16") as w:
        w.add_block(1, block((0, 1, 3)))
        raise RuntimeError
    assert [p.name for p in tmp_path.iterdir()] == ["p"]
    with pytest.raises(NonIntegerCounts):
        push.PushWriter(spark, "x", n_vars=4, value_dtype="float32", codec="integer")


def test_types(spark):
    assert dtypes.widest(["uint16", "uint32"]) == "uint32" and dtypes.float_width("float16") == "float32" and dtypes.float_width("float64") == "float64"
    for bad in (["uint16", "float32"], ["float32", "float64"]):
        with pytest.raises(IncompatibleSchema):
            dtypes.widest(bad)
    assert dtypes.read_plan("uint32", "uint8", 10, 10)["data"] == "float32" and dtypes.read_plan("uint32", "uint32", 10, 10)["data"] == "uint32"
    assert dtypes.read_plan("uint16", "uint16", 1 << 40, 10)["index"] == "int64" and dtypes.read_plan("float64", None, 1, 1, data="float32") == {"data": "float32", "index": "int32", "safe": False}
    with pytest.raises(LossyCast):
        dtypes.read_plan("uint16", None, 1 << 40, 10, index="int32")
    x = spark.createDataFrame([(16_777_217,)], "value long")
    with pytest.raises(LossyCast):
        dtypes.cast_values(x, "uint32", "float32", safe=False)
    assert dtypes.cast_values(x, "uint32", "float32", allow_lossy=True).first()[0] == 16_777_216.0 and dtypes.cast_values(x, "uint32", "float64").first()[0] == 16_777_217.0


def test_families(spark):
    cell = lambda v: spark.createDataFrame([(0, 0, v)], "row_id long, col_id long, value double")
    all_ = combine.families({"x": cell(1.0), "layer:a b": cell(2.0)})
    assert combine.reassembled(all_, ["x", "layer:a b"])["layer:a b"].first()["value"] == 2.0 and combine.is_primary("layer:a") and not combine.is_primary("modality:m")
    assert tuple(combine.side_by_side(all_, ["x", "layer:a b"]).first()) == (0, 0, 1.0, 2.0)
    obs = matrix(spark).obs
    combine.check_aligned(obs, {"m": obs}, "name")
    with pytest.raises(IncompatibleSchema):
        combine.check_aligned(obs, {"m": obs.where("row_id > 0")}, "name")


def test_entries_are_shuffled_once(spark, tmp_path):
    """A writer's checks, shards and digests read entries that lie in their layout: what is shuffled doesn't grow with the number of checks."""
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    n, width = 300, 100
    x = spark.range(n * width).select(F.floor(F.col("id") / width).alias("row_id"), (F.col("id") % width).alias("col_id"), (F.col("id") % 7 + 1).alias("value"))
    obs = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "ref").otherwise("a").alias("grp"))
    m = archive.Matrix(obs, spark.range(width).select(F.col("id").alias("col_id")), {"x": x}, "int64")
    before = shuffled()
    a = archive.write(spark, str(tmp_path / "w"), m, group_by="grp", reference="ref", target_bytes=1 << 20)
    assert sum(r for k, r in shuffled().items() if k not in before) < n * width
    assert a.about["nnz"] == n * width and a.verify() and a.rows(100, 101).count() == width


def test_tasks_grow_with_entries(spark, tmp_path, monkeypatch):
    """A task's rows are made from a bounded number of entries, whatever the session's number of partitions."""
    monkeypatch.setattr(structure, "TASK_ENTRIES", 50)
    x = spark.range(1000).select(F.floor(F.col("id") / 10).alias("row_id"), (F.col("id") % 10).alias("col_id"), F.lit(3).cast("long").alias("value"))
    assert structure.tasks_for(x) == 20 and structure.tasks_for(x.limit(60)) is None
    laid = structure.in_layout(structure.row_cells(x, 20), 20)
    assert laid.rdd.getNumPartitions() == 20 and rows(structure.cells_of(laid, x.columns), *x.columns) == rows(x, *x.columns)
    m = archive.Matrix(spark.range(100).select(F.col("id").alias("row_id")), spark.range(10).select(F.col("id").alias("col_id")), {"x": x}, "int64")
    assert rows(archive.write(spark, str(tmp_path / "t"), m).family(), *x.columns) == rows(x, *x.columns)
