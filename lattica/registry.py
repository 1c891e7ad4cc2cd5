"""The library's queries over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import dtypes, runtime
from lattica.operators import combine, layout, select, structure
from lattica.plans import tables as T
from lattica.sources import archive, store
from lattica.streaming import push

QUERIES: dict = {}
ORACLES: dict = {}

LAY = """lay AS (SELECT o_orderkey AS pos, o_orderstatus, o_orderpriority AS label,
  CAST(row_number() OVER (ORDER BY o_orderpriority <> '3-MEDIUM', o_orderpriority, o_orderkey) - 1 AS BIGINT) AS row_id,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'reference' ELSE 'group' END AS role FROM orders)"""
ENT = "ent AS (SELECT l_orderkey AS pos, l_partkey AS col_id, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2)"
MAT = f"{LAY}, {ENT}, x AS (SELECT row_id, col_id, value FROM ent JOIN lay USING (pos))"
SPANS = """spans AS (SELECT CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS BIGINT) AS ord, label, min(row_id) AS start,
  max(row_id) + 1 AS stop, role FROM lay GROUP BY label, role)"""
NNZ = "nnz AS (SELECT lay.row_id, lay.label, count(ent.col_id) AS nnz FROM lay LEFT JOIN ent USING (pos) GROUP BY 1, 2)"
#: What the packing queries aim at: a share of all entries' bytes, four bytes each.
PACK = f"""{LAY}, {ENT}, {SPANS}, {NNZ},
  g AS (SELECT ord, label, role, CAST(sum(nnz) * 4 AS BIGINT) AS bytes FROM nnz JOIN spans USING (label) GROUP BY 1, 2, 3),
  target AS (SELECT CAST(sum(bytes) // 3 AS BIGINT) AS t FROM g),
  fold AS (SELECT ord, label, role, bytes, bytes AS cur, CAST(0 AS BIGINT) AS shard FROM g WHERE ord = 0
    UNION ALL SELECT g.ord, g.label, g.role, g.bytes,
      CASE WHEN g.role <> 'reference' AND (f.role = 'reference' OR f.cur + g.bytes > t) THEN g.bytes ELSE f.cur + g.bytes END,
      f.shard + CASE WHEN g.role <> 'reference' AND (f.role = 'reference' OR f.cur + g.bytes > t) THEN 1 ELSE 0 END
    FROM fold f JOIN g ON g.ord = f.ord + 1, target),
  bounds AS (SELECT shard, min(start) AS row_start, max(stop) AS row_stop FROM fold JOIN spans USING (label) GROUP BY shard)"""
REQUEST = [7, 3, 3, 140, 0, 99, 7]
VALUES = ", ".join(f"({i}, {r})" for i, r in enumerate(REQUEST))
REQ = f"req AS (SELECT CAST(a AS BIGINT) AS pos, CAST(b AS BIGINT) AS row_id FROM (VALUES {VALUES}) v(a, b))"


def shown(df: DataFrame) -> DataFrame:
    """Entries of the stored archive with values as long, as the oracles have them."""
    return df.withColumn("value", F.col("value").cast("long"))


def query(oracle: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def rec(body: str, tail: str) -> str:
    return f"WITH RECURSIVE {body} {tail}"


# --- layout

@query(f"WITH {LAY} SELECT row_id, pos AS o_orderkey, label, role FROM lay")
def layout_grouped(spark: SparkSession, d: str) -> DataFrame:
    return T.order(spark, d).select("row_id", "o_orderkey", "label", "role")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderpriority <> '3-MEDIUM', o_orderpriority, CAST(o_orderkey AS VARCHAR), o_orderkey) - 1 AS BIGINT) AS row_id, o_orderkey FROM orders")
def layout_alphabetical(spark: SparkSession, d: str) -> DataFrame:
    obs = T.obs(spark, d).withColumn("key", F.col("o_orderkey"))
    return layout.storage_order(obs, label="o_orderpriority", position="o_orderkey", reference=T.REFERENCE, secondary=["key"], sort_order="alphabetical").select("row_id", "o_orderkey")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderpriority <> '3-MEDIUM', o_orderpriority, o_orderstatus, o_orderkey) - 1 AS BIGINT) AS row_id, o_orderkey FROM orders")
def layout_multikey(spark: SparkSession, d: str) -> DataFrame:
    return T.order(spark, d, secondary=["o_orderstatus"]).select("row_id", "o_orderkey")


CATEGORIES = ["5-LOW", "1-URGENT", "4-NOT SPECIFIED", "2-HIGH", "3-MEDIUM"]
CASES = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORIES))


@query(f"SELECT CAST(row_number() OVER (ORDER BY CASE o_orderpriority {CASES} END, o_orderkey) - 1 AS BIGINT) AS row_id, o_orderkey FROM orders")
def layout_category_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.storage_order(T.obs(spark, d), label="o_orderpriority", position="o_orderkey", categories=CATEGORIES).select("row_id", "o_orderkey")


@query("""WITH m AS (SELECT coalesce(nullif(o_orderpriority, '5-LOW'), 'nan') AS label, o_orderkey FROM orders),
r AS (SELECT label, row_number() OVER (ORDER BY label, o_orderkey) - 1 AS id FROM m)
SELECT label, CAST(min(id) AS BIGINT) AS start, CAST(max(id) + 1 AS BIGINT) AS stop FROM r GROUP BY label""")
def layout_missing_label(spark: SparkSession, d: str) -> DataFrame:
    obs = T.obs(spark, d).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return layout.group_spans(layout.storage_order(obs, label="o_orderpriority", position="o_orderkey")).select("label", "start", "stop")


@query("SELECT o_orderpriority AS label FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus = 'F') > 1")
def layout_split_label_check(spark: SparkSession, d: str) -> DataFrame:
    return structure.split_labels(T.obs(spark, d), "o_orderpriority", F.col("o_orderstatus") == "F")


@query("SELECT bool_or(nullif(o_orderpriority, '5-LOW') IS NULL) AND coalesce(bool_or(nullif(o_orderpriority, '5-LOW') = 'nan'), false) AS collision FROM orders")
def layout_nan_collision_check(spark: SparkSession, d: str) -> DataFrame:
    return structure.missing_beside_text(T.obs(spark, d).withColumn("label", F.nullif("o_orderpriority", F.lit("5-LOW"))), "label")


@query(f"WITH {LAY}, {SPANS} SELECT ord, label, start, stop, role FROM spans")
def group_spans(spark: SparkSession, d: str) -> DataFrame:
    return T.stored(spark, d).group_spans()


@query(f"WITH {LAY}, {SPANS} SELECT label FROM spans")
def group_labels(spark: SparkSession, d: str) -> DataFrame:
    return T.stored(spark, d).group_spans().select("label")


@query(f"WITH {LAY}, {SPANS} SELECT max(stop) AS n FROM spans WHERE role = 'reference'")
def reference_row_count(spark: SparkSession, d: str) -> DataFrame:
    return select.reference_count(T.stored(spark, d).group_spans())


# --- selection

@query(f"WITH {MAT}, {SPANS} SELECT x.* FROM x, spans WHERE label = '5-LOW' AND row_id >= start AND row_id < stop")
def read_group(spark: SparkSession, d: str) -> DataFrame:
    return shown(T.stored(spark, d).read_group("5-LOW"))


@query(f"WITH {MAT}, {SPANS} SELECT x.* FROM x, spans WHERE role = 'reference' AND row_id < stop")
def read_reference(spark: SparkSession, d: str) -> DataFrame:
    return shown(T.stored(spark, d).read_reference())


@query(f"WITH {MAT}, {REQ} SELECT req.pos, row_id, col_id, value FROM req JOIN x USING (row_id)")
def gather_rows(spark: SparkSession, d: str) -> DataFrame:
    return shown(T.stored(spark, d).gather(REQUEST))


@query(f"WITH {MAT}, {REQ}, s AS (SELECT CAST(row_number() OVER (ORDER BY row_id, pos) - 1 AS BIGINT) AS pos, row_id FROM req) SELECT s.pos, row_id, col_id, value FROM s JOIN x USING (row_id)")
def gather_rows_sorted(spark: SparkSession, d: str) -> DataFrame:
    return shown(T.stored(spark, d).gather(REQUEST, ordered=False))


@query(f"WITH {MAT} SELECT x.* FROM x JOIN lay USING (row_id) WHERE o_orderstatus = 'F'")
def gather_rows_mask(spark: SparkSession, d: str) -> DataFrame:
    a = T.stored(spark, d)
    return shown(select.rows_where(a.family(), a.obs(), F.col("o_orderstatus") == "F"))


@query(f"WITH {MAT} SELECT * FROM x WHERE row_id >= 50 AND row_id < 125")
def read_slice(spark: SparkSession, d: str) -> DataFrame:
    return shown(T.stored(spark, d)[50:125])


@query(f"WITH {MAT}, {REQ} SELECT req.pos, col_id, CAST(value AS FLOAT) AS value FROM req JOIN x USING (row_id)")
def gather_rows_float32(spark: SparkSession, d: str) -> DataFrame:
    return T.stored(spark, d).gather(REQUEST).select("pos", "col_id", "value")


@query(f"WITH {LAY}, {REQ} SELECT req.pos, row_id, label, o_orderstatus FROM req JOIN lay USING (row_id)")
def gather_rows_adata_obs(spark: SparkSession, d: str) -> DataFrame:
    a = T.stored(spark, d)
    return select.annotate(select.request_table(spark, REQUEST), a.pushed(REQUEST, a.obs()), ["label", "o_orderstatus"])


#: Rows of orders of one customer are neighbours, in the order of their keys.
EDGES = f"""{LAY}, e AS (SELECT * FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL),
edges AS (SELECT s.row_id AS src, t.row_id AS dst, b - a AS weight FROM e JOIN lay s ON s.pos = a JOIN lay t ON t.pos = b)"""


edges = T.edges


@query(f"WITH {EDGES}, req AS (SELECT row_id AS pos, row_id FROM lay WHERE role = 'reference') SELECT a.pos AS src_pos, b.pos AS dst_pos, weight FROM edges JOIN req a ON a.row_id = src JOIN req b ON b.row_id = dst")
def subgraph(spark: SparkSession, d: str) -> DataFrame:
    placed = T.order(spark, d)
    return select.subgraph(edges(spark, d, placed), placed.where("role = 'reference'").select(F.col("row_id").alias("pos"), "row_id"))


# --- the stored archive

VARS = "(SELECT count(*) FROM part)"


@query(f"WITH {ENT} SELECT (SELECT count(*) FROM orders) AS n_obs, {VARS} AS n_vars, (SELECT count(*) FROM ent) AS nnz, 'integer' AS codec, 'uint16' AS value_dtype, CASE WHEN {VARS} <= 65536 THEN 'uint16' ELSE 'uint32' END AS index_dtype, 'o_orderpriority' AS group_by")
def archive_info(spark: SparkSession, d: str) -> DataFrame:
    return T.stored(spark, d).info()


@query("SELECT p_partkey AS col_id, p_brand, [p_size::DOUBLE] AS vec FROM part")
def read_var(spark: SparkSession, d: str) -> DataFrame:
    """Column annotations with their vector; no entry is read."""
    a = T.stored(spark, d)
    return a.var().join(a.part("varm", "size"), "col_id").select("col_id", "p_brand", "vec")


@query(f"WITH {LAY} SELECT row_id, label, o_orderstatus FROM lay")
def read_obs(spark: SparkSession, d: str) -> DataFrame:
    return T.stored(spark, d).obs().select("row_id", "label", "o_orderstatus")


@query(f"WITH {LAY}, {REQ} SELECT req.pos, [o_totalprice, o_orderkey::DOUBLE] AS vec FROM req JOIN lay USING (row_id) JOIN orders ON lay.pos = o_orderkey")
def gather_annotated_obsm(spark: SparkSession, d: str) -> DataFrame:
    return T.stored(spark, d).annotated(REQUEST)["obsm"]["totals"].select("pos", "vec")


@query(f"WITH {EDGES}, sel AS (SELECT row_id AS pos, row_id FROM lay WHERE row_id < 600) SELECT a.pos AS src_pos, b.pos AS dst_pos, weight FROM edges JOIN sel a ON a.row_id = src JOIN sel b ON b.row_id = dst")
def gather_annotated_obsp(spark: SparkSession, d: str) -> DataFrame:
    """The graph among requested rows: both ends are requested."""
    a = T.stored(spark, d)
    return a.annotated(list(range(min(600, a.shape[0]))))["obsp"]["next"]


@query(f"WITH {LAY}, {SPANS} SELECT row_id - start AS pos, pos AS o_orderkey, o_orderstatus FROM lay, spans WHERE spans.label = '1-URGENT' AND row_id >= start AND row_id < stop")
def read_group_annotated(spark: SparkSession, d: str) -> DataFrame:
    return T.stored(spark, d).group_annotated("1-URGENT")["obs"].select("pos", "o_orderkey", "o_orderstatus")


@query(f"WITH {EDGES}, {SPANS}, g AS (SELECT start, stop FROM spans WHERE label = '1-URGENT') SELECT src - start AS src_pos, dst - start AS dst_pos, weight FROM edges, g WHERE src >= start AND src < stop AND dst >= start AND dst < stop")
def read_group_graph(spark: SparkSession, d: str) -> DataFrame:
    return T.stored(spark, d).group_annotated("1-URGENT")["obsp"]["next"]


@query(f"WITH {LAY}, p AS (SELECT l_orderkey AS pos, l_partkey AS col_id, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2) SELECT row_id, col_id, value FROM p JOIN lay USING (pos) WHERE row_id < 100")
def layer_slice(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a layer in the storage order of the whole archive."""
    return T.stored(spark, d).rows(0, 100, "layer:price")


@query(f"WITH {MAT} SELECT row_id, col_id, CAST(value AS FLOAT) AS value FROM x")
def read_cast_back(spark: SparkSession, d: str) -> DataFrame:
    """All entries in the types of the read plan: small counts come back as float32."""
    return T.stored(spark, d).read()


STORED = f"""{LAY}, {ENT}, {SPANS}, {NNZ}, g AS (SELECT ord, label, role, CAST(sum(nnz) * 4 AS BIGINT) AS bytes FROM nnz JOIN spans USING (label) GROUP BY 1, 2, 3),
  target AS (SELECT CAST(count(*) * 4 // 3 AS BIGINT) AS t FROM ent),
  fold AS (SELECT ord, label, role, bytes, bytes AS cur, CAST(0 AS BIGINT) AS shard FROM g WHERE ord = 0
    UNION ALL SELECT g.ord, g.label, g.role, g.bytes,
      CASE WHEN g.role <> 'reference' AND (f.role = 'reference' OR f.cur + g.bytes > t) THEN g.bytes ELSE f.cur + g.bytes END,
      f.shard + CASE WHEN g.role <> 'reference' AND (f.role = 'reference' OR f.cur + g.bytes > t) THEN 1 ELSE 0 END
    FROM fold f JOIN g ON g.ord = f.ord + 1, target),
  bounds AS (SELECT shard, min(start) AS row_start, max(stop) AS row_stop, CAST(sum(bytes) AS BIGINT) AS bytes FROM fold JOIN spans USING (label) GROUP BY shard)"""


@query(rec(STORED, "SELECT shard, row_start, row_stop, bytes // 4 AS nnz, bytes FROM bounds"))
def stored_shards(spark: SparkSession, d: str) -> DataFrame:
    """The shards that an archive was written with."""
    return T.stored(spark, d).table("shards").select("shard", "row_start", "row_stop", "nnz", "bytes")


@query(rec(STORED, "SELECT row_id - row_start AS row_id, col_id, value FROM ent JOIN lay USING (pos), bounds WHERE shard = 1 AND row_id >= row_start AND row_id < row_stop"))
def read_shard(spark: SparkSession, d: str) -> DataFrame:
    return shown(T.stored(spark, d).shard(1))


@query(rec(STORED, "SELECT row_id, col_id, value FROM ent JOIN lay USING (pos), bounds WHERE shard = (SELECT shard FROM fold WHERE role = 'reference' LIMIT 1) AND row_id >= row_start AND row_id < row_stop"))
def read_reference_shard(spark: SparkSession, d: str) -> DataFrame:
    return shown(T.stored(spark, d).reference_shard())


@query(rec(STORED, "SELECT shard, label, sum(nnz.nnz) AS entries FROM fold JOIN spans USING (label) JOIN nnz USING (label) WHERE fold.role <> 'reference' GROUP BY 1, 2"))
def iterate_shards(spark: SparkSession, d: str) -> DataFrame:
    """Each shard in turn with its groups: entries of each group, by its local rows."""
    out = None
    for number, slices, cells in T.stored(spark, d).group_shards():
        here = cells.join(F.broadcast(slices), (F.col("row_id") >= F.col("lo")) & (F.col("row_id") < F.col("hi"))).groupBy("label").agg(F.count(F.lit(1)).alias("entries"))
        here = here.select(F.lit(number).alias("shard"), "label", "entries")
        out = here if out is None else out.union(here)
    return out


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_id, o_orderstatus = 'F' AS is_ref FROM orders")
def reference_mask(spark: SparkSession, d: str) -> DataFrame:
    """A reference by a condition on rows."""
    obs = T.numbered_obs(spark, d)
    return layout.with_reference(obs, F.col("o_orderstatus") == "F", label="o_orderpriority", position="row_id").select("row_id", "is_ref")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_id, o_orderpriority IN ('1-URGENT', '5-LOW') AS is_ref FROM orders")
def reference_labels(spark: SparkSession, d: str) -> DataFrame:
    return layout.with_reference(T.numbered_obs(spark, d), ["5-LOW", "1-URGENT"], label="o_orderpriority", position="row_id").select("row_id", "is_ref")


@query(f"WITH {MAT} SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY col_id) - 1 AS BIGINT) AS k, col_id FROM x")
def gaps_inverted(spark: SparkSession, d: str) -> DataFrame:
    return structure.columns_from_gaps(structure.delta_gaps(shown(T.stored(spark, d).family())))


# --- structure

@query(f"WITH {LAY}, {ENT}, {NNZ} SELECT row_id, nnz FROM nnz")
def row_nnz(spark: SparkSession, d: str) -> DataFrame:
    placed = T.order(spark, d)
    return structure.row_nnz(T.matrix(spark, d, placed), placed)


@query(f"WITH {LAY}, {ENT}, {NNZ} SELECT row_id, CAST(coalesce(sum(nnz) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS indptr FROM nnz")
def indptr(spark: SparkSession, d: str) -> DataFrame:
    return structure.indptr(row_nnz(spark, d))


@query(f"WITH {MAT} SELECT row_id, CAST(row_number() OVER w - 1 AS BIGINT) AS k, CAST(col_id - coalesce(lag(col_id) OVER w, 0) AS BIGINT) AS gap FROM x WINDOW w AS (PARTITION BY row_id ORDER BY col_id)")
def delta_gaps(spark: SparkSession, d: str) -> DataFrame:
    return structure.delta_gaps(T.matrix(spark, d))


@query(f"WITH {MAT}, c AS (SELECT row_id, list(CAST(col_id AS VARCHAR) || ':' || CAST(value AS VARCHAR) ORDER BY col_id) AS t FROM x GROUP BY row_id) SELECT row_id, sha256(array_to_string(t, ',')) AS sha256 FROM c")
def row_digest(spark: SparkSession, d: str) -> DataFrame:
    return structure.row_digest(T.matrix(spark, d))


@query(f"WITH {MAT}, c AS (SELECT row_id, list(CAST(col_id AS VARCHAR) || ':' || CAST(value AS VARCHAR) ORDER BY col_id) AS t FROM x GROUP BY row_id) SELECT row_id, sha256(array_to_string(t, ',')) AS sha256, row_id >= 10 AS ok FROM c")
def verify_payload(spark: SparkSession, d: str) -> DataFrame:
    """Digests that were written with an archive against those of its entries, of which the first ten rows' were changed since."""
    a = T.stored(spark, d)
    now = structure.row_digest(a.family().withColumn("value", F.when(F.col("row_id") < 10, F.col("value") + 1).otherwise(F.col("value"))))
    then = a.table("digests")
    return then.join(now.withColumnRenamed("sha256", "now"), "row_id").select("row_id", "sha256", (F.col("now") == F.col("sha256")).alias("ok"))


# --- packing

def packed(spark: SparkSession, d: str):
    placed = T.order(spark, d)
    spans = runtime.saved(layout.group_spans(placed))
    nnz = structure.row_nnz(T.matrix(spark, d, placed), placed).join(placed.select("row_id", "label"), "row_id")
    groups = runtime.saved(layout.group_bytes(spans, nnz, 4))
    target = groups.agg(F.sum("bytes")).first()[0] // 3
    return placed, spans, layout.pack_shards(groups, target=target)


@query(rec(PACK, "SELECT label, shard FROM fold"))
def pack_shards(spark: SparkSession, d: str) -> DataFrame:
    return packed(spark, d)[2].select("label", "shard")


@query(rec(PACK, "SELECT row_id, shard FROM lay JOIN bounds ON row_id >= row_start AND row_id < row_stop"))
def shard_map(spark: SparkSession, d: str) -> DataFrame:
    placed, spans, shards = packed(spark, d)
    return layout.shard_of_rows(placed.select("row_id"), layout.shard_bounds(shards, spans))


@query(rec(PACK, "SELECT shard FROM bounds WHERE row_start < 100 AND row_stop > 40"))
def shards_for_range(spark: SparkSession, d: str) -> DataFrame:
    _, spans, shards = packed(spark, d)
    return layout.shards_of_range(layout.shard_bounds(shards, spans), 40, 100)


@query(rec(PACK, "SELECT shard, label, start - min(start) OVER (PARTITION BY shard) AS lo, stop - min(start) OVER (PARTITION BY shard) AS hi FROM fold JOIN spans USING (label) WHERE spans.role <> 'reference'"))
def iter_group_shards(spark: SparkSession, d: str) -> DataFrame:
    _, spans, shards = packed(spark, d)
    return layout.local_slices(shards, spans)


@query("""WITH n AS (SELECT count(*) AS n FROM orders), k AS (SELECT unnest(range(7)) AS shard)
SELECT shard, CAST(round_even(shard * n / 7.0::DOUBLE, 0) AS BIGINT) AS row_start, CAST(round_even((shard + 1) * n / 7.0::DOUBLE, 0) AS BIGINT) AS row_stop FROM n, k""")
def split_even_shards(spark: SparkSession, d: str) -> DataFrame:
    return layout.split_even(T.obs(spark, d).agg(F.count(F.lit(1)).alias("n")), 7)


@query(f"""WITH {LAY}, {ENT}, {NNZ}, p AS (SELECT row_id, coalesce(sum(nnz) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS indptr FROM nnz),
b AS (SELECT indptr // 500 AS b, min(row_id) AS lo, max(row_id) + 1 AS hi FROM p GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY lo) - 1 AS BIGINT) AS block, lo, hi FROM b""")
def plan_blocks(spark: SparkSession, d: str) -> DataFrame:
    return structure.blocks(indptr(spark, d), most=1000)


@query("""WITH s AS (SELECT DISTINCT l_partkey + l_suppkey AS shard FROM lineitem WHERE l_quantity = 50), r AS (SELECT shard, shard - row_number() OVER (ORDER BY shard) AS run FROM s),
c AS (SELECT shard, run, (row_number() OVER (PARTITION BY run ORDER BY shard) - 1) // 4 AS chunk FROM r) SELECT CAST(dense_rank() OVER (ORDER BY run, chunk) - 1 AS BIGINT) AS batch, shard FROM c""")
def form_batches(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with gaps of their own: sums of part and supplier keys of the largest orders."""
    shards = T.read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity").where("l_quantity = 50").select((F.col("l_partkey") + F.col("l_suppkey")).alias("shard")).distinct()
    return layout.batches(shards, 4)


# --- types and checks

def narrow(hi: str) -> str:
    return f"CASE WHEN {hi} <= 255 THEN 'uint8' WHEN {hi} <= 65535 THEN 'uint16' WHEN {hi} <= 4294967295 THEN 'uint32' END"


STATS = "s AS (SELECT min(v) AS lo, max(v) AS hi, bool_and(v = floor(v)) AS whole FROM (SELECT l_quantity AS v, 'quantity' AS matrix FROM lineitem UNION ALL SELECT l_extendedprice, 'price' FROM lineitem) GROUP BY matrix)"


def both(spark: SparkSession, d: str, make) -> DataFrame:
    x = T.read(spark, d, "lineitem", "l_quantity", "l_extendedprice")
    a, b = (make(dtypes.value_stats(x, c)) for c in ("l_quantity", "l_extendedprice"))
    return a.unionByName(b)


@query(f"WITH {STATS} SELECT CASE WHEN whole AND lo >= 0 THEN {narrow('hi')} END AS min_dtype FROM s")
def min_dtype(spark: SparkSession, d: str) -> DataFrame:
    return both(spark, d, dtypes.min_dtype)


@query(f"WITH {STATS} SELECT CASE WHEN whole AND lo >= 0 AND hi <= 4294967295 THEN 'integer' ELSE 'float' END AS codec, CASE WHEN whole AND lo >= 0 AND hi <= 4294967295 THEN 'uint32' ELSE 'float32' END AS value_dtype FROM s")
def codec_plan(spark: SparkSession, d: str) -> DataFrame:
    return both(spark, d, dtypes.codec_plan)


@query(f"WITH {STATS}, n AS (SELECT count(*) AS n FROM part) SELECT CASE WHEN whole AND lo >= 0 AND hi <= 65535 THEN 'uint16' WHEN whole AND lo >= 0 AND hi <= 4294967295 THEN 'uint32' ELSE 'float32' END AS data_dtype, CASE WHEN n - 1 <= 65535 THEN 'uint16' ELSE 'uint32' END AS index_dtype FROM s, n")
def storage_dtypes(spark: SparkSession, d: str) -> DataFrame:
    n = T.read(spark, d, "part", "p_partkey").count()
    return both(spark, d, lambda s: dtypes.storage_dtypes(s, n))


@query("SELECT CAST(count(*) AS BIGINT) AS violations FROM lineitem WHERE l_extendedprice <> floor(l_extendedprice)")
def lossless_cast_check(spark: SparkSession, d: str) -> DataFrame:
    x = T.read(spark, d, "lineitem", "l_extendedprice")
    return x.agg(F.count_if(dtypes.lossy(F.col("l_extendedprice"), "uint32")).alias("violations"))


@query("SELECT l_orderkey AS row_id, l_partkey AS col_id FROM lineitem WHERE l_partkey < 0 OR l_partkey >= 150")
def bounds_check(spark: SparkSession, d: str) -> DataFrame:
    x = T.read(spark, d, "lineitem", "l_orderkey", "l_partkey").toDF("row_id", "col_id")
    return structure.out_of_bounds(x, 150)


@query("SELECT l_orderkey AS row_id, l_partkey AS col_id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_check(spark: SparkSession, d: str) -> DataFrame:
    return structure.repeated_entries(T.read(spark, d, "lineitem", "l_orderkey", "l_partkey").toDF("row_id", "col_id"))


@query(f"WITH {LAY}, {SPANS}, cut AS (SELECT * FROM spans WHERE label <> '2-HIGH'), s AS (SELECT *, coalesce(lag(stop) OVER (ORDER BY start), 0) AS due, lead(start) OVER (ORDER BY start) IS NULL AS z FROM cut) SELECT label FROM s, (SELECT count(*) AS n FROM orders) WHERE start <> due OR stop <= start OR (z AND stop <> n)")
def tiling_check(spark: SparkSession, d: str) -> DataFrame:
    spans = layout.group_spans(T.order(spark, d)).where("label <> '2-HIGH'")
    return structure.tiling_faults(spans, F.lit(T.obs(spark, d).count()))


@query("""WITH last AS (SELECT l_orderkey AS row_id, l_partkey AS col_id, arg_max(l_extendedprice, l_shipdate::VARCHAR || lpad(l_linenumber::VARCHAR, 4, '0') || l_extendedprice::DECIMAL(18,2)::VARCHAR) AS value FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS row_id, c AS col_id, coalesce(value, 0) AS value FROM orders CROSS JOIN (SELECT CAST(p_partkey AS INTEGER) AS c FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)) LEFT JOIN last ON o_orderkey = row_id AND c = col_id""")
def csr_to_dense(spark: SparkSession, d: str) -> DataFrame:
    x = T.read(spark, d, "lineitem")
    k = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    x = x.select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id"), F.col("l_extendedprice").alias("value"), k.alias("k"))
    parts_ = T.read(spark, d, "part", "p_partkey", "p_retailprice")
    columns = parts_.join(F.broadcast(parts_.agg(F.max("p_retailprice").alias("p_retailprice"))), "p_retailprice").select(F.col("p_partkey").alias("col_id"))
    return structure.dense_cells(x, T.obs(spark, d).select(F.col("o_orderkey").alias("row_id")), columns).select("row_id", F.col("col_id").cast("int").alias("col_id"), "value")


@query("SELECT vec_id AS row_id, i - 1 AS col_id, embedding[i] AS value FROM (SELECT vec_id, embedding, CAST(unnest(range(1, len(embedding) + 1)) AS INTEGER) AS i FROM embeddings) WHERE embedding[i] <> 0")
def dense_to_csr(spark: SparkSession, d: str) -> DataFrame:
    return structure.stored_cells(T.read(spark, d, "embeddings", "vec_id", "embedding"), "embedding", "vec_id")


# --- combination

PARTS = "p AS (SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS part FROM orders), n AS (SELECT p.*, CAST(row_number() OVER (ORDER BY part, o_orderkey) - 1 AS BIGINT) AS row_id FROM p)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status as three parts, each numbered on its own, then one after the other."""
    obs = T.obs(spark, d)
    kinds = [F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", ~F.col("o_orderstatus").isin("F", "O")]
    each = [runtime.numbered(obs.where(k).select("o_orderkey", "o_orderpriority"), [F.col("o_orderkey")], "row_id") for k in kinds]
    all_ = combine.concat(each)
    return combine.shifted(all_, combine.offsets(all_.groupBy("part").agg(F.count(F.lit(1)).alias("n"))), ["row_id"])


@query(f"WITH {PARTS} SELECT row_id, o_orderkey, part FROM n")
def concat(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("row_id", "o_orderkey", "part")


def joined(spark: SparkSession, d: str, **options) -> archive.Archive:
    """Two archives, of the finished orders (reference F's urgent ones) and of the others, as one, grouped by priority."""
    key = (spark.sparkContext.applicationId, d, *options)
    if key not in _JOINED:
        m, made = T.source(spark, d), []
        for k, here in enumerate((F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "F")):
            rows = runtime.saved(runtime.numbered(m.obs.where(here).withColumnRenamed("row_id", "was"), [F.col("was")], "row_id"))
            perm = rows.select("was", "row_id")
            mine = lambda df, *c, perm=perm: archive.moved(df, perm, *c)
            part = archive.Matrix(rows.drop("was"), m.var, {"x": runtime.saved(mine(m.families["x"], "row_id"))}, "int64", obsm={"totals": mine(m.obsm["totals"], "row_id")}, varm=m.varm, obsp={"next": mine(m.obsp["next"], "src", "dst")}, uns=m.uns)
            made.append(archive.write(spark, f"{runtime.shared_dir(spark)}/part{k}-{uuid.uuid4().hex}", part, group_by="o_orderpriority", reference=T.REFERENCE))
        path = f"{runtime.shared_dir(spark)}/joined-{uuid.uuid4().hex}"
        archive.concat(spark, made, path, **options)
        _JOINED[key] = path
    return archive.open_(spark, _JOINED[key])


_JOINED: dict = {}
#: Each part in its own layout, one after the other, then in the layout of the whole.
JOINED = f"""part AS (SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS part FROM orders),
lay AS (SELECT o_orderkey AS pos, o_totalprice, o_orderpriority AS label, part, CAST(row_number() OVER (ORDER BY o_orderpriority <> '3-MEDIUM', o_orderpriority, part, o_orderkey) - 1 AS BIGINT) AS row_id FROM part)"""


@query(f"WITH {JOINED} SELECT row_id, pos AS o_orderkey, label, label = '3-MEDIUM' AS is_ref FROM lay")
def concat_reference(spark: SparkSession, d: str) -> DataFrame:
    """The reference of each part, by its place there, leads the whole."""
    return joined(spark, d).obs().select("row_id", "o_orderkey", "label", (F.col("role") == "reference").alias("is_ref"))


@query(f"WITH {JOINED}, {ENT} SELECT row_id, col_id, value FROM ent JOIN lay USING (pos)")
def concat_archives(spark: SparkSession, d: str) -> DataFrame:
    return shown(joined(spark, d).family())


@query(f"WITH {JOINED} SELECT row_id, [o_totalprice, pos::DOUBLE] AS vec FROM lay")
def concat_obsm(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d).part("obsm", "totals").select("row_id", "vec")


@query(f"""WITH {JOINED}, e AS (SELECT * FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL)
SELECT s.row_id AS src, t.row_id AS dst, b - a AS weight FROM e JOIN lay s ON s.pos = a JOIN lay t ON t.pos = b WHERE s.part = t.part""")
def concat_obsp(spark: SparkSession, d: str) -> DataFrame:
    """Block diagonal: edges within a part stay."""
    return joined(spark, d).part("obsp", "next").select("src", "dst", "weight")


@query(f"WITH {EDGES}, n AS (SELECT count(*) AS n FROM orders) SELECT src, dst, weight FROM edges UNION ALL SELECT src + n, dst + n, weight FROM edges, n")
def obsp_block_diagonal(spark: SparkSession, d: str) -> DataFrame:
    placed = T.order(spark, d)
    e = edges(spark, d, placed)
    both_ = combine.concat([e, e])
    n = placed.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("part"), "n")
    return combine.shifted(both_, combine.offsets(n), ["src", "dst"]).select("src", "dst", "weight")


FAMILIES = f"""{MAT}, f AS (SELECT 'x' AS family, row_id, col_id, CAST(value AS DOUBLE) AS value FROM x
UNION ALL SELECT 'raw', l_orderkey, l_partkey, l_quantity FROM lineitem
UNION ALL SELECT 'layer:price', l_orderkey, l_partkey, l_extendedprice FROM lineitem
UNION ALL SELECT 'modality:supplier', l_orderkey, l_suppkey, CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 2, 3)"""


def families(spark: SparkSession, d: str) -> DataFrame:
    li = T.read(spark, d, "lineitem")
    cell = lambda col, v: li.select(F.col("l_orderkey").alias("row_id"), F.col(col).alias("col_id"), v.alias("value"))
    supplier = li.groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("col_id")).agg(F.count(F.lit(1)).alias("value"))
    key = combine.family_key
    return combine.families({key("x"): T.matrix(spark, d), key("raw"): cell("l_partkey", F.col("l_quantity")), key("layer", "price"): cell("l_partkey", F.col("l_extendedprice")), key("modality", "supplier"): supplier})


@query(f"WITH {FAMILIES} SELECT family, row_id, col_id, value FROM f")
def families_decompose(spark: SparkSession, d: str) -> DataFrame:
    return families(spark, d)


for _name, _key in (("layer_read", "layer:price"), ("raw_read", "raw"), ("modality_read", "modality:supplier")):
    QUERIES[_name] = lambda spark, d, key=_key: combine.one_family(families(spark, d), key)
    ORACLES[_name] = f"WITH {FAMILIES} SELECT row_id, col_id, value FROM f WHERE family = '{_key}'"


# --- sinks and ingest

def dataset(spark: SparkSession, d: str) -> store.Dataset:
    placed = T.order(spark, d)
    path = f"{runtime.shared_dir(spark)}/dataset-{uuid.uuid4().hex}"
    return store.write(spark, path, {"obs": placed, "x": T.matrix(spark, d, placed)})


@query(f"WITH {MAT} SELECT row_id, col_id, value FROM x")
def roundtrip_write_read(spark: SparkSession, d: str) -> DataFrame:
    return dataset(spark, d).table("x").select("row_id", "col_id", "value")


@query(f"WITH {LAY} SELECT row_id, lower(label) AS label FROM lay")
def update_obs(spark: SparkSession, d: str) -> DataFrame:
    ds = dataset(spark, d)
    ds.update("obs", ds.table("obs").withColumn("label", F.lower("label")), key="row_id")
    return ds.table("obs").select("row_id", "label")


@query(f"WITH {MAT} SELECT row_id, CAST(col_id AS INTEGER) AS col_id, CAST(value AS INTEGER) AS value FROM x")
def reencode(spark: SparkSession, d: str) -> DataFrame:
    ds = dataset(spark, d)
    small = dtypes.lossless_cast(dtypes.lossless_cast(ds.table("x"), "uint16"), "int", "col_id")
    ds.update("x", small)
    return ds.table("x").select("row_id", "col_id", "value")


@query("SELECT event_id // 10 AS row_id, user_id AS col_id, count(*) AS value FROM events GROUP BY 1, 2")
def push_append_finalize(spark: SparkSession, d: str) -> DataFrame:
    rows = push.ingest(spark, f"{d}/events.parquet", ["event_id", "user_id"]).withColumn("row", F.floor(F.col("event_id") / 10))
    return push.finish(rows, row="row", col="user_id")


#: The line items of stretches of a thousand order keys, as blocks of a thousand rows that are pushed one after the other.
@query("SELECT l_orderkey AS row_id, l_partkey AS col_id, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2")
def push_blocks(spark: SparkSession, d: str) -> DataFrame:
    x = runtime.saved(T.entries(spark, d))
    last = x.agg(F.max("pos")).first()[0]
    step = last // 3 + 1
    with push.PushWriter(spark, f"{runtime.shared_dir(spark)}/pushed-{uuid.uuid4().hex}", n_vars=T.read(spark, d, "part", "p_partkey").count(), value_dtype="uint16") as w:
        for lo in range(0, last + 1, step):
            here = x.where((F.col("pos") >= lo) & (F.col("pos") < lo + step))
            w.add_block(step, here.select((F.col("pos") - lo).alias("row_id"), "col_id", "value"))
        obs = spark.range(w.n_obs).select(F.col("id").alias("row_id"))
        a = w.finalize(obs=obs, var=T.read(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("col_id")))
    return shown(a.family())


@query("SELECT l_orderkey AS row_id, l_partkey AS col_id, CAST(max(l_quantity) AS FLOAT) AS quantity, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2")
def families_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Two families put together again, cell by cell."""
    li = T.read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    cell = lambda v: li.select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id"), F.col(v).alias("value"))
    out = combine.side_by_side(combine.families({"raw": cell("l_quantity"), "layer:price": cell("l_extendedprice")}), ["raw", "layer:price"])
    return out.select("row_id", "col_id", F.col("raw").cast("float").alias("quantity"), F.col("layer_price").alias("price"))


@query("SELECT l_orderkey AS row_id, l_partkey AS col_id, CAST(max(l_extendedprice) AS FLOAT) AS value FROM lineitem GROUP BY 1, 2")
def write_float(spark: SparkSession, d: str) -> DataFrame:
    """Prices are no counts, so the writer falls back to float; float32 is asked for, and lossy at that."""
    li = T.read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_extendedprice")
    x = li.groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id")).agg(F.max("l_extendedprice").cast("float").alias("value"))
    x = runtime.saved(x)
    n = x.agg(F.max("row_id")).first()[0] + 1
    m = archive.Matrix(spark.range(n).select(F.col("id").alias("row_id")), T.read(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("col_id")), {"x": x}, "float32")
    a = archive.write(spark, f"{runtime.shared_dir(spark)}/float-{uuid.uuid4().hex}", m)
    return a.family().select("row_id", "col_id", "value")
