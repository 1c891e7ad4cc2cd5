"""Exact top-k by inner product with vector-approximation files.

Every vector is stored twice: as cell numbers on a quantised grid, and exactly. A scan of the cells, in blocks of bounded size, bounds each
candidate's score from both sides; candidates below the k-th best lower bound of their query are ruled out, first within the block, then
over all blocks. Exact vectors are read for the rest alone, in the order of their upper bounds: the first of them give k exact scores,
and only those whose bound reaches the k-th of these are read after that.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS = 8


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """vec_id, v (array of long): floor(scale * x). Without vectors that are null or hold null or non-finite components.

    Null ids take no part. Rows that repeat a vec_id are candidates of their own; as a query an id counts once, with its smallest vector.
    """
    x = F.col(vector_col)
    sound = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"))


def grid(vectors: DataFrame, rows: int, *, bits: int = BITS, sample: int = 10_000) -> np.ndarray:
    """Cell edges, dimensions x (2**bits + 1): quantiles of a bounded sample (at most about `sample` vectors); the outer edges hold for all rows."""
    d = vectors.select(F.size("v")).first()[0]
    ends = vectors.select(F.posexplode("v")).groupBy("pos").agg(F.min("col"), F.max("col")).collect()  # a row for each dimension
    lo, hi = np.zeros(d), np.zeros(d)
    for pos, a, b in ends:
        lo[pos], hi[pos] = a, b
    some = np.array([r[0] for r in vectors.sample(min(1.0, sample / rows), seed=3).limit(2 * sample).select("v").collect()], float).reshape(-1, d)
    some = np.vstack([some, lo, hi])
    edges = np.quantile(some, np.linspace(0, 1, (1 << bits) + 1), axis=0).T
    edges[:, 0], edges[:, -1] = lo, hi
    return edges


def approximate(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each component."""
    return np.stack([np.clip(np.searchsorted(e, c, side="right") - 1, 0, len(e) - 2) for e, c in zip(edges, v.T, strict=True)], axis=1).astype(np.uint8)


def bounded(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, cells: np.ndarray, edges: np.ndarray, k: int):
    """(query's number, candidate's number, lower, upper) of a block's candidates that may be among the k best of a query."""
    dims = np.arange(cells.shape[1])
    low, high = edges[dims, cells], edges[dims, cells.astype(int) + 1]
    out: list[list] = [[], [], [], []]
    for q0 in range(0, len(queries), 128):
        part = queries[q0 : q0 + 128]
        up, down = np.maximum(part, 0).astype(float), np.minimum(part, 0).astype(float)
        slack = 1e-6 * (1 + np.abs(part).sum(axis=1, keepdims=True) * (1 + np.abs(edges).max()))  # for rounding
        best, least = up @ high.T + down @ low.T + slack, up @ low.T + down @ high.T - slack
        least[own[q0 : q0 + len(part), None] == ids[None, :]] = -np.inf
        sure = np.partition(least, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(part), -np.inf)
        q, c = np.nonzero((best >= sure[:, None]) & (least > -np.inf))
        for o, v in zip(out, (q + q0, c, least[q, c], best[q, c]), strict=True):
            o.append(v)
    return [np.concatenate(o) if o else np.zeros(0) for o in out]


def products(pairs: DataFrame, exact: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs(query_id, row, ...) with vec_id and score: the exact vectors of the pairs alone are read."""
    both = pairs.join(exact.select("row", "vec_id", "v"), "row").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return both.withColumn("score", F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)).drop("v", "q")


def top_k(vectors: DataFrame, *, k: int = 20, every: int = 20, bits: int = BITS, block_rows: int = 16384, block_queries: int = 4096) -> DataFrame:
    """vectors(vec_id, v) -> query_id, rank (from 1), vec_id, score: the k best others of each vector whose id is divisible by `every`.

    A query meets the vectors of its own length; rows that bear its id are no candidates. Of equal scores smaller ids come first. Fewer
    than k candidates: all. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    vectors = common.saved(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
    out = None
    # a row for each length that occurs
    for (d,) in vectors.select(F.size("v").alias("d")).distinct().where("d > 0").orderBy("d").collect():
        here = _top_k(vectors.where(F.size("v") == d), k, every, bits, block_rows, block_queries)
        out = here if out is None else out.unionByName(here)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def _top_k(vectors: DataFrame, k: int, every: int, bits: int, block_rows: int, block_queries: int) -> DataFrame:
    asked = common.saved(vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    # of equal vectors only those of the k + 1 smallest ids can be among the k best, and of one id k of them; limited before the shuffle
    same, one = Window.partitionBy("v").orderBy("vec_id"), Window.partitionBy("v", "vec_id").orderBy("row")
    vectors = vectors.withColumn("_n", F.row_number().over(one)).where(F.col("_n") <= k).withColumn("_id", F.dense_rank().over(same)).where(F.col("_id") <= k + 1)
    vectors = common.saved(vectors.select("row", "vec_id", "v"))
    rows = vectors.count()
    edges = grid(vectors, rows, bits=bits)
    n_blocks, n_parts = -(-rows // block_rows), -(-asked.count() // block_queries) or 1

    def cells_of(pdfs):
        for pdf in pdfs:
            v = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), -1)
            yield pdf[["row", "vec_id"]].assign(cells=[c.tobytes() for c in approximate(v, edges)])

    stored = common.saved(vectors.mapInPandas(cells_of, "row long, vec_id long, cells binary"))
    block, part = F.pmod(F.xxhash64("row"), F.lit(n_blocks)), F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(n_parts))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = stored.withColumn("block", block).withColumn("part", each(n_parts))
    queries = asked.select("vec_id", "v", part.alias("part"), each(n_blocks).alias("block"))

    def search(qs, cs):
        import pandas as pd

        own, empty = qs["vec_id"].to_numpy(), not len(qs) or not len(cs)
        cells = np.frombuffer(b"".join(cs["cells"]), "u1").reshape(-1, edges.shape[0])
        q, c, low, up = bounded(np.array(qs["v"].tolist(), np.int64), own, cs["vec_id"].to_numpy(), cells, edges, k) if not empty else [np.zeros(0, int)] * 4
        return pd.DataFrame({"query_id": own[q] if len(q) else [], "row": cs["row"].to_numpy()[c] if len(c) else [], "low": low, "up": up}).astype({"query_id": "int64", "row": "int64", "low": "float64", "up": "float64"})

    left = common.saved(queries.groupBy("block", "part").cogroup(candidates.groupBy("block", "part")).applyInPandas(search, "query_id long, row long, low double, up double"))
    by = Window.partitionBy("query_id")
    sure = left.select("query_id", "low", F.row_number().over(by.orderBy(F.desc("low"))).alias("at")).where(F.col("at") == k).select("query_id", F.col("low").alias("sure"))
    left = common.saved(left.join(sure, "query_id", "left").where(F.col("sure").isNull() | (F.col("up") >= F.col("sure"))).select("query_id", "row", "up", F.row_number().over(by.orderBy(F.desc("up"), "row")).alias("at")))
    first = common.saved(products(left.where(F.col("at") <= 2 * k), vectors, asked))
    kth = first.select("query_id", "score", F.row_number().over(by.orderBy(F.desc("score"))).alias("nth")).where(F.col("nth") == k).select("query_id", F.col("score").alias("kth"))
    rest = left.where(F.col("at") > 2 * k).join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("up") >= F.col("kth"))).select("query_id", "row", "up", "at")
    found = first.unionByName(products(rest, vectors, asked)).select("query_id", "row", "vec_id", "score")
    rank = F.row_number().over(by.orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
