"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingles gives two values, its minimum and its maximum, so `BANDS * ROWS` values take half as many
hash evaluations. Documents that agree on all values of a band meet in a bucket. Links are confirmed on the full shingle sets:
first between each document and the smallest one that it meets, then, in buckets that still hold several components, between all
members, a bounded block of them at a time. Buckets beyond that bound are put together by the families that they belong to, and a
family is dealt out by pairs of blocks: first one document of each of its components, then all if several components are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles
from .components import components

U = np.uint64
BANDS, ROWS = 24, 5
BLOCK = 256
_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, (2, BANDS * ROWS // 2), dtype=np.int64).astype(U)


def min_max(values: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the values under each permutation, side by side."""
    n = len(_SEEDS[0])
    low, high = np.full(n, U(2**64 - 1)), np.zeros(n, U)
    for at in range(0, len(values), 2048):
        h = (values[None, at : at + 2048] ^ _SEEDS[0][:, None]) * (_SEEDS[1][:, None] | U(1))
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    out = np.arange(BANDS, dtype=U)
    for c in min_max(values).reshape(BANDS, ROWS).T:
        out = shingles.mixed(out * U(0x9E3779B97F4A7C15) + c)
    return out.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, copy (128 bits of the word sequence), bands. A document without words has neither copy nor bands."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                h = shingles.word_hashes(shingles.lowered(text.as_py()))
                s = shingles.shingle_set(h, size)
                row = (doc, len(s), shingles.sequence_key(h) if len(s) else None, bands(s) if len(s) else None)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "n_shingles", "copy", "bands"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_shingles long, copy binary, bands array<long>")


def sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, shingles: the sorted shingle hashes as bytes."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [shingles.shingle_set(shingles.word_hashes(shingles.lowered(t.as_py())), size).tobytes() for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(got, pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, shingles binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common_ = int((both[1:] == both[:-1]).sum())
    return 100 * common_ >= percent * (len(a) + len(b) - common_)


def confirmed(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) that are linked on their full sets."""
    left = pairs.join(known.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(known.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = [linked(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U), percent) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(work, "a long, b long")


def spanning(ids: list[int], known: list[np.ndarray], roots: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between different components of a block's members that are enough to connect what is linked."""
    n, size = len(ids), np.array([len(s) for s in known])
    rows = np.repeat(np.arange(n), size)
    order = np.argsort(np.concatenate(known), kind="stable")
    values, rows = np.concatenate(known)[order], rows[order]
    fresh = np.append(True, values[1:] != values[:-1])
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number)[number] > 1  # hashes of one document alone can't be in an intersection
    number, rows = number[shared], rows[shared]
    if not len(number):
        return []
    number = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(number[-1]) + 1, 4096):
        here = slice(*np.searchsorted(number, [at, at + 4096]))
        m = np.zeros((n, 4096), np.float32)
        m[rows[here], number[here] - at] = 1
        both += m @ m.T
    ok = 100 * both.astype(np.int64) >= percent * (size[:, None] + size[None, :] - both.astype(np.int64))
    parent = {r: r for r in roots}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
        x, y = root(roots[i]), root(roots[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((ids[i], ids[j]))
    return out


def in_blocks(members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """members(key, doc_id, root, n): links (a, b) between components of the members of a key, n of them.

    Keys of up to BLOCK members are one group; others are dealt out to groups for each pair of blocks of BLOCK / 2.
    """
    blocks = F.ceil(F.col("n") / F.lit(BLOCK // 2)).cast("int")
    one = F.pmod(F.xxhash64("doc_id", "key"), blocks.cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("lo"), F.greatest(k, F.col("mine")).alias("hi")))
    dealt = members.withColumn("mine", F.when(F.col("n") <= BLOCK, F.lit(0)).otherwise(one))
    dealt = dealt.withColumn("cell", F.explode(F.when(F.col("n") <= BLOCK, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(pairs)))
    full = dealt.select("key", "cell", "doc_id", "root").join(known, "doc_id")

    def work(pdf):
        import pandas as pd

        out = spanning(pdf["doc_id"].tolist(), [np.frombuffer(s, U) for s in pdf["shingles"]], pdf["root"].tolist(), percent) if pdf["root"].nunique() > 1 else []
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return full.groupBy("key", "cell").applyInPandas(work, "a long, b long")


def near_dedup(docs: DataFrame, *, percent: int = 85, size: int = 5) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Linked are documents with 100 * intersection >= percent * union of their sets of `size`-word shingles (A-Z lower-cased). Texts that
    are null, empty or without words have an empty set and are linked with nothing. Documents of one word sequence are one class, which
    goes through the search once. Rows that repeat a doc_id are one document for linking, and each is returned. Null ids are
    linked with nothing. Extra columns aren't read. An empty table gives no rows.
    """
    sig = common.saved(signatures(docs, size))
    classes = common.saved(sig.where("doc_id is not null and copy is not null").groupBy("copy").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands")))
    rows = classes.select(F.col("class_id").alias("doc_id"), F.posexplode("bands").alias("band", "key"))
    met = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = common.saved(rows.join(met, "key").select("key", "band", "doc_id", "least", "n"))
    active = common.saved(buckets.groupBy("doc_id").agg(F.min("least").alias("least")))
    known = common.saved(sets(docs.select("doc_id", "text").join(active.select("doc_id"), "doc_id"), size).dropDuplicates(["doc_id"]))
    links = common.saved(confirmed(active.where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")), known, percent))
    links = common.saved(links.union(open_buckets(buckets, components(links), known, percent)))
    common.free(known, buckets, active)
    found = components(links).select(F.col("node").alias("class_id"), "root")
    of_copy = classes.select("copy", "class_id").join(found, "class_id", "left").select("copy", F.coalesce("root", "class_id").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "copy").join(of_copy, "copy", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def open_buckets(buckets: DataFrame, roots: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links in buckets whose members the first links left in several components."""
    b = buckets.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    b = common.saved(b.select("key", "band", "doc_id", "root", "n"))
    mixed = b.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    b = common.saved(b.join(mixed, "key"))
    small, large = b.where(F.col("n") <= BLOCK), b.where(F.col("n") > BLOCK)
    if large.isEmpty():
        return in_blocks(small.select("key", "doc_id", "root", "n"), known, percent)
    # large buckets of one family of texts overlap: their members are compared once, in the blocks of the family
    least = large.groupBy("key").agg(F.min("doc_id").alias("b"))
    family = components(common.saved(large.select("key", F.col("doc_id").alias("a")).join(least, "key").where("a <> b").select("a", "b").distinct()))
    each = large.select("doc_id", "root").distinct().join(family.select(F.col("node").alias("doc_id"), F.col("root").alias("key")), "doc_id")
    each = common.saved(each.select("key", "doc_id", "root"))
    # one document for each component first; all of them only where a family still holds several
    heads = common.saved(each.groupBy("key", "root").agg(F.min("doc_id").alias("doc_id")))
    first = common.saved(in_blocks(counted(heads), known, percent))
    ends = [first.join(heads.select(F.col("doc_id").alias(c), F.col("root").alias(f"r{c}")), c) for c in "ab"]
    met = ends[0].join(ends[1], ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    now = components(met).select(F.col("node").alias("root"), F.col("root").alias("now"))
    each = each.join(now, "root", "left").select("key", "doc_id", F.coalesce("now", "root").alias("root"))
    still = each.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = common.saved(each.join(still, "key"))
    return first.union(in_blocks(small.select("key", "doc_id", "root", "n").union(counted(rest)), known, percent))


def counted(members: DataFrame) -> DataFrame:
    """members(key, doc_id, root) with n, how many a key has."""
    return members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").select("key", "doc_id", "root", "n")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(common.table(spark, sf_dir, "documents", "doc_id", "text"))
