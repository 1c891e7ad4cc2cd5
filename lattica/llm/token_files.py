"""Token ids in files: fixed-width bit packing in blocks.

File format: Parquet rows (part, block, before, doc_ids, firsts, n_ids, bits, payload), in the order of (part, block). A block holds some
documents in ascending doc_id order; `before` ids of its part come before it. firsts[k] is where the ids of document k begin in the block; id i takes the bits
[i * bits, (i + 1) * bits) of payload, least significant bit first. `bits` is the least width that holds every id of the vocabulary.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

SCHEMA = "part int, block int, before long, doc_ids array<long>, firsts array<long>, n_ids long, bits int, payload binary"


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits; ids beyond them are an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} doesn't fit {bits} bits")
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """ids[first : first + count] of a block, reading no more than their bytes."""
    lo, hi = first * bits, (first + count) * bits
    flat = np.unpackbits(np.frombuffer(payload, np.uint8)[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + count * bits]
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat.reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def write(docs: DataFrame, path: str, *, tokenizer: str, cuts: str, end_id: int, block_ids: int = 1 << 17) -> None:
    """Encodes docs(doc_id, text) and writes them in ascending doc_id order (null first; repeated ids by text). Null text: the end id alone."""
    n = common.partitions(docs.sparkSession)
    ranged = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc = tokens.encoder(tokenizer, cuts)
        bits = width(max(enc.tokenizer.get_vocab_size(), end_id + 1))
        end = np.array([end_id], "<u4")
        part, block, before, held, names, firsts, size = TaskContext.get().partitionId(), 0, 0, [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("bits", pa.int32()), ("payload", pa.binary())])

        def row():
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "before": before, "doc_ids": names, "firsts": firsts, "n_ids": size, "bits": bits, "payload": pack(np.concatenate(held), bits)}], schema)

        for batch in batches:
            for some in tokens.slices(batch):
                for doc, ids in zip(some.column("doc_id").to_pylist(), enc.encode(some.column("text")), strict=True):
                    names.append(doc)
                    firsts.append(size)
                    held += [ids, end]
                    size += len(ids) + 1
                    if size >= block_ids:
                        yield row()
                        block, before, held, names, firsts, size = block + 1, before + size, [], [], [], 0
        if names:
            yield row()

    ranged.mapInArrow(work, SCHEMA).write.parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a written folder with `start`: ids in all blocks before. Broadcast is one row for each part: of a number set at writing."""
    files = spark.read.schema(SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").cast("long").alias("ids"))
    up = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(up), F.lit(0)).cast("long").alias("first"))
    return files.join(F.broadcast(parts), "part").withColumn("start", F.col("first") + F.col("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit integers), from the files."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                b = batch.slice(r, 1).to_pylist()[0]
                edges = [*b["firsts"], b["n_ids"]]
                ids = [unpack(b["payload"], b["bits"], a, z - a) for a, z in zip(edges, edges[1:], strict=False)]
                yield pa.record_batch(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array([b["start"] + a for a in b["firsts"]], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks(spark, path).mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer="word_bpe_49k.json", cuts="word", end_id=2)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
