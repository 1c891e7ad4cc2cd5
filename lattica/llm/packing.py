"""Packing documents into sequences by minimum bin slack.

Documents are cut at the sequence length; what is left over of each is packed. The remaining lengths form a histogram with at most as
many entries as a sequence has tokens, whatever the corpus. For each window the longest remaining length is taken, a bitset
subset-sum finds the multiset of remaining lengths that fills the rest closest to capacity, and its counts are traced back. The same
pattern is used as often as the counts allow, so there are few patterns even for billions of windows. Pieces then find their place by
their rank among pieces of the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

PIECE = "doc_id long, tie long, start long, length int, doc_tokens long, ids_crc32 long, ids binary"


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most counts[l] of each l, with the largest sum up to room."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for l in sorted(counts, reverse=True):
        left, k = min(counts[l], room // l), 1
        while left > 0:
            k = min(k, left)
            steps.append((reach, l, k))
            reach |= (reach << (l * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, l, k in reversed(steps):
        if not before >> at & 1:
            at -= l * k
            used[l] = used.get(l, 0) + k
    return used


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(windows, lengths in each) until every count is used up."""
    counts, out = {l: c for l, c in counts.items() if c}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fill({l: c for l, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[l] // u for l, u in used.items())
        for l, u in used.items():
            counts[l] -= u * times
            if not counts[l]:
                del counts[l]
        out.append((times, used))
    return out


def places(found: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length, in the order of rank: which ranks a pattern takes, pieces a window, its first sequence and offset. Sorted by key."""
    rows, taken, sequence = [], {}, 0
    for times, used in found:
        offset = 0
        for l in sorted(used, reverse=True):
            first = taken.get(l, 0)
            rows.append((l << 48 | first, used[l], sequence, offset))
            taken[l] = first + times * used[l]
            offset += l * used[l]
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": cols[:, 0], "each": cols[:, 1], "sequence": cols[:, 2], "offset": cols[:, 3]}


def cut(docs: DataFrame, *, tokenizer: str, cuts: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    """The pieces of each document: full ones of `capacity` ids, then the rest. Null text: the end id alone."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = tokens.encoder(tokenizer, cuts)
        end = np.array([end_id], "<u4")
        schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for some in tokens.slices(batch):
                rows = []
                for doc, tie, ids in zip(some.column("doc_id").to_pylist(), some.column("tie").to_pylist(), enc.encode(some.column("text")), strict=True):
                    ids = np.concatenate([ids, end])
                    for a in range(0, len(ids), capacity):
                        piece = ids[a : a + capacity].tobytes()
                        rows.append((doc, tie, a, len(piece) // 4, len(ids), zlib.crc32(piece), piece if with_ids else None))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tie"), "text").mapInArrow(work, PIECE)


def pack(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", cuts: str = "byte", end_id: int = 1, capacity: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32, ids (little-endian 32-bit, or null), sequence_id, offset.

    Sequences hold at most `capacity` ids. A null or empty text is the end id alone. Repeated rows are documents of their own. Extra
    columns aren't read. An empty table gives no rows. Shuffled are the pieces' keys and lengths, and with with_ids the ids once.
    """
    spark = docs.sparkSession
    pieces = common.saved(cut(docs, tokenizer=tokenizer, cuts=cuts, end_id=end_id, capacity=capacity, with_ids=with_ids))
    # at most `capacity` rows
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    found = ([(counts.pop(capacity), {capacity: 1})] if counts.get(capacity) else []) + patterns(counts, capacity)
    table = places(found)
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(1024))
    ranked = common.running_sum(pieces.withColumn("bucket", bucket), ["length"], "bucket", [F.col(c) for c in ("doc_id", "start", "tie")], F.lit(1), "rank")
    columns = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "rank"]

    def settle(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(table["key"], length << 48 | rank, side="right") - 1
            here = rank - (table["key"][at] & ((1 << 48) - 1))
            each = table["each"][at]
            cols = [batch.column(c) for c in columns[:-1]] + [pa.array(table["sequence"][at] + here // each), pa.array(table["offset"][at] + here % each * length)]
            yield pa.record_batch(cols, names=[*columns[:-1], "sequence_id", "offset"])

    return ranked.select(*columns).mapInArrow(settle, "doc_id long, start long, length int, doc_tokens long, ids_crc32 long, ids binary, sequence_id long, offset long").withColumn("length", F.col("length").cast("long"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents", "doc_id", "text"), with_ids=False).drop("ids")
