"""Exact repeated substrings by the interval tree of an enhanced suffix array.

Where two texts share `LENGTH` bytes, those bytes hold the same anchor: the gram with the least hash of all grams in them. Suffixes
that begin in a window of `LENGTH` bytes are dealt out by the anchor of their window, so equal windows meet in one task, and only
anchors that occur twice are looked at. Each task builds an enhanced suffix array of its suffixes (order, common prefixes, left
neighbours), scans it with a stack for the intervals of common prefixes of LENGTH bytes or more, and keeps those whose left extensions
differ: maximal repeats, with all their occurrences. In each, every occurrence but the first is a repeat. Suffixes whose windows occur
once, or always after the same byte, begin no such repeat and are left out before the sort.

Documents are numbered in the order of (doc_id, text's hash), so rows that repeat a doc_id with other texts are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.runtime import numbered

from . import common
from .shingles import U, mixed, powers

#: The length of a repeat, of an anchor's gram, and occurrences of an anchor that one task takes at most.
LENGTH, GRAM, TOGETHER = 100, 24, 4096
CHUNK = 1 << 18
SEGMENT = "anchor long, salt int, n long, doc long, at long, windows int, bytes binary"
FOUND = "kind int, doc long, start long, stop long, length long, group_id long, c1 long, c2 long"


def grams(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes [i, i + size) for each i."""
    if len(data) < size:
        return np.zeros(0, U)
    p, inverse = powers(len(data) + 1)
    value = mixed(np.arange(1, 257, dtype=U) + U(256 * seed))[data]
    total = np.concatenate([np.zeros(1, U), np.cumsum(value * p[: len(data)], dtype=U)])
    return mixed((total[size:] - total[:-size]) * inverse[: len(data) - size + 1])


def anchors(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of each anchor of some texts laid end to end, edges[k] being where text k begins: the leftmost gram of
    least hash in windows of LENGTH bytes, of which as many in a row hold it from the first on. No window crosses an edge."""
    parts, width = [], LENGTH - GRAM + 1
    last = edges[1:] - LENGTH  # of the windows of a text
    for at in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        h = grams(data[at : at + CHUNK + LENGTH - 1], GRAM)
        low, k = (h & ~U(0x1FFFFF)) | np.arange(len(h), dtype=U), 1  # ties within a window go to the left
        while 2 * k <= width:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        if k < width:
            low = np.minimum(low[: len(low) - (width - k)], low[width - k :])
        pos = (low & U(0x1FFFFF)).astype(np.int64)
        sound = np.zeros(len(pos) + 1, np.int64)
        a, z = np.clip(edges[:-1] - at, 0, len(pos)), np.clip(last + 1 - at, 0, len(pos))
        some = z > a
        np.add.at(sound, a[some], 1)
        np.add.at(sound, z[some], -1)
        pos = np.where(np.cumsum(sound[:-1]) > 0, pos, -1)
        first = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
        count = np.diff(np.append(first, len(pos)))
        first, count = first[pos[first] >= 0], count[pos[first] >= 0]
        parts.append((h[pos[first]], first + at, count))
    if not parts:
        return np.zeros(0, U), *[np.zeros(0, np.int64)] * 2
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """Stack scan: (length, first, last) of every interval of the common-prefix tree of at least `least`; lcp[i] is that of suffixes i - 1 and i."""
    out, stack = [], [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, left = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack[-1][0] > now:
            depth, left = stack.pop()
            if depth >= least:
                out.append((depth, left, i - 1))
        if stack[-1][0] < now:
            stack.append((now, left))
    return out


def maximal_repeats(doc: np.ndarray, at: np.ndarray, count: np.ndarray, text: np.ndarray):
    """Maximal repeats among segments, as (group, length, doc, position, first) with a row for each occurrence.

    `text` has the segments end to end; segment s holds count[s] windows, of which the first begins at at[s] in its document. Groups are
    numbered from 0, their occurrences in the order of (doc, position), and `first` marks the first of each.
    """
    size = count + LENGTH - 1
    base = np.cumsum(size) - size
    seg = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    start = base[seg] + k
    # windows that are equal by their hash; whether they are is seen in the common prefixes below
    h = grams(text, LENGTH)[start]
    order = np.argsort(h, kind="stable")
    edge = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    times = np.diff(np.append(edge, len(h)))
    left = np.where(k > 0, text[start - 1].astype(np.int16), np.int16(-2))[order]  # at a segment's edge the window before is elsewhere: as if it differed
    low, high = np.minimum.reduceat(left, edge), np.maximum.reduceat(left, edge)
    # classes that repeat with different left neighbours; no part of another class can be a maximal repeat
    class_ = np.flatnonzero((times > 1) & ((low != high) | (low == -2)))
    none = np.zeros(0, np.int64)
    if not len(class_):
        return none, none, none, none, none.astype(bool)
    number = np.repeat(np.arange(len(class_)), times[class_])
    wanted = order[np.repeat(edge[class_] - np.cumsum(times[class_]) + times[class_], times[class_]) + np.arange(len(number))]
    del h, order, left
    # in the order of the bytes; suffixes that differ within LENGTH have no interval in common, so their order among each other is free
    room = (count[seg] - 1 - k)[wanted]
    reach = -(-max(1, int(room.max())) // 8) * 8
    step = np.arange(reach)
    rest = np.where(step < room[:, None], np.append(text, np.zeros(reach, np.uint8))[(start[wanted] + LENGTH)[:, None] + step], np.uint8(0))
    by = np.lexsort((room, *rest.view(">u8").astype(U).T[::-1], number))
    wanted, number, room, rest = wanted[by], number[by], room[by], rest[by]
    same = rest[1:] == rest[:-1]
    beyond = np.minimum(np.where(same.all(axis=1), reach, np.argmin(same, axis=1)), np.minimum(room[1:], room[:-1]))
    head = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    equal = number[1:] == number[:-1]
    for a in range(0, len(equal), 1 << 16):
        some = np.flatnonzero(equal[a : a + (1 << 16)]) + a
        equal[some] = (head[start[wanted[some]]] == head[start[wanted[some + 1]]]).all(axis=1)
    lcp = np.append(0, np.where(equal, LENGTH + beyond, 0))
    found = np.array(intervals(lcp.tolist(), LENGTH), np.int64).reshape(-1, 3)
    sides = np.where(k[wanted] > 0, text[start[wanted] - 1].astype(np.int16), np.int16(-2))
    changes = np.cumsum(np.append(0, (sides[1:] != sides[:-1]) | (sides[1:] == -2)))
    found = found[(changes[found[:, 2]] > changes[found[:, 1]]) | (sides[found[:, 1]] == -2)]
    members = found[:, 2] - found[:, 1] + 1
    group = np.repeat(np.arange(len(found)), members)
    which = wanted[np.arange(len(group)) - np.repeat(np.cumsum(members) - members, members) + np.repeat(found[:, 1], members)]
    d, p = doc[seg[which]], at[seg[which]] + k[which]
    by = np.lexsort((p, d, group))
    first = np.append(True, group[1:] != group[:-1]) if len(group) else none.astype(bool)
    return group, np.repeat(found[:, 0], members), d[by], p[by], first


def covered(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, length) of the maximal runs that some spans cover."""
    if not len(doc):
        return doc, start, length
    by = np.lexsort((start, doc))
    doc, start, stop = doc[by], start[by], (start + length)[by]
    # each document in a stretch of its own, so that one running maximum serves all
    base = np.cumsum(np.append(0, doc[1:] != doc[:-1])) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(base + stop)
    fresh = np.flatnonzero(np.append(True, (base + start)[1:] > reach[:-1]))
    last = np.append(fresh[1:], len(doc)) - 1
    return doc[fresh], start[fresh], reach[last] - base[last] - start[fresh]


def first_windows(doc: np.ndarray, at: np.ndarray, count: np.ndarray, text: np.ndarray):
    """(128 bits of the window, doc, position) of the first occurrence of each window of some segments."""
    size = count + LENGTH - 1
    seg = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(size) - size)[seg] + k
    a, b = grams(text, LENGTH)[start], grams(text, LENGTH, 1)[start]
    d, p = doc[seg], at[seg] + k
    by = np.lexsort((p, d, b, a))
    a, b, d, p = a[by], b[by], d[by], p[by]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return a[fresh].view(np.int64), b[fresh].view(np.int64), d[fresh], p[fresh]


def slices(batch, most: int = 4_000_000) -> Iterator:
    """An Arrow batch with a column `raw` in slices of about so many bytes."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column("raw")), 0).to_numpy().astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1).tolist(), batch.num_rows]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield batch.slice(a, z - a)


def parts(batch) -> Iterator:
    """slices() with the bytes laid end to end and the edges of its rows."""
    for part in slices(batch):
        rows = [x or b"" for x in part.column("raw").to_pylist()]
        yield part, np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


def anchor_rows(docs: DataFrame) -> DataFrame:
    """docs(doc_id, row, raw) -> anchor, doc_id, row, first, windows."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part, data, edges in parts(batch):
                h, first, count = anchors(data, edges)
                doc = np.searchsorted(edges, first, side="right") - 1
                which = pa.array(doc)
                cols = [pa.array(h.view(np.int64)), part.column("doc_id").take(which), part.column("row").take(which), pa.array(first - edges[doc]), pa.array(count.astype(np.int32))]
                yield pa.record_batch(cols, names=["anchor", "doc_id", "row", "first", "windows"])

    return docs.mapInArrow(work, "anchor long, doc_id long, row long, first long, windows int")


def segments(texts: DataFrame) -> DataFrame:
    """texts(doc, raw, hits array of (anchor, n, first, windows)): the bytes of each anchor's windows. Anchors of many places are dealt out by place."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            for part, data, edges in parts(batch):
                hits = part.column("hits")
                rows, flat = np.repeat(np.arange(part.num_rows), np.diff(hits.offsets.to_numpy())), hits.flatten()
                anchor, n, first, windows = (flat.field(c).to_numpy() for c in ("anchor", "n", "first", "windows"))
                doc = part.column("doc").to_numpy()[rows]
                salt = (mixed(doc.view(U) * U(0x9E3779B97F4A7C15) + first.view(U) // U(4096)) % (-(-n // TOGETHER)).astype(U)).astype(np.int32)
                for a in range(0, len(rows), 1 << 14):
                    z = slice(a, a + (1 << 14))
                    size = windows[z].astype(np.int64) + LENGTH - 1
                    ends = np.append(0, np.cumsum(size))
                    own = data[np.repeat(edges[rows[z]] + first[z] - ends[:-1], size) + np.arange(ends[-1])]
                    raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own)])
                    cols = [pa.array(c[z], t) for c, t in zip((anchor, salt, n, doc, first, windows), kinds, strict=True)]
                    yield pa.record_batch([*cols, raw], names=[x.split()[0] for x in SEGMENT.split(", ")])

    return texts.mapInArrow(work, SEGMENT)


def solved(cut: DataFrame, most_bytes: int = 1 << 20, *, places: bool = True) -> DataFrame:
    """From segments: kind 0, an occurrence (doc, start, stop) of the maximal repeat group_id, length bytes long, kind 1 if it is its first
    (with c1, a hash of the places of all relative to the first, and c2, how many they are); kind 2, the first occurrence of a window (c1, c2) within
    one part of an anchor that is dealt out in several. Without `places`, kind 0 is a run (doc, start, stop) that repeats of one task cover
    together, and there is no kind 1."""
    dealt = cut.repartition(common.partitions(cut.sparkSession), "anchor", "salt").sortWithinPartitions("anchor", "salt", "doc", "at")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        names = [x.split()[0] for x in FOUND.split(", ")]
        kinds = [pa.int32(), *[pa.int64()] * 7]
        number = TaskContext.get().partitionId() << 40

        def table(kind, doc, start, length, group=None, c1=None, c2=None):
            cols = [np.asarray(kind, np.int32), doc, start, start + length, length, group, c1, c2]
            return pa.record_batch([pa.nulls(len(doc), t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        def solve(held):
            nonlocal number
            doc, at, windows, n = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("doc", "at", "windows", "n")]
            raw = [b.column("bytes") for b in held]
            data = np.concatenate([np.frombuffer(x.buffers()[2], np.uint8)[slice(*np.frombuffer(x.buffers()[1], np.int32)[[x.offset, x.offset + len(x)]])] for x in raw])
            windows = windows.astype(np.int64)
            fresh = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))  # a row that repeats has the places of the other
            if not fresh.all():
                data = data[np.repeat(fresh, windows + LENGTH - 1)]
                doc, at, windows, n = doc[fresh], at[fresh], windows[fresh], n[fresh]
            group, length, d, p, first = maximal_repeats(doc, at, windows, data)
            if len(group) and not places:
                d, p, size = covered(d[~first], p[~first], length[~first])
                yield table(np.zeros(len(d)), d, p, size)
            elif len(group):
                edge = np.flatnonzero(first)
                times = np.diff(np.append(edge, len(group)))
                apart = mixed(d.view(U) ^ mixed((p - np.repeat(p[edge], times)).view(U)))
                about = [pa.array(np.repeat(c, times), mask=~first) for c in (np.add.reduceat(apart, edge).view(np.int64), times)]
                yield table(first, d, p, length, group + number, *about)
                number += int(group[-1]) + 1
            split = n > TOGETHER
            if split.any():
                own = np.repeat(split, windows + LENGTH - 1)
                a, b, d, p = first_windows(doc[split], at[split], windows[split], data[own])
                yield table(np.full(len(d), 2), d, p, np.full(len(d), LENGTH), None, a, b)

        held, size, last = [], 0, None
        for batch in batches:
            key, salt = batch.column("anchor").to_numpy(), batch.column("salt").to_numpy()
            bytes_ = np.append(0, np.cumsum(batch.column("windows").to_numpy().astype(np.int64) + LENGTH - 1))
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist(), batch.num_rows]
            begin = 0  # of what is not yet held
            for a, z in zip(edges, edges[1:], strict=False):
                now = (int(key[a]), int(salt[a]))
                if now != last and size + bytes_[a] - bytes_[begin] >= most_bytes:
                    if a > begin:
                        held.append(batch.slice(begin, a - begin))
                    yield from solve(held)
                    held, size, begin = [], 0, a
                last = now
            held.append(batch.slice(begin))
            size += int(bytes_[-1] - bytes_[begin])
        if held:
            yield from solve(held)

    return dealt.mapInArrow(work, FOUND)


def numbered_docs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, row, whole, n_bytes, doc, least: each document's number, and that of the first with the same text."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = docs.select("doc_id", common.row_key().alias("row"), F.sha2(raw, 256).alias("whole"), F.octet_length(raw).cast("long").alias("n_bytes"))
    each = numbered(light.groupBy("doc_id", "row", "whole").agg(F.max("n_bytes").alias("n_bytes")), [F.col("doc_id").asc_nulls_last(), F.col("whole")], "doc")
    each = common.saved(each)
    return common.saved(each.join(each.groupBy("whole").agg(F.min("doc").alias("least")), "whole"))


def same_row(left: str, right: str):
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.row") == F.col(f"{right}.row"))


def find(docs: DataFrame, *, places: bool = True) -> tuple[DataFrame, DataFrame]:
    """(found, each): solved() for the documents that are the first with their text; numbered_docs()."""
    each = numbered_docs(docs)
    raw = docs.select("doc_id", common.row_key().alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    firsts = each.where("doc = least").select("doc_id", "row", "doc")
    all_ = common.saved(anchor_rows(raw))
    often = common.saved(all_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    some = common.perhaps_in(all_, "anchor", often.select("anchor")).join(often, "anchor")
    hits = some.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "n", "first", "windows")).alias("hits"))
    hits = common.saved(hits.alias("l").join(firsts.alias("r"), same_row("l", "r")).select("r.*", "hits"))
    common.free(all_, often)
    # texts without such an anchor, and copies, stay where they are
    cut = common.perhaps_in(raw, "row", hits.select("row")).alias("l").join(hits.alias("r"), same_row("l", "r")).select("doc", "raw", "hits")
    found = common.saved(solved(segments(cut), places=places))
    common.free(hits)
    return found, each


def removable(found: DataFrame) -> DataFrame:
    """doc, spans: what repeats an earlier place, from find()."""
    own = found.where("kind = 0").select("doc", "start", "stop")
    split = found.where("kind = 2")
    least = split.groupBy("c1", "c2").agg(F.min(F.struct("doc", "start")).alias("least"))
    later = split.join(least, ["c1", "c2"]).where("doc <> least.doc or start <> least.start").select("doc", "start", "stop")
    return own.union(later).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def repeat_groups(docs: DataFrame) -> DataFrame:
    """Maximal repeats with all their occurrences: group_id, length, doc_id, start (in bytes), a row for each place.

    Where the same places go on from one anchor to the next, their repeats are one. Whole copies of a document are searched once and have
    no places of their own here. An anchor with more than TOGETHER places is dealt out; its groups hold the places of one part.
    """
    found, each = find(docs.select("doc_id", "text"))
    heads = found.where("kind = 1").select("group_id", "doc", "start", "stop", "c1", "c2")
    run = Window.partitionBy("c1", "c2", "doc").orderBy("start", "stop", "group_id")
    reach = F.max("stop").over(run.rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.withColumn("fresh", (reach.isNull() | (F.col("start") > reach - F.lit(LENGTH - 1))).cast("int"))
    heads = heads.withColumn("island", F.sum("fresh").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    whole = heads.groupBy("c1", "c2", "doc", "island").agg(F.min(F.struct("start", "group_id"))["group_id"].alias("group_id"), (F.max("stop") - F.min("start")).alias("length"))
    places = found.where("kind < 2").select("group_id", "doc", "start").join(whole.select("group_id", "length"), "group_id")
    return places.join(each.select("doc", "doc_id"), "doc").select("group_id", "length", "doc_id", "start")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[list[int]] = []
    for a, z in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def remove(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (maximal removed runs), kept (its remaining bytes).

    Texts are UTF-8 bytes; null counts as empty; texts under LENGTH bytes lose nothing. Of whole copies (under one hash) the one with the
    smallest doc_id is searched and the others go as a whole. Rows that repeat a doc_id with the same text are one document and are each
    returned; with other texts they are documents of their own, in the order of their hashes. Null ids come last. A long text is searched
    anchor by anchor; a run of one period is dealt out by place. Extra columns aren't read. An empty table gives no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    found, each = find(docs.select("doc_id", "text"), places=False)
    spans = common.saved(removable(found))
    common.free(found)
    copy = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    later = each.where((F.col("doc") != F.col("least")) & (F.col("n_bytes") >= LENGTH)).select("doc", copy.alias("spans"))
    spans = common.saved(each.select("doc", "doc_id", "row").join(spans.union(later), "doc").select("doc_id", "row", "spans"))
    # texts that lose nothing stay where they are
    mine = docs.select("doc_id", "text", common.row_key().alias("row"))
    some = common.perhaps_in(mine, "row", spans.select("row"))
    both = some.alias("l").join(spans.alias("r"), same_row("l", "r"), "left").select("l.doc_id", "text", "spans")
    both = both.union(common.surely_not_in(mine, "row", spans.select("row")).select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType)))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        run = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for part in slices(batch):
                runs, kept = [], []
                for raw, spans in zip(part.column("raw"), part.column("spans").to_pylist(), strict=True):
                    data, at, parts = raw.as_py(), 0, []
                    runs.append(merged(spans))
                    for a, z in runs[-1]:
                        parts.append(data[at:a])
                        at = z
                    kept.append(b"".join([*parts, data[at:]]) if parts else data)
                rows = [[{"start": a, "stop": z} for a, z in r] for r in runs]
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), pa.array(rows, run), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    both = both.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), raw.alias("raw"), "spans")
    return both.mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
