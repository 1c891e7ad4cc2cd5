"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, as a whole; its tokens' character spans are interval-joined to the spans of its sections. A token that
crosses a boundary counts for the section in which it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common, tokens

SCHEMA = "doc_id long, section int, start long, stop long, n_tokens long, n_crossing long"


def section_starts(text, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow array of texts -> first section of each (and the number of all), and where sections begin, in characters of their text.

    A section begins with its text, and after each mark but one at the text's end.
    """
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    edges = np.frombuffer(text.buffers()[1], "<i4")[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data, edges = data[edges[0] : edges[-1]], edges - edges[0]
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # characters before a byte
    at = np.flatnonzero(data == mark) + 1
    doc = np.searchsorted(edges, at - 1, side="right") - 1
    inner = at < edges[doc + 1]
    at, doc = at[inner], doc[inner]
    n = np.bincount(doc, minlength=len(text)) + 1
    first = np.append(0, np.cumsum(n))
    starts = np.zeros(first[-1], np.int64)
    rank = np.arange(len(doc)) - (first[doc] - doc)
    starts[first[doc] + 1 + rank] = chars[at] - chars[edges[doc]]
    return first, starts


def attributed(enc: tokens.Encoder, text, mark: str, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them reach beyond its end. No token reaches beyond its piece; a piece without a mark lies in one section."""
    import pyarrow.compute as pc

    n, crossing = np.zeros(first[-1] + 1, np.int64), np.zeros(first[-1] + 1, np.int64)

    def split(x: str, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.array([k + 1 for k, c in enumerate(x) if c == mark], np.int64)
        section = np.searchsorted(ends, spans[:, 0], side="right")
        over = spans[:, 1] > np.append(ends, len(x))[section]
        return np.bincount(section, minlength=len(ends) + 1), np.bincount(section[over], minlength=len(ends) + 1)

    groups, whole = enc.pieces(text)
    for rows, edges, distinct, code in groups:
        held = enc.look_up(distinct)
        size, marks = enc.begin[held + 1] - enc.begin[held], pc.count_substring(distinct, mark).to_numpy().astype(np.int64)
        before = np.append(0, np.cumsum(marks[code]))
        here = np.repeat(first[rows] - before[edges[:-1]], np.diff(edges)) + before[:-1]
        plain = marks[code] == 0
        n += np.bincount(here[plain], size[code[plain]], len(n)).astype(np.int64)
        which = np.flatnonzero(marks)
        names = distinct.take(which).to_pylist()
        parts = [split(x, s) for x, s in zip(names, enc.spans(names), strict=True)]
        width = marks[which] + 1
        base = np.append(0, np.cumsum(width))
        flat = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1)]
        number = np.zeros(len(marks), np.int64)
        number[which] = np.arange(len(which))
        one = number[code[~plain]]
        step = np.arange(width[one].sum()) - np.repeat(np.cumsum(width[one]) - width[one], width[one])
        at, take = np.repeat(here[~plain], width[one]) + step, np.repeat(base[one], width[one]) + step
        n += np.bincount(at, flat[0][take], len(n)).astype(np.int64)
        crossing += np.bincount(at, flat[1][take], len(n)).astype(np.int64)
    for k in whole.tolist():
        x = text[k].as_py()
        for total, part in zip((n, crossing), split(x, enc.spans([x])[0]), strict=True):
            total[first[k] : first[k] + len(part)] += part
    return n[:-1], crossing[:-1]


def token_counts(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", cuts: str = "byte", mark: str = "\n") -> DataFrame:
    """One row per section of each document: doc_id, section (from 0), start and stop in characters, n_tokens, n_crossing.

    The counts of a document add up to its tokens. `mark`, one ASCII character, ends a section; a last mark opens no empty one. A null or
    empty text is one empty section with no tokens. Repeated rows are each counted, and rows without a doc_id are counted under null. A
    long text is encoded alone, piece by piece, so memory follows the longest text, not the batch. Extra columns aren't read. An empty
    table gives no rows. No shuffle: each row is done where it is read.
    """
    if len(mark) != 1 or ord(mark) > 127:
        raise ValueError("mark is one ASCII character")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        import pyarrow.compute as pc

        enc = tokens.encoder(tokenizer, cuts)
        for batch in batches:
            for part in tokens.slices(batch):
                text = pc.fill_null(part.column("text"), "")
                first, starts = section_starts(text, ord(mark))
                n, crossing = attributed(enc, text, mark, first)
                sections = np.diff(first)
                stops = np.append(starts[1:], 0)
                stops[first[1:] - 1] = pc.utf8_length(text).to_numpy()
                doc = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(text)), sections)))
                number = np.arange(first[-1]) - np.repeat(first[:-1], sections)
                cols = [doc.cast(pa.int64()), *(pa.array(c, t) for c, t in ((number, pa.int32()), (starts, pa.int64()), (stops, pa.int64()), (n, pa.int64()), (crossing, pa.int64())))]
                yield pa.record_batch(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents", "doc_id", "text"))
