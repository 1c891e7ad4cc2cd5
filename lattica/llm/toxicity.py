"""Toxicity by a counterfactual-regularised classifier.

Logistic regression on the presence of words and of word beginnings. Identity terms in labelled texts are swapped for others of the
same kind, and the squared change of the score is penalised, so a neutral mention of a group weighs little either way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Groups of identity terms; a term is swapped for the next one of its group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("immigrant", "citizen"), ("immigrants", "citizens"), ("refugees", "residents"), ("disabled", "healthy"), ("old", "young"),
)
SWAP = {g[i]: g[(i + 1) % len(g)] for g in IDENTITY for i in range(len(g))}
WORDS = re.compile(r"[^\W_]+")
BEGINNINGS = (4, 5, 6, 7)
SPACE = 1 << 24
#: Bounds of the fit: labelled rows, and features that may have a weight.
FIT_ROWS, FIT_FEATURES = 20_000, 4096


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    names = [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(x.encode()) % SPACE for x in names]


def text_features(words: set[str]) -> list[int]:
    return sorted({f for w in words for f in features(w)})


def held_out(doc_id: str = "doc_id"):
    """Rows that no label may be learned from; also those without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, most: int = FIT_FEATURES, penalty: float = 1.0, l2: float = 2e-3, steps: int = 400) -> dict:
    """Learns from at most `rows` labelled documents (those of the smallest hash) outside the held-out fold.

    labels(doc_id, toxic); of repeated labels the largest counts, null ones don't. Returns {"features", "weights", "bias"}, at most
    `most` of them besides the identity terms. With labels of one kind only, or none, the bias alone.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # what is broadcast is bounded by `rows`
    pick = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(WORDS.findall((text or "").lower()))
                swapped = {SWAP.get(w, w) for w in words}
                out[0].append(int(toxic))
                out[1].append(text_features(words))
                out[2].append(text_features(swapped) if swapped != words else None)
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["toxic", "has", "swapped"])

    sample = common.saved(pick.select("text", "toxic").mapInArrow(work, "toxic int, has array<int>, swapped array<int>"))
    size = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, n_toxic = int(size[0]), int(size[1])
    if not 0 < n_toxic < n:
        return {"features": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": float(np.log((n_toxic + 0.5) / (n - n_toxic + 0.5)))}
    seen = sample.select("toxic", F.explode("has").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    share = n_toxic / n
    gap = F.abs(F.col("hits") / F.lit(n_toxic) - (F.col("n") - F.col("hits")) / F.lit(n - n_toxic)) / F.sqrt(F.col("n") / F.lit(n) + F.lit(1 / n))
    top = [r[0] for r in seen.where("n >= 3").select("feature", gap.alias("gap")).orderBy(F.desc("gap"), "feature").limit(most).collect()]
    chosen = np.array(sorted({*top, *(f for w in SWAP for f in features(w))}), np.int64)
    index = {int(f): i for i, f in enumerate(chosen)}

    def narrow(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep = lambda xs: None if xs is None else [index[x] for x in xs if x in index]
        for batch in batches:
            cols = [batch.column("toxic"), *(pa.array([keep(x) for x in batch.column(c).to_pylist()], pa.list_(pa.int32())) for c in ("has", "swapped"))]
            yield pa.record_batch(cols, names=["toxic", "has", "swapped"])

    got = sample.mapInArrow(narrow, "toxic int, has array<int>, swapped array<int>").collect()
    y = np.array([r[0] for r in got], float)
    weights, bias = solve([r[1] for r in got], y, [(r[1], r[2]) for r in got if r[2] is not None], len(chosen), share, penalty=penalty, l2=l2, steps=steps)
    return {"features": chosen, "weights": weights, "bias": bias}


def solve(has: list[list[int]], y: np.ndarray, swaps: list, width: int, share: float, *, penalty: float, l2: float, steps: int):
    """Gradient descent with momentum estimates (Adam) on mean log loss + l2 |w|^2 + penalty * mean((score - swapped score)^2)."""
    row = np.repeat(np.arange(len(has)), [len(h) for h in has])
    col = np.array([c for h in has for c in h], np.int64)
    sign = [(i, c, s) for i, (a, b) in enumerate(swaps) for xs, s in ((a, 1.0), (b, -1.0)) for c in xs]
    srow, scol, sval = (np.array([x[k] for x in sign], t) for k, t in ((0, np.int64), (1, np.int64), (2, float)))
    w, bias = np.zeros(width), float(np.log(share / (1 - share)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.bincount(col, error[row], width) + 2 * l2 / 10 * w
        if swaps:
            change = np.bincount(srow, w[scol] * sval, len(swaps))
            g += 2 * penalty / len(swaps) * np.bincount(scol, change[srow] * sval, width)
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def scored(docs: DataFrame, model: dict, *, out: str = "score") -> DataFrame:
    """docs with a column `out`, from 0 to 1: how likely a text is toxic (a column of that name is replaced). Null text: as empty.

    The model is of bounded size. No shuffle.
    """
    docs = docs.drop(out)
    index = dict(zip(model["features"].tolist(), range(len(model["features"])), strict=True))
    weights, bias = model["weights"], model["bias"]

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, tuple] = {}
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                on: set[int] = set()
                for word in set(WORDS.findall((text.as_py() or "").lower())):
                    hit = held.get(word)
                    if hit is None:
                        hit = held[word] = tuple(index[f] for f in features(word) if f in index)
                    if hit:
                        on.update(hit)
                scores.append(bias + weights[sorted(on)].sum())
                if len(held) > 300_000:
                    held.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(np.array(scores, float), -40, 40))), pa.float64())], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{fields}, {out} double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
