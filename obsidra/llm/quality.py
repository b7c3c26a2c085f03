"""Document quality by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text. Preference pairs (a good document over a bad one) are drawn from
a bounded sample of labelled rows; the weights minimise the logistic loss on feature differences. The threshold is the
quantile of the sample's scores at the share of bad labels, and scores are mapped to 0..1 so that it falls on ``cut``.

Defined cases: null text counts as empty and is scored like any other; without labels of both kinds every score is
0.5; repeated rows are each scored, and several labels of one document each count; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidra.llm.common import bucket_of, checked_columns, sliced

N_FEATURES = 256 + 14


def features(text: str | None) -> np.ndarray:
    """Shares of bytes, and figures of letter case, repetition, word and line shape; of the whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES)
    if not raw:
        out[-1] = 1.0
        return out
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256).astype(float)
    n = len(raw)
    out[:256] = np.sqrt(counts / n)
    words = text.split()
    lines = text.split("\n")
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    spaces = counts[9:14].sum() + counts[32]
    high = counts[128:].sum()
    marks = n - upper - lower - digits - spaces - high
    w = max(len(words), 1)
    distinct = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:]))  # noqa: B905
    out[256:] = [
        upper / (upper + lower + 1), marks / n, digits / n, marks / w, n / w / 10, math.log1p(w) / 5, distinct / w,
        math.log1p(distinct) / math.log1p(w), same / w, len(set(lines)) / len(lines), math.log1p(n / len(lines)) / 5,
        counts[33] / w, (counts[46] + counts[63] + counts[33]) / w, 0.0,
    ]
    return out


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray, cut: float) -> np.ndarray:
        at = (self.raw(x) - self.threshold) / self.spread + math.log(cut / (1 - cut))
        return 1 / (1 + np.exp(-np.clip(at, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, *, pairs: int = 40_000, steps: int = 300, rate: float = 0.05, decay: float = 1e-3, seed: int = 5) -> Ranking | None:
    """Bradley-Terry weights from random good-over-bad pairs; None unless there are rows of both kinds."""
    rng = np.random.default_rng(seed)
    ups, downs = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(ups) or not len(downs):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -6, 6)
    a, b = rng.choice(ups, pairs), rng.choice(downs, pairs)
    weights = np.zeros(x.shape[1])
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        some = rng.integers(0, pairs, 2048)
        gap = z[a[some]] - z[b[some]]
        slope = -gap.T @ (1 / (1 + np.exp(np.clip(gap @ weights, -40, 40)))) / len(some) + decay * weights
        first += 0.1 * (slope - first)
        second += 0.01 * (slope * slope - second)
        weights -= rate * min(1.0, 2 * (1 - step / (steps + 1))) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    raw = z @ weights
    share = 1 - good.mean()
    ordered = np.sort(raw)
    k = min(len(ordered) - 1, max(1, round(share * len(ordered))))
    threshold = float((ordered[k - 1] + ordered[k]) / 2)
    return Ranking(mean, scale, weights, threshold, float(raw.std()) / 4 + 1e-9)


def labelled_features(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled rows outside the held-out fold, lowest id hash first."""
    usable = labels.where(F.col("quality").isNotNull() & (bucket_of("doc_id", modulus) != held_out))
    chosen = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [features(t).astype("<f4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["doc_id", "quality", "x"])

    # At most ``rows`` rows: the bound of the broadcast.
    joined = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    got = sorted(joined.mapInArrow(run, "doc_id long, quality int, x binary").collect(), key=lambda r: (r.doc_id, r.quality, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, dtype="<f4").astype(float) for r in got]) if got else np.zeros((0, N_FEATURES))
    return x, np.array([r.quality == 1 for r in got], dtype=bool)


def score(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held_out: int = 0, sample_rows: int = 6000, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality)."""
    docs = checked_columns(docs, "doc_id", "text")
    ranking = fitted(docs, checked_columns(labels, "doc_id", "quality"), modulus, held_out, sample_rows)
    marked = docs.select("doc_id", (bucket_of("doc_id", modulus) == held_out).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = scores_of(ranking, b.column(2).to_pylist(), cut)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(found), pa.array((found >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return marked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def fitted(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, sample_rows: int) -> Ranking | None:
    return fit(*labelled_features(docs, labels, modulus, held_out, sample_rows))


def scores_of(ranking: Ranking | None, texts: list[str | None], cut: float) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    if ranking is not None:
        for at in range(0, len(texts), 1000):
            out[at : at + 1000] = ranking.score(np.stack([features(t) for t in texts[at : at + 1000]]), cut)
    return out


def keep_good(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held_out: int = 0, sample_rows: int = 6000, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    ranking = fitted(checked_columns(docs, "doc_id", "text"), checked_columns(labels, "doc_id", "quality"), modulus, held_out, sample_rows)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.filter(pa.array(scores_of(ranking, b.column(at).to_pylist(), cut) >= cut))

    return docs.mapInArrow(run, docs.schema)
