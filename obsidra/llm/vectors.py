"""What both vector searches share: which vectors take part, blocks of them, and the last ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsidra.llm.common import checked_columns


def usable(vectors: DataFrame, *, zero_too: bool) -> DataFrame:
    """(vec_id, embedding as array<double>) of the rows that take part: no null or non-finite component, and, unless
    ``zero_too``, some component that isn't zero. Of rows that repeat a vec_id the least vector stands for all."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    found = checked_columns(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found = found.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad))
    found = found if zero_too else found.where(F.exists("embedding", lambda x: x != 0))
    if found.groupBy("vec_id").count().where("count > 1").isEmpty():
        return found
    return found.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; shorter vectors are filled with zeros."""
    lens = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(lens) and (lens == lens[0]).all():
        return flat.reshape(len(lens), int(lens[0]))
    out = np.zeros((len(lens), int(lens.max(initial=1))))
    at = 0
    for k, n in enumerate(lens.tolist()):
        out[k, :n] = flat[at : at + n]
        at += n
    return out


def best_of_rows(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per row of ``scores`` the columns of its k highest, own id left out, ties to the smaller id."""
    scores = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    some = min(k, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - some, axis=1)[:, scores.shape[1] - some]
    for r in range(len(scores)):
        at = np.flatnonzero(scores[r] >= floor[r])
        at = at[scores[r, at] > -np.inf]
        yield r, at[np.lexsort((ids[at], -scores[r, at]))[:k]]


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) with each query's k best of ``pairs`` (query_id, vec_id, score)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def asked(every: int) -> Column:
    return F.col("vec_id") % every == 0


def stretches(part: pa.RecordBatch) -> list[tuple[int, int]]:
    """Where rows of one tile and kind (the first two columns) begin and end."""
    if not part.num_rows:
        return []
    tile, kind = (part.column(c).to_numpy() for c in (0, 1))
    cuts = np.flatnonzero((tile[1:] != tile[:-1]) | (kind[1:] != kind[:-1])) + 1
    bounds = [0, *cuts.tolist(), len(tile)]
    return list(zip(bounds, bounds[1:]))  # noqa: B905
