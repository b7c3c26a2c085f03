"""Exact top-k search with multi-resolution segment statistics.

Vectors become integer vectors floor(scale * x). At a resolution of s segments of length l, with the means and
deviations of each segment, q . x <= l * sum(mean_q * mean_x + dev_q * dev_x): a product of short vectors. Coarse
resolutions come first; queries and rows of a block of which no pair can beat the k-th best exact score so far are
dropped, a finer resolution is passed over in a block where it leaves most of a sample, and survivors get exact integer
scores: many as one product of matrices (in single precision where all sums stay below 2^24), few pair by pair.

The stated queries meet all rows in tiles: groups of queries times shares of the rows, as many as the rows ask for, each
tile one task's. A tile's queries are held; its rows stream by in blocks, by vec_id, and what a query has found so far
prunes the next blocks. A tile gives k rows a query at most. Vectors go to the tiles in the narrowest type that holds them.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without a vec_id, take no
part; vectors of several lengths are compared as if filled with zeros; of equal scores the smaller vec_id comes first;
rows that repeat a vec_id count as one, with the least of their vectors; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidra.llm.common import sliced
from obsidra.llm.vectors import asked, matrix, ranked, stretches, usable

RESOLUTIONS = (1, 4, 16)
PAIRS = 1 << 15  # pairs that are worked out one by one at once
QUERIES = 1 << 8  # queries that meet a block of rows at once
SPARSE = 1 / 64  # share of pairs below which they are worked out one by one
TILE_BYTES = 32 << 20  # of a tile's queries
SINGLE = 1 << 24  # whole numbers up to here are exact in single precision
KINDS = {1: "<i1", 2: "<i2", 4: "<i4", 8: "<f8"}


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, int]:
    """Means, then deviations of equal segments (the vector filled up with zeros), and the segments' length."""
    size = -(-x.shape[1] // segments)
    parts = np.pad(x, ((0, 0), (0, size * segments - x.shape[1]))).reshape(len(x), segments, size)
    return np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1), size


def packed(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes, all in the narrowest type that holds them."""
    most = np.abs(x).max(initial=0)
    kind = next((KINDS[w] for w in (1, 2, 4) if most < 1 << 8 * w - 1), KINDS[8])
    raw = np.ascontiguousarray(x, dtype=kind)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (raw.shape[1] * raw.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """The rows that packed() wrote, in whatever types, as doubles."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw, sizes = np.frombuffer(column.buffers()[2], np.uint8), np.diff(offsets)
    out = np.empty((len(column), width))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        own = raw[offsets[0] : offsets[-1]] if len(at) == len(sizes) else raw[offsets[at][:, None] + np.arange(size)].ravel()
        out[at] = own.view(KINDS[size // width]).reshape(len(at), width)
    return out


class Vectors:
    """Vectors of whole numbers with their norms and statistics, in single precision if it holds them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.norms = ids, np.sqrt((x * x).sum(axis=1))
        self.x = x.astype(np.float32) if np.abs(x).max(initial=0) < SINGLE else x
        self.levels, self.sizes = {}, {}
        for s in RESOLUTIONS:
            if s <= x.shape[1]:
                own, self.sizes[s] = statistics(x, s)
                self.levels[s] = own.astype(self.x.dtype)


class Queries(Vectors):
    """Queries, and the best candidates that each has found."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        super().__init__(ids, q)
        self.k = k
        self.found = np.zeros((len(q), k), np.int64), np.full((len(q), k), -np.inf)
        for s, size in self.sizes.items():
            self.levels[s] *= size

    def look(self, rows: Vectors) -> None:
        """Searches a block of rows. Ids ascend in it and from block to block, so a later row needs a better score."""
        floor = self.found[1][:, self.k - 1]
        enough = floor - 1e-5 * self.norms * rows.norms.max() - 1e-3  # room for rounding in a bound
        here, there = np.arange(len(self.ids)), np.arange(len(rows.ids))
        for s, own in rows.levels.items():
            a, b = self.levels[s][here], own[there]
            if s > RESOLUTIONS[0] and np.mean(a[::16] @ b.T > enough[here][::16, None]) > 0.5:
                continue
            alive = a @ b.T > enough[here][:, None]
            share = np.count_nonzero(alive) / alive.size
            if share < SPARSE:
                i, j = np.nonzero(alive)
                self._pairs(rows, here[i], there[j], s, floor, enough)
                return
            if share < 0.9:
                here, there = here[alive.any(axis=1)], there[alive.any(axis=0)]
        self._block(rows, here, there, floor)

    def _pairs(self, rows: Vectors, i: np.ndarray, j: np.ndarray, done: int, floor: np.ndarray, enough: np.ndarray) -> None:
        for at in range(0, len(i), PAIRS):
            q, c = i[at : at + PAIRS], j[at : at + PAIRS]
            for s in [s for s in rows.levels if s > done]:
                alive = np.einsum("pd,pd->p", self.levels[s][q], rows.levels[s][c]) > enough[q]
                q, c = q[alive], c[alive]
            scores = np.einsum("pd,pd->p", self.x[q].astype(float), rows.x[c].astype(float))
            better = (scores > floor[q]) & (self.ids[q] != rows.ids[c])
            self._merge(q[better], rows.ids[c[better]], scores[better])

    def _block(self, rows: Vectors, here: np.ndarray, there: np.ndarray, floor: np.ndarray) -> None:
        most = self.norms.max() * rows.norms.max()  # no sum of some of a product's terms is beyond it
        kind = np.float32 if most < SINGLE else np.float64
        scores = self.x[here].astype(kind, copy=False) @ rows.x[there].astype(kind, copy=False).T
        ids, own = rows.ids[there], self.ids[here]
        place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        same = np.flatnonzero(ids[place] == own)
        scores[same, place[same]] = -np.inf
        better = scores > floor[here].astype(kind)[:, None]
        if len(ids) > self.k and np.count_nonzero(better) > 2 * self.k * len(here) and most * len(ids) < 1 << 52:
            # Many: the k best of each query, told apart by their place.
            order = np.arange(len(ids)) - scores.astype(float) * len(ids)
            cols = np.argpartition(order, self.k - 1, axis=1)[:, : self.k]
            i, at = np.nonzero(np.take_along_axis(better, cols, axis=1))
            j = cols[i, at]
        else:
            i, j = np.divmod(np.flatnonzero(better), len(ids))
        self._merge(here[i], ids[j], scores[i, j].astype(float))

    def _merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        all_ids, all_scores = self.found
        who = np.unique(rows)
        held = np.isfinite(all_scores[who])
        rows = np.concatenate([who[np.nonzero(held)[0]], rows])
        ids, scores = np.concatenate([all_ids[who][held], ids]), np.concatenate([all_scores[who][held], scores])
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < self.k
        all_ids[rows[best], place[best]], all_scores[rows[best], place[best]] = ids[best], scores[best]

    def answers(self) -> pa.RecordBatch:
        ids, scores = self.found
        held = np.isfinite(scores)
        who = np.repeat(self.ids, held.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids[held]), pa.array(scores[held].astype(np.int64))], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, *, k: int = 20, every: int = 20, scale: int = 64, row_block: int = 2048, tile_rows: int = 1 << 22, tile_queries: int = 1 << 17, least_tiles: int = 24) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row whose id is divisible by ``every``."""
    able = usable(vectors, zero_too=True)
    size = able.agg(F.count(F.lit(1)).alias("n"), F.count_if(asked(every)).alias("q"), F.max(F.size("embedding")).alias("width")).first()
    width = size.width or 1
    most = max(1, min(tile_queries, max(QUERIES, TILE_BYTES // (4 * width))))
    groups = max(1, math.ceil(size.q / most), min(4, math.ceil(size.q / 512)))
    shares = max(1, math.ceil(size.n / tile_rows), min(math.ceil(least_tiles / groups), math.ceil(size.n / 512)))
    group, share = F.pmod(F.xxhash64("vec_id"), F.lit(groups)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shares))
    target = lambda g, s, kind: F.struct((g * shares + s).cast("int").alias("tile"), F.lit(kind).alias("kind"))
    asking = F.transform(F.sequence(F.lit(0), F.lit(shares - 1)), lambda s: target(group, s, 0))
    held = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: target(g, share, 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = np.floor(matrix(batch.column(1)) * scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(np.pad(x, ((0, 0), (0, width - x.shape[1]))))], ["vec_id", "data"])

    rows = able.select("vec_id", "embedding").mapInArrow(pack, "vec_id long, data binary")
    rows = rows.select(F.explode(F.when(asked(every), F.concat(asking, held)).otherwise(held)).alias("to"), "vec_id", "data")
    dealt = rows.select("to.tile", "to.kind", "vec_id", "data").repartitionByRange(groups * shares, "tile").sortWithinPartitions("tile", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, asks = None, [], []
        current: list[Queries] = []
        for part in sliced(batches, rows=row_block):
            for at, to in stretches(part):
                own = part.slice(at, to - at)
                name, kind = own.column(0)[0].as_py(), own.column(1)[0].as_py()
                if name != tile:
                    for some in current:
                        yield some.answers()
                    tile, ids, asks, current = name, [], [], []
                x, names = unpacked(own.column(3), width), own.column(2).to_numpy()
                if kind == 0:
                    ids.append(names)
                    asks.append(x)
                    if sum(map(len, ids)) >= QUERIES:
                        current.append(Queries(np.concatenate(ids), np.concatenate(asks), k))
                        ids, asks = [], []
                    continue
                if ids:
                    current.append(Queries(np.concatenate(ids), np.concatenate(asks), k))
                    ids, asks = [], []
                if current:
                    block = Vectors(names, x)
                    for some in current:
                        some.look(block)
        for some in current:
            yield some.answers()

    return ranked(dealt.mapInArrow(run, "query_id long, vec_id long, score long"), k)
