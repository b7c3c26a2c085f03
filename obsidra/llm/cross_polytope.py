"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform; a unit vector's hash in a table is the
signed axis nearest to its rotation. A query probes the axes nearest to it in each table, and what it meets there is
ranked by exact inner product of the original vectors.

All rows are indexed, in the same way however many they are: a table's bucket is the axes of two rotations together, and
the probes are the best pairs of axes. Rows are dealt in shares of bounded size; a task holds its share's buckets of all
tables, and queries stream by, so a crowded bucket is spread over all shares and a pair that meets in several tables is
scored once. What a query meets doesn't depend on the shares. A query whose buckets hold fewer than k others goes on to
every row.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a vec_id, take
no part; vectors of several lengths are compared as if filled with zeros; of equal scores the smaller vec_id comes first;
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
from pyspark.sql import types as T

from obsidra.llm.common import sliced, stored
from obsidra.llm.vectors import asked, best_of_rows, matrix, ranked, stretches, usable

MOST_AXES = 48  # of each rotation that pairs are made of
TILE_BYTES = 64 << 20  # of a share's vectors
LISTED = 1 << 20  # buckets of a table up to which a share holds where each begins


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row, by butterflies."""
    n, width = x.shape
    x, h = x.copy(), 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, table: int, width: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng((seed, table))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], width))
    return x


def nearest_pairs(x: np.ndarray, table: int, width: int, seed: int, probes: int, axes: int = MOST_AXES, ordered: bool = True) -> np.ndarray:
    """Per row the ``probes`` best pairs of signed axes of two rotations, those with the greatest sums of components, made
    of the ``axes`` nearest of each, best first if ``ordered``; axis a is 2a, its opposite 2a + 1."""
    sides = []
    for k in (0, 1):
        y = rotated(x, 2 * table + k, width, seed + 1)
        signed = np.stack([y, -y], axis=2).reshape(len(x), 2 * width)
        best = signed.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-signed, axis=1, kind="stable")[:, :axes]
        sides.append((best, np.take_along_axis(signed, best, axis=1)))
    (a, va), (b, vb) = sides
    sums = (va[:, :, None] + vb[:, None, :]).reshape(len(x), -1)
    names = (a[:, :, None] * (2 * width) + b[:, None, :]).reshape(len(x), -1)
    if ordered or probes >= sums.shape[1]:
        return np.take_along_axis(names, np.argsort(-sums, axis=1, kind="stable")[:, :probes], axis=1)
    return np.take_along_axis(names, np.argpartition(-sums, probes - 1, axis=1)[:, :probes], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


class Index:
    """A share's rows, by bucket in every table."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, buckets: int):
        self.ids, self.x = ids, x
        orders = [np.argsort(c, kind="stable") for c in codes.T]
        self.codes = [c[o] for c, o in zip(codes.T, orders, strict=True)]
        self.order = np.concatenate(orders)
        self.starts = [np.searchsorted(c, np.arange(buckets + 1)) for c in self.codes] if buckets <= LISTED else None
        self.hit = np.zeros(len(ids), dtype=bool)

    def met(self, probes: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Per query the rows in the buckets that it probes (one array of queries by probes a table), each once."""
        bounds = []
        for t, asked_for in enumerate(probes):
            if self.starts is not None:
                pair = self.starts[t][asked_for], self.starts[t][asked_for + 1]
            else:
                pair = tuple(np.searchsorted(self.codes[t], asked_for, side=side) for side in ("left", "right"))
            bounds.append([places + t * len(self.ids) for places in pair])
        low, high = (np.concatenate(side, axis=1) for side in zip(*bounds, strict=True))
        for some, to in zip(low, high, strict=True):
            full = np.flatnonzero(to > some)
            lens = to[full] - some[full]
            places = np.repeat(some[full] - (np.cumsum(lens) - lens), lens)
            self.hit[self.order[places + np.arange(len(places))]] = True
            found = np.flatnonzero(self.hit)
            self.hit[found] = False
            yield found

    def best(self, own: np.ndarray, y: np.ndarray, probes: list[np.ndarray] | None, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the k best that each query meets: in its buckets, or without ``probes`` of all rows."""
        every = np.arange(len(self.ids))
        for n, rows in enumerate(self.met(probes) if probes is not None else (every for _ in own)):
            if len(rows):
                ids, scores = self.ids[rows], np.einsum("xd,d->x", self.x[rows].astype(float), y[n])
                for _, c in best_of_rows(scores[None], ids, own[n : n + 1], k):
                    yield int(own[n]), ids[c], scores[c]


def search(vectors: DataFrame, *, k: int = 20, every: int = 20, tables: int = 8, probes: int = MOST_AXES, pair_probes: int = 1280, seed: int = 3, tile_bytes: int = TILE_BYTES, least_tiles: int = 24) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by ``every``. A query probes
    the ``pair_probes`` best pairs of the ``probes`` nearest axes of two rotations, in each table."""
    able = usable(vectors, zero_too=False)
    size = able.agg(F.max(F.size("embedding")).alias("longest"), F.count(F.lit(1)).alias("n")).first()
    width = 1 << ((size.longest or 1) - 1).bit_length()
    own = vectors.schema["embedding"].dataType
    kind = "<f4" if isinstance(own, T.ArrayType) and isinstance(own.elementType, T.FloatType) else "<f8"
    code = "<i4" if width < 1 << 14 else "<i8"
    shares = max(1, math.ceil(size.n * width * int(kind[2]) / tile_bytes), min(6, math.ceil(size.n / 1024)))
    groups = max(1, min(math.ceil(least_tiles / shares), math.ceil(size.n / 4096)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 20, 2048):
            if batch.num_rows:
                x = matrix(batch.column(1))
                codes = np.concatenate([nearest_pairs(unit(x), t, width, seed, 1) for t in range(tables)], axis=1)
                x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
                yield pa.RecordBatch.from_arrays([batch.column(0), _bytes(x.astype(kind)), _bytes(codes.astype(code))], ["vec_id", "data", "codes"])

    rows = stored(able.select("vec_id", "embedding").mapInArrow(index, "vec_id long, data binary, codes binary"), "cross-index")

    def met(asking: DataFrame, whole: bool) -> DataFrame:
        """(query_id, vec_id, score) of the k best of each query in each share, in its buckets or of all rows."""
        group, share = F.pmod(F.xxhash64("vec_id"), F.lit(groups)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shares))
        every_share, every_group = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        held = rows.select("vec_id", "data", "codes", every_group.alias("g"), share.alias("s"), F.lit(0).alias("kind"))
        come = asking.select("vec_id", "data", F.lit(None).cast("binary").alias("codes"), group.alias("g"), every_share.alias("s"), F.lit(1).alias("kind"))
        tile = (F.col("g") * shares + F.col("s")).cast("int").alias("tile")
        dealt = held.union(come).select(tile, "kind", "vec_id", "data", "codes").repartitionByRange(groups * shares, "tile").sortWithinPartitions("tile", "kind", "vec_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tile, parts, index = None, [], None
            for part in sliced(batches, rows=512):
                for at, to in stretches(part):
                    some = part.slice(at, to - at)
                    name, ids, x = some.column(0)[0].as_py(), some.column(2).to_numpy(), _matrix(some.column(3), kind)
                    if name != tile:
                        tile, parts, index = name, [], None
                    if some.column(1)[0].as_py() == 0:
                        parts.append((ids, x, _matrix(some.column(4), code)))
                        continue
                    if parts:
                        index, parts = Index(*(np.concatenate(c) for c in zip(*parts, strict=True)), (2 * width) ** 2), []
                    if index is not None:
                        y = x.astype(float)
                        asks = None if whole else [nearest_pairs(unit(y), t, width, seed, pair_probes, probes, ordered=False) for t in range(tables)]
                        found = list(index.best(ids, y, asks, k))
                        lens = [len(c) for _, c, _ in found]
                        yield pa.RecordBatch.from_pydict({
                            "query_id": np.repeat(np.array([o for o, _, _ in found], np.int64), lens),
                            "vec_id": np.concatenate([c for _, c, _ in found] or [np.zeros(0, np.int64)]),
                            "score": np.concatenate([s for _, _, s in found] or [np.zeros(0)]),
                        })

        return dealt.mapInArrow(run, "query_id long, vec_id long, score double")

    asking = rows.where(asked(every))
    first = stored(met(asking, False), "cross-found")
    wanted = min(k, size.n - 1)
    counts = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = asking.join(counts.where(F.col("n") >= wanted), F.col("vec_id") == F.col("query_id"), "left_anti")
    if not short.isEmpty():
        first = first.union(met(short, True)).dropDuplicates(["query_id", "vec_id"])
    return ranked(first, k)
