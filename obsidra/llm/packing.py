"""Packing of token streams into sequences, by order-preserving dynamic programming.

Documents are taken in stored order. Window cuts may fall behind a document, behind a sentence or, where neither is
near, between any two ids; each kind has its penalty in ids of padding. With best[j] the least cost of packing the ids
before candidate cut j, a window from i to j costs ``length - (j - i)`` of padding, so

    best[j] = penalty[j] + length - j + min(best[i] + i  for i in j - length .. j - 1)

and the minimum comes from a monotone queue: every candidate enters and leaves it once. A task packs its partition in
blocks of about ``block_ids`` ids; a block's last window is left for the next block, and the partition's last ids make up
windows whose lengths are powers of two, which need no padding. Memory is bounded by a block and a slice of text (or by
one text, if longer), and nothing is shuffled.

Defined cases: null text counts as empty (the end id alone); a repeated doc_id is packed once a row; a text longer than a
block goes on in the next ones; an empty table gives no pieces; a null doc_id is kept as null; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from obsidra.llm.common import checked_columns, rows_as_batches, sliced
from obsidra.llm.tokens import END_ID, encoder

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)
PIECES_DDL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def candidate_cuts(
    ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, sentence_cost: float, forced_cost: float, grid: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending and closed by the last, with the penalty of each."""
    behind = np.flatnonzero(sentence_end[np.minimum(ids, len(sentence_end) - 1)]) + 1
    cuts = np.union1d(behind, doc_ends)
    gaps = np.diff(cuts, prepend=0)
    wide = np.flatnonzero(gaps > grid)
    if len(wide):
        more = [np.arange(cuts[k] - gaps[k] + grid, cuts[k], grid) for k in wide]
        forced = np.concatenate(more)
        cuts = np.union1d(cuts, forced)
    else:
        forced = np.zeros(0, dtype=np.int64)
    cost = np.full(len(cuts), sentence_cost)
    cost[np.searchsorted(cuts, forced)] = forced_cost
    cost[np.searchsorted(cuts, doc_ends)] = 0.0
    return cuts, cost


def window_ends(cuts: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Ends of the windows of least padding plus penalties; the last closes the stream and may be of any length."""
    total = int(cuts[-1])
    at = [0, *cuts.tolist()]
    extra = [0.0, *cost.tolist()]
    back = [0] * len(at)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # best + position, position, index; least in front
    for j in range(1, len(at)):
        here = at[j]
        while queue[0][1] < here - length:
            queue.popleft()
        key, _, back[j] = queue[0]
        key += extra[j] + length  # best[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    ends, j = [], len(at) - 1
    while j:
        ends.append(at[j])
        j = back[j]
    assert ends[0] == total
    return ends[::-1]


def with_tail(ends: list[int], length: int) -> list[int]:
    """``ends`` with the last window cut into powers of two, longest first."""
    start = ends[-2] if len(ends) > 1 else 0
    rest, out = ends[-1] - start, ends[:-1]
    while rest:
        part = 1 << (rest.bit_length() - 1)
        start, rest = start + part, rest - part
        out.append(start)
    return out


def pack_block(
    ids: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray, doc_ids: list, first_sequence: int, length: int,
    table: np.ndarray, sentence_cost: float, forced_cost: float, grid: int, last: bool,
) -> tuple[dict[str, list], int, int]:
    """The pieces of a block of the stream, the next sequence number, and how many ids are packed: all if it is the
    ``last``, else those up to the last window, which is left for the next block. A document may begin before the block
    (its start is negative then) and end behind it."""
    inside = doc_ends[doc_ends <= len(ids)]
    cuts, cost = candidate_cuts(ids, inside if len(inside) and inside[-1] == len(ids) else np.append(inside, len(ids)), table, sentence_cost, forced_cost, grid)
    ends = window_ends(cuts, cost, length)
    windows = np.concatenate(([0], with_tail(ends, length) if last else ends[:-1]))
    done = int(windows[-1])
    bounds = np.unique(np.concatenate((windows, doc_starts[(doc_starts > 0) & (doc_starts < done)])))
    at, to = bounds[:-1], bounds[1:]
    doc = np.searchsorted(doc_starts, at, side="right") - 1
    window = np.searchsorted(windows, at, side="right") - 1
    raw = ids.astype("<u4").tobytes()
    parts = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), to.tolist(), strict=True)]
    return {
        "doc_id": [doc_ids[k] for k in doc.tolist()],
        "start": (at - doc_starts[doc]).tolist(),
        "length": (to - at).tolist(),
        "ids_crc32": [zlib.crc32(x) for x in parts],
        "doc_tokens": (doc_ends - doc_starts)[doc].tolist(),
        "sequence_id": (first_sequence + window).tolist(),
        "offset": (at - windows[window]).tolist(),
        "ids": parts,
    }, first_sequence + len(windows) - 1, done


def pack(
    docs: DataFrame, tokenizer_path: str, *, length: int = 2048, end_id: int = END_ID, block_ids: int = 1 << 20,
    sentence_cost: float = 64.0, forced_cost: float = 512.0, grid: int = 48, with_ids: bool = True,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text), one row each; see PIECES_DDL. ``ids`` holds them as little-endian unsigned 32
    bits, empty unless ``with_ids``. ``length`` has to be a power of two, ``grid`` at most ``length`` and ``block_ids`` at
    least twice that."""
    if length & (length - 1) or not 0 < grid <= length or block_ids < 2 * length:
        raise ValueError("length must be a power of two, grid from 1 to length, and block_ids twice length at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        table = coder.sentence_ends()
        sequence = TaskContext.get().partitionId() << 40
        held: list[np.ndarray] = []  # the stream's ids that aren't packed yet
        docs_in: deque[tuple] = deque()  # (doc_id, start, end) of the documents they are of, counted from the first of them
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held, docs_in, size
            names, starts, ends = zip(*docs_in, strict=True)
            ids = np.concatenate(held)
            out, sequence, done = pack_block(
                ids, np.array(starts, np.int64), np.array(ends, np.int64), names, sequence, length, table, sentence_cost, forced_cost, grid, last
            )
            held, size = [ids[done:].copy()], size - done
            docs_in = deque((n, s - done, e - done) for n, s, e in docs_in if e > done)
            if not with_ids:
                out["ids"] = [b""] * len(out["doc_id"])
            yield from rows_as_batches(PIECES, out)

        for batch in sliced(batches):
            found, at = coder.encode_documents(batch.column(1), end_id)
            at = at.tolist()
            for doc, a, b in zip(batch.column(0).to_pylist(), at, at[1:]):  # noqa: B905
                docs_in.append((doc, size, size + b - a))
                while a < b:  # a long document goes on in the next block
                    some = min(b - a, max(block_ids - size, 1))
                    held.append(found[a : a + some].copy())
                    size, a = size + some, a + some
                    if size >= block_ids:
                        yield from flush(False)
            del found
        if size:
            yield from flush(True)

    return checked_columns(docs, "doc_id", "text").mapInArrow(run, PIECES_DDL)
