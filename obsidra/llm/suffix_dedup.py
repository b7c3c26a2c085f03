"""Removal of repeated passages with a column-wise multi-document suffix order.

A byte is removed if a string of ``length`` bytes over it also starts earlier: in a document of smaller doc_id, or
before it in its own. The input decides, not what is left of it.

1. Every window of ``length`` bytes has an anchor: the leftmost of its k-byte strings of least hash. Equal windows have
   equal anchors at equal offsets, so only windows of one anchor can be equal. Neighbouring windows with one anchor
   form a run, of under 2 * length bytes. Anchors do no more than deal out work: no repeat is settled by a hash.
2. The runs of anchors that have several make up collections of short documents, aligned at their anchors. Suffixes are
   put in order column by column, from the last: each round inserts one symbol per document, which gives the collection's
   Burrows-Wheeler transform at that column, and updates the prefixes in common, from a sequential file of columns. As
   equal windows stand in the same column, only suffixes of one column are ordered among each other (the positional form
   of the transform); a round costs the number of documents, not that of all suffixes so far. Neighbours with ``length``
   bytes in common are equal windows: bytes decide.
3. Collections grow from slices of a task's texts to parts of an anchor's runs to all of them. A run whose windows all
   stand earlier in its collection goes no further, so thousands of copies shrink to one a slice, then one a part.
4. The windows found go back to their documents, and the bytes that they cover are cut out.

A task holds a slice of texts, or one collection of bounded size (unless one anchor has more runs that differ). The file
of columns is in memory, as executors may not count on folders of their own.

Defined cases: null text is empty; rows with the same doc_id and different texts are documents of their own, in an
order fixed by a hash of the text; rows equal in both are one document and answered alike; a null doc_id comes before
all others; matches never cross documents; a text longer than a slice is a slice of its own, its windows taken in blocks;
an empty table gives no rows; other columns are ignored by ``repeated`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsidra.llm.common import checked_columns, sliced, stored

ANCHOR = 32
BLOCK_BYTES = 2 << 20
COLLECTION = 20_000
PART = 1 << 16  # runs of one anchor that are compared at once before all that are left
FIRST = -(1 << 63)  # stands for a null doc_id
_RNG = np.random.default_rng(20240229)
_SYMBOL = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _POWERS:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(steps))
        _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(28))


def runs_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of one text: starts of the runs of windows, how many windows each has, how far on its anchor is, the anchors'
    hashes."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    if len(data) > BLOCK_BYTES + length:  # long texts in blocks of windows
        parts = []
        for at in range(0, len(data) - length + 1, BLOCK_BYTES):
            starts, *rest = runs_of(data[at : at + BLOCK_BYTES + length - 1], length)
            parts.append((starts + at, *rest))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    n, wide = len(data), length - ANCHOR + 1
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_SYMBOL[data] * power[:n], out=sums[1:])
        strings = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
    # The least of each window by the van Herk scheme; low bits hold the place, so ties go to the left.
    keyed = (strings & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(strings), dtype=np.uint64)
    filled = np.full(-(-len(keyed) // wide) * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    filled[: len(keyed)] = keyed
    grid = filled.reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    place = (np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    counts = np.diff(np.concatenate((starts, [windows])))
    return starts, counts, place[starts] - starts, strings[place[starts]]


def _tag(text: Column | str) -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(text)


def _documents(docs: DataFrame) -> DataFrame:
    named = checked_columns(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return named.select("doc", _tag("text").alias("tag"), F.encode("text", "UTF-8").alias("raw"))


#: windows: of a repeat (kind 0) how many it has; of a run (kind 1) those of its text from start on, its anchor being
#: ``ahead`` bytes on. part: which of an anchor's parts a run is in.
RUNS = "kind int, anchor int, doc long, tag long, start long, ahead int, windows int"
FOUND = RUNS + ", part int"
RUN_NAMES = ["kind", "anchor", "doc", "tag", "start", "ahead", "windows"]


def _rows(kind: int, anchor: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, ahead: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    small = [np.full(len(doc), kind), anchor, ahead, windows]
    k, a, h, w = (pa.array(x.astype(np.int32)) for x in small)
    return pa.RecordBatch.from_arrays([k, a, pa.array(doc), pa.array(tag), pa.array(start), h, w], RUN_NAMES)


def _map_runs(length: int):  # noqa: ANN202
    """Texts to their runs that don't wholly stand earlier in the slice at hand, and to the repeats that the slice shows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4 << 20):
            held: list[tuple] = []
            raws: list[np.ndarray] = []
            base = 0
            for doc, tag, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                starts, counts, ahead, anchors = runs_of(data, length)
                if len(starts):
                    held.append((np.full(len(starts), doc), np.full(len(starts), tag), starts, starts + base, counts, ahead, anchors))
                    raws.append(data)
                    base += len(data)
            if held:
                yield from _locally(np.concatenate(raws), *(np.concatenate(x) for x in zip(*held, strict=True)), length)

    return run


def _locally(
    flat: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, begin: np.ndarray, windows: np.ndarray, ahead: np.ndarray, anchor: np.ndarray, length: int
) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((start, tag, doc, anchor))
    same = anchor[order[1:]] == anchor[order[:-1]]
    twice = same & (doc[order[1:]] == doc[order[:-1]]) & (tag[order[1:]] == tag[order[:-1]]) & (start[order[1:]] == start[order[:-1]])
    order = order[np.concatenate(([True], ~twice))]  # else of a row that stands twice
    doc, tag, start, begin, windows, ahead, anchor = (x[order] for x in (doc, tag, start, begin, windows, ahead, anchor))
    names = (anchor >> np.uint64(32)).astype(np.uint32).view(np.int32)
    heads = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(heads, len(anchor)))
    several = np.flatnonzero(np.repeat(sizes > 1, sizes))
    alive = np.ones(len(anchor), dtype=bool)
    at = 0
    while at < len(several):
        to = min(at + COLLECTION, len(several))
        while to < len(several) and anchor[several[to]] == anchor[several[to - 1]]:
            to += 1
        some = several[at:to]
        some = some[np.lexsort((start[some], tag[some], doc[some]))]
        who, offset, n, whole = repeats_of(flat, begin[some], windows[some] + length - 1, ahead[some], length)
        alive[some[whole]] = False
        own = some[who]
        yield _rows(0, _spread(start[own] + offset, doc[own]), doc[own], tag[own], start[own] + offset, np.zeros(len(own), int), n)
        at = to
    yield _rows(1, names[alive], doc[alive], tag[alive], start[alive], ahead[alive], windows[alive])


def _spread(start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Anchors' stand-ins for repeats, which may go anywhere."""
    return (_mixed(start.astype(np.uint64) + doc.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _settle(size: int):  # noqa: ANN202
    """Of runs sorted by anchor, doc, tag, start: those whose anchor has several, numbered into parts of ``size``; repeats
    pass. The last row at hand is held back until it is known whether its anchor goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row held back, and how many of its anchor came before
        for b in batches:
            kind = b.column(0).to_numpy()
            yield _parted(b.filter(pa.array(kind == 0)), np.zeros(int((kind == 0).sum()), int))
            b = b.filter(pa.array(kind == 1))
            before = 0
            if last is not None:
                b = pa.Table.from_batches([last[0], b]).combine_chunks().to_batches()[0]
                before = last[1]
            if not b.num_rows:
                continue
            anchor, doc, tag, start = (b.column(k).to_numpy() for k in (1, 2, 3, 4))
            same = anchor[1:] == anchor[:-1]
            twice = np.concatenate(([False], same & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (start[1:] == start[:-1])))
            if twice.any():
                b = b.filter(pa.array(~twice))
                anchor = anchor[~twice]
                same = anchor[1:] == anchor[:-1]
            heads = np.flatnonzero(np.concatenate(([True], ~same)))
            sizes = np.diff(np.append(heads, len(anchor)))
            place = np.arange(len(anchor)) - np.repeat(heads, sizes)
            place[: sizes[0]] += before
            several = np.repeat(sizes, sizes) > 1
            several[: sizes[0]] |= before > 0
            several[-1] = False
            yield _parted(b.filter(pa.array(several)), place[several] // size)
            last = (b.slice(b.num_rows - 1), int(place[-1]))
        if last is not None and last[1]:
            yield _parted(last[0], np.array([last[1] // size]))

    return run


def _parted(rows: pa.RecordBatch, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(part.astype(np.int32))], [*RUN_NAMES, "part"])


def columns_of(flat: np.ndarray, begin: np.ndarray, lens: np.ndarray, ahead: np.ndarray, file: BinaryIO) -> tuple[int, int]:
    """Writes the columns of the collection whose texts are flat[begin : begin + lens], last column first, one symbol per
    text and column: its byte plus one, or 0 beyond the text. ``ahead`` is how many bytes each text has before the column
    that all are aligned to. Returns the first column (minus the most bytes ahead) and how many there are."""
    first, last = -int(ahead.max(initial=0)), int((lens - ahead).max(initial=0))
    for column in range(last - 1, first - 1, -1):
        at = column + ahead
        has = (at >= 0) & (at < lens)
        symbols = flat[np.where(has, begin + at, 0)] + np.uint8(1)  # no byte of UTF-8 is 255
        symbols[~has] = 0
        file.write(symbols.tobytes())
    return first, last - first


def aligned_suffixes(flat: np.ndarray, begin: np.ndarray, lens: np.ndarray, ahead: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Column by column from the last: the column, the texts in the order of their suffixes from it, and the prefix each
    has in common with the one before (counted up to ``most``; 0 where a text has no byte there).

    A round inserts one symbol per text in front of its suffix: the symbols, taken in the order so far, are the
    transform of this column, and sorting them stably gives the next order. Two neighbours with one symbol have one more
    in common than the least prefix between them before. Columns are a sequential file, read once."""
    m = len(begin)
    file = io.BytesIO()
    first, columns = columns_of(flat, begin, lens, ahead, file)
    file.seek(0)
    order, common = np.arange(m), np.zeros(m + 1, dtype=np.uint8)  # the last entry stands behind the texts
    for column in range(first + columns - 1, first - 1, -1):
        transform = np.frombuffer(file.read(m), dtype=np.uint8)[order]
        place = np.argsort(transform, kind="stable")
        sorted_ = transform[place]
        # From one text to the next with its symbol; where the symbol changes, what comes out isn't used.
        least = np.minimum.reduceat(common, place + 1)[:-1]
        twin = (sorted_[1:] == sorted_[:-1]) & (sorted_[1:] > 0)
        common = np.zeros(m + 1, dtype=np.uint8)
        common[1:m] = np.where(twin, np.minimum(least, most - 1) + np.uint8(1), 0)
        order = order[place]
        yield column, order, common[:m]


def repeats_of(flat: np.ndarray, begin: np.ndarray, lens: np.ndarray, ahead: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The windows of ``length`` bytes that an earlier text has in the same column, joined where they touch: text, first
    start and number; and which texts have all their windows among them."""
    owners, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for column, order, common in aligned_suffixes(flat, begin, lens, ahead, length):
        same = common >= length
        if same.any():
            # Texts in one group are neighbours; the least number is the earliest text.
            heads = np.flatnonzero(~same)
            sizes = np.diff(np.append(heads, len(order)))
            least = np.repeat(np.minimum.reduceat(order, heads), sizes)
            again = np.repeat(sizes > 1, sizes) & (order != least)
            owners.append(order[again])
            starts.append(column + ahead[order[again]])
    owner, start = np.concatenate(owners), np.concatenate(starts)
    whole = np.bincount(owner, minlength=len(begin)) == lens - length + 1
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    heads = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)))[: len(owner)])
    return owner[heads], start[heads], np.diff(np.append(heads, len(owner))), whole


def _compare(length: int, rest: bool):  # noqa: ANN202
    """Runs sorted by anchor, part, doc, tag, start, with bytes; out come their repeats and, if the ``rest`` is wanted, the
    runs that aren't wholly repeats of others at hand."""

    def judged(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        rows = rows.take(pa.array(np.lexsort(tuple(rows.column(k).to_numpy() for k in (3, 2, 1)))))
        anchor, doc, tag, start, ahead, windows = (rows.column(k).to_numpy() for k in range(6))
        raw = rows.column(6)
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        flat = np.frombuffer(raw.buffers()[2], dtype=np.uint8)
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1]) | (anchor[1:] != anchor[:-1])))
        own = np.flatnonzero(new)  # else of a row that stands twice
        who, offset, n, whole = repeats_of(flat, offsets[own], offsets[own + 1] - offsets[own], ahead[own].astype(np.int64), length)
        hit, left = own[who], own[~whole]
        yield _rows(0, anchor[hit], doc[hit], tag[hit], start[hit] + offset, np.zeros(len(hit), int), n)
        if rest:
            yield _rows(1, anchor[left], doc[left], tag[left], start[left], ahead[left], windows[left])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in sliced(batches, 2 << 20, COLLECTION):
            anchor = b.column(0).to_numpy()
            if size >= COLLECTION // 2 and len(anchor):
                change = np.flatnonzero(anchor != held[-1].column(0)[held[-1].num_rows - 1].as_py())
                if len(change):
                    cut = int(change[0])
                    yield from judged([*held, b.slice(0, cut)])
                    held, size, b = [], 0, b.slice(cut)
            if b.num_rows:
                held.append(b)
                size += b.num_rows
        if held:
            yield from judged(held)

    return run


def repeats(docs: DataFrame, length: int = 100, part: int = PART) -> DataFrame:
    """(doc, tag, spans) with each document's repeated windows as (start, windows) pairs."""
    if not ANCHOR < length <= 180:
        raise ValueError(f"length must be from {ANCHOR + 1} to 180")
    texts = _documents(docs)
    runs = texts.mapInArrow(_map_runs(length), RUNS)
    found = runs.repartition("anchor").sortWithinPartitions("anchor", "doc", "tag", "start").mapInArrow(_settle(part), FOUND)
    found = stored(found, "suffix-found")
    whole = found.where("kind = 0").select("doc", "tag", "start", "windows")

    def compared(open_: DataFrame, keys: list[str], rest: bool) -> DataFrame:
        # First the texts that have open runs at all: their ids are few, and Spark broadcasts them if they are small.
        holders = stored(open_.select("doc", "tag").distinct(), "suffix-holders")
        cut = texts.join(holders, ["doc", "tag"], "left_semi").join(open_, ["doc", "tag"])
        piece = F.substring("raw", (F.col("start") + 1).cast("int"), (F.col("windows") + length - 1).cast("int"))
        cut = cut.select("anchor", "doc", "tag", "start", "ahead", "windows", piece.alias("raw"), *[k for k in keys if k != "anchor"])
        dealt = cut.repartition(*keys).sortWithinPartitions(*keys, "doc", "tag", "start")
        return stored(dealt.mapInArrow(_compare(length, rest), RUNS), "suffix-compared")

    hot = found.where("part > 0").select("anchor").distinct()
    several = not hot.isEmpty()
    first = compared(found.where("kind = 1").drop("kind"), ["anchor", "part"], several)
    whole = whole.union(first.where("kind = 0").select(*whole.columns))
    if several:  # anchors with several parts: what is left of those, together
        left = first.where("kind = 1").drop("kind").join(hot, "anchor", "left_semi")
        whole = whole.union(compared(left, ["anchor"], False).where("kind = 0").select(*whole.columns))
    return whole.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def covered(spans: list, n: int, length: int) -> np.ndarray:
    """Which of n bytes lie in a repeated window."""
    steps = np.zeros(n + 1, dtype=np.int64)
    if spans:
        starts = np.array([s["start"] for s in spans])
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + np.array([s["windows"] for s in spans]) + length - 1, -1)
    return np.cumsum(steps[:-1]) > 0


def repeated(docs: DataFrame, *, length: int = 100, part: int = PART) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per document; ``kept`` has the remaining bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[tuple] = []
            for raw, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                data = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                gone = covered(spans, len(data), length)
                left = data[~gone].tobytes()
                out.append((len(data), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    joined = _documents(docs).join(repeats(docs, length, part), ["doc", "tag"], "left")
    named = joined.select(F.when(F.col("doc") != FIRST, F.col("doc")).alias("doc_id"), "raw", "spans")
    return named.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, *, length: int = 100) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (characters cut in two go as well); n_chars, if there, fits."""
    names, schema = docs.columns, T.StructType(docs.schema.fields)
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    marked = docs.select(*own, F.coalesce(F.col("doc_id"), F.lit(FIRST)).alias("doc"), _tag(F.coalesce(F.col("text"), F.lit(""))).alias("tag"))
    joined = marked.join(repeats(docs, length), ["doc", "tag"], "left").select(*[f"c{k}" for k in range(len(names))], "spans")
    at, last = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = []
            for text, found in zip(b.column(at).to_pylist(), b.column(last).to_pylist(), strict=True):
                if found:
                    data = np.frombuffer(text.encode(), dtype=np.uint8)
                    text = data[~covered(found, len(data), length)].tobytes().decode(errors="ignore")
                texts.append(text)
            columns = list(b.columns[:last])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
