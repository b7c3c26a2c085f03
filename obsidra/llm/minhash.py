"""Near-duplicate detection with bottom-k sketches from one hash function.

Documents with equal shingle sets form a class. A class's sketch is its k smallest shingle hashes. Inverted lists are
kept for runs of retained values next to each other in a sketch: where two sets have Jaccard similarity t or more, few
of the smallest hashes of their union are missing from either, so some run of four is shared (for k = 64 and t = 0.8
the chance of none is from 2.1e-7, for a union of 71 values, to 1.0e-6, for one set inside the other; sets of under 48 shingles also have runs of three, of under six runs of two, which
makes it certain there). Overlaps from the lists are filtered by the similarity estimated on the union's sketch, and
what passes is verified on full shingle sets.

Lists can be long without a quadratic number of pairs: members are first held against one member of the list only, its
hub, and the verified links joined to components. Lists with the same hub form one group. Groups whose members are then
in one component are settled. Of the others, pairs across components are held against longer sketches, in blocks of
bounded size, and the few that pass are verified.

Texts, sets and pairs are worked on in slices of bounded size; a text or set longer than a slice is one of its own.

Defined cases: null or wordless text has an empty set and no links; fewer words than a shingle has make one shingle;
rows that repeat a doc_id are documents of their own with that id; a null doc_id links like any other, but isn't the
least: a component's id is null only if it has no other; an empty table gives no rows; other columns are ignored by
``near_duplicates`` and kept, whatever their names, by ``keep_first``, which goes by row: of each component one row
stays, of rows equal in doc_id and text any one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidra.llm.common import checked_columns, sliced, stored
from obsidra.llm.components import components

SKETCH = 64
SLACK = 0.32  # over six deviations of an estimate from 64 values
ALL_PAIRS = 4
FINE = 256
FINE_SLACK = 0.15  # six deviations of an estimate from 256 values
BLOCK = 1024
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes (64 bits) of its shingles of ``width`` words; ASCII letters in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("").cast(pa.string())))
    heads = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.values.slice(int(heads[0]), int(heads[-1] - heads[0])).dictionary_encode()
    heads = heads - heads[0]
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    filled = np.array([bool(w) for w in words], dtype=bool)[codes] if len(words) else np.zeros(0, bool)
    heads = np.concatenate(([0], np.cumsum(filled)))[heads]
    flat = hashes[codes[filled]] if len(words) else np.zeros(0, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(flat) - width + 1, 0), dtype=np.uint64)
        for k in range(width):
            rolled = rolled * factor + flat[k : k + len(rolled)]
    rolled = _mixed(rolled)
    out = []
    for a, b in zip(heads.tolist(), heads[1:].tolist()):  # noqa: B905
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = xxhash.xxh3_64_intdigest(flat[a:b].tobytes(), seed=b - a)
            out.append(np.array([short], dtype=np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u8")


def set_id(values: np.ndarray) -> int:
    """64-bit name of a shingle set, as a signed number."""
    x = xxhash.xxh3_64_intdigest(values.astype("<u8").tobytes())
    return x - (1 << 64) if x >> 63 else x


def list_keys(sketch: np.ndarray, size: int) -> np.ndarray:
    """Names of the inverted lists that a class is in."""
    runs = ([4] if size >= 48 else []) + ([3] if 3 <= size <= 60 else []) + ([2] if size in (4, 5) else [])
    factor, found = np.uint64(0x9E3779B97F4A7C15), []
    with np.errstate(over="ignore"):
        for run in runs:
            rolled = np.full(max(len(sketch) - run + 1, 0), np.uint64(run))
            for k in range(run):
                rolled = rolled * factor + sketch[k : k + len(rolled)]
            found.append(_mixed(rolled))
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from the sketch of the union."""
    union = np.union1d(a, b)[: max(len(a), len(b)) if max(len(a), len(b)) >= SKETCH else None]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text); the tag, a hash of the text, tells rows of one doc_id apart."""
    return checked_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, tag, n, cid, sketch) per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(b.column(2), width)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()),
                    pa.array([packed(s[:SKETCH]) for s in sets], pa.binary()),
                ],
                ["doc_id", "tag", "n", "cid", "sketch"],
            )

    return _keyed(docs).mapInArrow(run, "doc_id long, tag long, n long, cid long, sketch binary")


def _memberships(classes: DataFrame) -> DataFrame:
    """(key, cid) for every list a class is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keys = [list_keys(unpacked(s), n) for n, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            lens = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), pa.array(np.repeat(b.column(0).to_numpy(), lens))], ["key", "cid"]
            )

    return classes.select("cid", "n", "sketch").mapInArrow(run, "key long, cid long")


def _short_pairs(lists: DataFrame) -> DataFrame:
    """Candidate links (u, v), u above v: all pairs of the lists of at most ``ALL_PAIRS`` members."""
    short = lists.where(F.col("m") <= ALL_PAIRS)
    return short.select("key", F.col("cid").alias("u")).join(short.select("key", F.col("cid").alias("v")), "key").where("u > v").select("u", "v").distinct()


def _hub_groups(lists: DataFrame) -> DataFrame:
    """(hub, cid), once each: the longer lists, those with the same hub as one. A list's hub is the member whose lists
    have most members in all: of a text and its altered copies, the text, as the copies lack some of its runs."""
    long = lists.where(F.col("m") > ALL_PAIRS)
    heavy = long.join(long.groupBy("cid").agg(F.sum("m").alias("weight")), "cid")
    hubs = heavy.groupBy("key").agg(F.max(F.struct("weight", "cid")).alias("top")).select("key", F.col("top.cid").alias("hub"))
    return long.join(hubs, "key").select("hub", "cid").distinct()


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """estimate() of each row of sketches in ``a`` with that row in ``b``; short rows are filled up with ``NONE``."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    new = np.concatenate([np.ones((len(both), 1), bool), both[:, 1:] != both[:, :-1]], axis=1)
    valid = both != NONE
    full = (a[:, -1] != NONE) | (b[:, -1] != NONE)
    inside = valid & (np.cumsum(new & valid, axis=1) <= np.where(full, a.shape[1], both.shape[1])[:, None])
    return (inside & ~new).sum(axis=1) / np.maximum((inside & new).sum(axis=1), 1)


def _grid(sketches: list[bytes], size: int) -> np.ndarray:
    out = np.full((len(sketches), size), NONE)
    for k, s in enumerate(sketches):
        values = unpacked(s)
        out[k, : len(values)] = values
    return out


def _estimated(links: DataFrame, classes: DataFrame, lowest: float, percent: int = 80) -> DataFrame:
    """Links (u, v) that neither the sketches nor the sizes rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = _similar(*(_grid(b.column(k).to_pylist(), SKETCH) for k in (2, 3)))
            yield b.select(["u", "v"]).filter(pa.array(found >= lowest))

    one = classes.select(F.col("cid").alias("u"), F.col("sketch").alias("su"), F.col("n").alias("nu"))
    two = classes.select(F.col("cid").alias("v"), F.col("sketch").alias("sv"), F.col("n").alias("nv"))
    joined = links.join(one, "u").join(two, "v").where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    return joined.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int, most: int | None = None) -> DataFrame:
    """(cid, items) of the classes in ``wanted``: their sorted sets, or the ``most`` least values of those."""
    reps = wanted.join(classes.select("cid", "rep"), "cid").select("cid", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tag").alias("rep_tag"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = shingle_sets(b.column(1), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(s[:most]) for s in found], pa.binary())], ["cid", "items"])

    texts = _keyed(docs)
    found = texts.join(reps, (F.col("tag") == F.col("rep_tag")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("cid", "text")
    return stored(found.mapInArrow(sets, "cid long, items binary").dropDuplicates(["cid"]), "near-sets")


def _verified(links: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) whose full sets have 100 * intersection >= percent * union."""
    wanted = links.select(F.col("u").alias("cid")).union(links.select(F.col("v").alias("cid"))).distinct()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (unpacked(v.as_buffer()) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    found = _sets(docs, classes, wanted, width)
    one, two = found.select(F.col("cid").alias("u"), F.col("items").alias("iu")), found.select(F.col("cid").alias("v"), F.col("items").alias("iv"))
    return links.join(one, "u").join(two, "v").select("u", "v", "iu", "iv").mapInArrow(judge, "u long, v long")


def _estimates(codes: np.ndarray, i: int, others: np.ndarray, own: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """estimate() of one sketch with many, on codes in the order of the values; ``own`` marks the codes of sketch i."""
    none = len(blank)
    mine, theirs = codes[i], codes[others]
    shared = own[theirs]
    rest = np.where(shared | blank[theirs], none, theirs)
    union = np.concatenate([np.broadcast_to(np.where(blank[mine], none, mine), rest.shape), rest], axis=1)
    union.sort(axis=1)
    full = ~blank[mine].any() | ~blank[theirs].any(axis=1)
    last = np.where(full, union[:, codes.shape[1] - 1], none)[:, None]
    return (shared & (theirs <= last)).sum(axis=1) / np.maximum(((union <= last) & (union < none)).sum(axis=1), 1)


def _across(groups: DataFrame, roots: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Candidate links (u, v) across components, from hub groups that hold several: each pair is held against sketches
    of ``FINE`` values, which are the whole sets of most texts. Larger groups are dealt out in pairs of blocks."""
    rooted = groups.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rooted = stored(rooted.join(classes.select("cid", "n"), "cid"), "near-groups")
    open_ = rooted.groupBy("hub").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("m")).where("a <> b")
    rows = stored(rooted.join(open_.select("hub", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "hub"), "near-open")
    fine = _sets(docs, classes, rows.select("cid").distinct(), width, FINE)
    rows = rows.join(fine, "cid").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def run(t: pa.Table) -> pa.Table:
        ids, root, n, block = (t.column(c).to_numpy() for c in ("cid", "root", "n", "block"))
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        grid = _grid(t.column("items").to_pylist(), FINE)
        values, codes = np.unique(grid, return_inverse=True)
        codes = codes.reshape(grid.shape).astype(np.int32)
        blank = values == NONE
        whole = n <= FINE
        marked = np.zeros(len(values), bool)
        # A pair across components has an end outside the most frequent one.
        names, counts = np.unique(root, return_counts=True)
        outside = root != names[counts.argmax()]
        us, vs = [], []
        for i in np.flatnonzero(outside).tolist():
            facing = block == (hi if block[i] == lo else lo)
            able = facing & (root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            able &= ~outside | (ids < ids[i])
            others = np.flatnonzero(able)
            marked[codes[i]] = True
            marked[blank] = False
            shared = marked[codes[others]].sum(axis=1)
            exact = whole[others] & whole[i]
            sure = exact & (100 * shared >= percent * (n[others] + n[i] - shared))
            # Shared retained values bound the overlap of the union's sketch from above.
            maybe = ~exact & (shared >= (percent / 100 - FINE_SLACK) * np.minimum(FINE, np.maximum(n[others], n[i])))
            rest = others[maybe]
            rest = rest[_estimates(codes, i, rest, marked, blank) >= percent / 100 - FINE_SLACK] if len(rest) else rest
            marked[codes[i]] = False
            others = np.concatenate([others[sure], rest])
            us.append(np.maximum(ids[i], ids[others]))
            vs.append(np.minimum(ids[i], ids[others]))
        us, vs = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
        return pa.table({"u": us, "v": vs})

    group = ["hub", "lo", "hi"]
    return dealt.select(*group, "block", "cid", "root", "n", "items").groupBy(*group).applyInArrow(run, "u long, v long").distinct()


def _placed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, tag, n, root) per document; root names its component."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100: the inverted lists' runs are too long for less")
    lowest = percent / 100 - SLACK
    members = stored(sketched(docs, width), "near-members")
    filled = members.where("n > 0")
    classes = filled.groupBy("cid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "tag")).alias("rep"))
    classes = stored(classes, "near-classes")
    keys = stored(_memberships(classes), "near-keys")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    lists = stored(keys.join(counts, "key"), "near-lists")
    groups = stored(_hub_groups(lists), "near-hubs")
    spokes = groups.where("hub <> cid").select(F.greatest("hub", "cid").alias("u"), F.least("hub", "cid").alias("v"))
    links = _short_pairs(lists).union(spokes).distinct()
    first = _verified(stored(_estimated(links, classes, lowest, percent), "near-links"), docs, classes, width, percent)
    first = stored(first, "near-edges")
    roots = components(first).select(F.col("node").alias("cid"), "root")
    more = stored(_across(groups, roots, docs, classes, width, percent), "near-more")
    if not more.isEmpty():
        first = first.union(_verified(more, docs, classes, width, percent))
        roots = components(first).select(F.col("node").alias("cid"), "root")
    placed = members.select("doc_id", "tag", "n", "cid").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    return stored(placed.drop("cid"), "near-placed")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document: linked are those of ``percent`` similarity or more over
    shingles of ``width`` words; component_id is the least doc_id that links lead to, and ``kept`` marks it."""
    placed = _placed(docs, width, percent)
    least = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = placed.join(least, "root", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, that of the least doc_id, with all columns."""
    placed = _placed(docs, width, percent).where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    groups = placed.groupBy("root").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = placed.join(groups, "root").groupBy("doc_id", "tag").agg(
        F.first(F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("tag") == F.col("m.tag"))).alias("leads"), F.count(F.lit(1)).alias("size")
    )
    rows = stored(rows.where("NOT leads OR size > 1"), "near-gone")
    inner = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(inner).select("row", F.col("row.doc_id").alias("own_id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("own_tag"))

    def same(marks: DataFrame) -> Column:
        return (keyed["own_tag"] == marks["tag"]) & keyed["own_id"].eqNullSafe(marks["doc_id"])

    once = keyed.join(rows, same(rows), "left_anti").select("row")
    if not (twice := rows.where("leads")).isEmpty():  # rows that stand several times, of which one stays
        again = keyed.join(twice, same(twice), "left_semi")
        once = once.union(again.groupBy("own_id", "own_tag").agg(F.first("row").alias("row")).select("row"))
    return once.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
