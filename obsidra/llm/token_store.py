"""Content-addressed store of token ids.

A rolling hash over the last ``WINDOW`` ids cuts each document's id stream where the hash's low bits are zero, so equal
passages give equal chunks wherever they stand. A chunk is stored once, under the BLAKE2b digest of its ids. A
document's recipe lists the digests of its chunks and the root of the Merkle tree over them; the manifest is the tree
above: a node over each ``FAN`` neighbouring recipes, one over the nodes of each recipe file, one over all files. Reading
works it out again from the recipes and raises if a node isn't there or has changed, a chunk is missing or has other ids,
or a recipe's chunks don't add up to its number of ids.

Files, all under one folder, as Parquet:

- ``objects/kind=chunk``: key (digest), n_ids, payload (ids as little-endian unsigned 16 or 32 bits, zstandard)
- ``recipes``: doc_id ascending from file to file and within each; n_tokens, root, digests on end, part (number of the file)
- ``manifest``: level (0 to 2), part, block, documents, n_tokens, root

Encoding happens once and the ids cross the network once, on their way to the one place of each chunk. Reading joins
chunk digests, lengths and checksums with the recipes; crc32 is linear, so that of a document is the exclusive or of
those of its chunks, each shifted by the bytes behind it.

Defined cases: null text counts as empty (the end id alone); rows with the same doc_id are kept apart and ordered by
root; a null doc_id comes first; a long text is many chunks, of which a task holds one text's at a time; an empty table
gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsidra.llm.common import checked_columns, sliced
from obsidra.llm.tokens import END_ID, encoder

DIGEST = 16
WINDOW = 8
FAN = 1024
OBJECTS = pa.schema(
    [("key", pa.binary()), ("kind", pa.string()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("doc_id", pa.int64())]
)
OBJECTS_DDL = "key binary, kind string, n_ids long, payload binary, doc_id long"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd node moves up as it is. Leaves and nodes are hashed apart."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"\0")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def cut_positions(ids: np.ndarray, at: np.ndarray, mean: int, most: int) -> np.ndarray:
    """Ends of the chunks of documents that stand on end in ``ids``, at ``at``: behind ids where the rolling hash of their
    document's low bits are zero, at most ``most`` ids apart, and behind each document."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * factor
        mixed ^= mixed >> np.uint64(29)
        rolled = mixed.copy()
        weight = np.uint64(1)
        for k in range(1, min(WINDOW, len(ids))):
            weight *= np.uint64(0xD6E8FEB86659FD93)
            rolled[k:] += mixed[:-k] * weight
            for j in range(k):  # what the last k ids of the document before have added
                own = at[:-1][(at[:-1] + j < at[1:]) & (at[:-1] + j >= k)] + j
                rolled[own] -= mixed[own - k] * weight
        rolled *= factor
        hits = np.flatnonzero((rolled >> np.uint64(40)) & np.uint64(mean - 1) == 0) + 1
    ends = np.union1d(hits, at[1:][at[1:] > at[:-1]])
    gaps = np.diff(ends, prepend=0)
    if (wide := np.flatnonzero(gaps > most)).size:
        ends = np.union1d(ends, np.concatenate([np.arange(ends[k] - gaps[k] + most, ends[k], most) for k in wide]))
    return ends


def write(
    docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = END_ID, mean: int = 512, most: int = 4096
) -> None:
    """Writes the store of ``docs`` (doc_id, text) to the folder ``path``. ``mean`` has to be a power of two."""
    if mean & (mean - 1):
        raise ValueError("mean must be a power of two")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        narrow = "<u2" if coder.vocab_size <= 1 << 16 and end_id < 1 << 16 else "<u4"
        pressed = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches):
            found, at = coder.encode_documents(batch.column(1), end_id)
            raws, width = found.astype(narrow).tobytes(), np.dtype(narrow).itemsize
            cuts = cut_positions(found, at, mean, most)
            of, cuts, bounds = np.searchsorted(cuts, at, side="right").tolist(), cuts.tolist(), at.tolist()
            seen: set[bytes] = set()
            rows: dict[str, list] = {f.name: [] for f in OBJECTS}
            held = 0
            for k, doc in enumerate(batch.column(0).to_pylist()):
                keys, start = [], bounds[k]
                for end in cuts[of[k] : of[k + 1]]:
                    raw = raws[start * width : end * width]
                    keys.append(key := digest(raw))
                    if key not in seen:
                        seen.add(key)
                        _add(rows, key, "chunk", end - start, pressed.compress(raw), None)
                        held += len(rows["payload"][-1])
                    start = end
                root = merkle_root(keys)
                _add(rows, root, "recipe", bounds[k + 1] - bounds[k], b"".join(keys), doc)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pydict(rows, schema=OBJECTS)
                    rows, held = {f.name: [] for f in OBJECTS}, 0
            yield pa.RecordBatch.from_pydict(rows, schema=OBJECTS)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:  # sorted by kind and key: recipes pass, of equal chunks the first
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            before = pa.concat_arrays([pa.array([last], keys.type), keys.slice(0, len(keys) - 1)])
            again = pc.and_(pc.equal(batch.column(1), "chunk"), pc.fill_null(pc.equal(keys, before), False))
            last = keys[len(keys) - 1].as_py()
            yield batch.filter(pc.invert(again))

    # A chunk goes to the place its digest names; a recipe is small and goes anywhere, spread by document.
    place = F.when(F.col("kind") == "chunk", F.xxhash64("key")).otherwise(F.xxhash64("key", "doc_id"))
    (
        checked_columns(docs, "doc_id", "text")
        .mapInArrow(encode, OBJECTS_DDL)
        .withColumn("place", place)
        .repartition("place")
        .drop("place")
        .sortWithinPartitions("kind", "key")
        .mapInArrow(once, OBJECTS_DDL)
        .write.option("compression", "zstd")
        .partitionBy("kind")
        .parquet(f"{path}/objects")
    )
    spark = docs.sparkSession
    (
        _objects(spark, path, "recipe")
        .select("doc_id", F.col("n_ids").alias("n_tokens"), F.col("key").alias("root"), F.col("payload").alias("digests"))
        .repartitionByRange("doc_id", "root")
        .sortWithinPartitions("doc_id", "root")
        .withColumn("part", F.spark_partition_id())
        .write.option("compression", "zstd")
        .parquet(f"{path}/recipes")
    )
    manifest_of(_recipes(spark, path)).write.parquet(f"{path}/manifest")


def _add(rows: dict[str, list], key: bytes, kind: str, n: int, payload: bytes, doc: int | None) -> None:
    for name, value in (("key", key), ("kind", kind), ("n_ids", n), ("payload", payload), ("doc_id", doc)):
        rows[name].append(value)


def _objects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(OBJECTS_DDL).parquet(f"{path}/objects").where(F.col("kind") == kind)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, root binary, digests binary, part int").parquet(f"{path}/recipes")


def manifest_of(recipes: DataFrame) -> DataFrame:
    """(level, part, block, documents, n_tokens, root) of the nodes above the recipes; a node's root is the SHA-256 of the
    roots below it in their order. Lists are of at most ``FAN`` recipes, of a file's nodes, of one entry a file."""
    place = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "root")) - 1
    leaves = recipes.select("part", "n_tokens", "root", place.alias("place")).withColumn("block", F.floor(F.col("place") / FAN))

    def above(nodes: DataFrame, level: int, keys: list[str], order: str, documents: Column) -> DataFrame:
        ordered = F.transform(F.sort_array(F.collect_list(F.struct(order, "root"))), lambda x: F.hex(x["root"]))
        root = F.unhex(F.sha2(F.concat_ws("", ordered), 256))
        made = nodes.groupBy(*keys).agg(documents.cast("long").alias("documents"), F.sum("n_tokens").alias("n_tokens"), root.alias("root"))
        return made.withColumn("level", F.lit(level))

    blocks = above(leaves, 0, ["part", "block"], "place", F.count(F.lit(1)))
    files = above(blocks, 1, ["part"], "block", F.sum("documents")).withColumn("block", F.lit(-1).cast("long"))
    top = above(files.drop("level"), 2, [], "part", F.sum("documents"))
    top = top.where("documents > 0").withColumns({"part": F.lit(-1), "block": F.lit(-1).cast("long")})
    columns = ["level", "part", "block", "documents", "n_tokens", "root"]
    return blocks.select(*columns).union(files.select(*columns)).union(top.select(*columns))


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the recipes still have the tree that the manifest names."""
    there = spark.read.parquet(f"{path}/manifest")
    now = manifest_of(_recipes(spark, path))
    same = [there[c].eqNullSafe(now[c]) for c in ("level", "part", "block")]
    both = there.join(now, same[0] & same[1] & same[2], "full_outer")
    alike = there["root"].eqNullSafe(now["root"]) & there["documents"].eqNullSafe(now["documents"]) & there["n_tokens"].eqNullSafe(now["n_tokens"])
    return both.where(~alike).isEmpty()


def _unpacked(payload: bytes, n_ids: int, key: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    if digest(raw) != key:
        raise ValueError(f"chunk {key.hex()} doesn't have the ids it was stored with")
    width = len(raw) // max(n_ids, 1)
    return np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")


def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts, payloads = (batch.column(k).to_pylist() for k in range(3))
        sums = [zlib.crc32(_unpacked(p, n, k).tobytes()) for k, n, p in zip(keys, counts, payloads, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, type=pa.int64())], ["digest", "n", "crc"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes to their chunks; raises where the root isn't that of the digests."""
    for batch in batches:
        roots, out, which, place = batch.column(0).to_pylist(), [], [], []
        for root, raw in zip(roots, batch.column(1).to_pylist(), strict=True):
            keys = [raw[k : k + DIGEST] for k in range(0, len(raw), DIGEST)]
            if merkle_root(keys) != root:
                raise ValueError(f"recipe {root.hex()} doesn't have that root")
            out += keys
            which += [root] * len(keys)
            place += range(len(keys))
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.binary()), pa.array(place, pa.int64()), pa.array(out, pa.binary())], ["root", "place", "digest"]
        )


def _shift_tables() -> np.ndarray:
    """[k, bit]: the crc32 register with that bit set, moved on by 2**k zero bytes."""
    step = np.empty(32, dtype=np.uint32)
    for bit in range(32):
        x = 1 << bit
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        step[bit] = x
    tables = [step]
    for _ in range(39):
        tables.append(_moved(tables[-1], tables[-1]))
    return np.stack(tables)


def _moved(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), table[bit], np.uint32(0))
    return out


def shifted_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc32 values as they count in a text with ``n_bytes`` further bytes behind them."""
    out, tables = crc.astype(np.uint32), _shift_tables()
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        on = np.flatnonzero(n_bytes >> k & 1)
        out[on] = _moved(out[on], tables[k])
    return out


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, behind = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shifted_crc(crc, behind).astype(np.int64)), batch.column(2)], ["root", "crc", "n"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files; every chunk, recipe and node is verified."""
    if not verify(spark, path):
        raise ValueError(f"the recipes of {path} don't have the tree that its manifest names")
    chunks = _objects(spark, path, "chunk").select("key", "n_ids", "payload")
    sums = chunks.mapInArrow(_chunk_sums, "digest binary, n long, crc long")
    recipes = _recipes(spark, path)
    # Once per text and file: a text that stands in a third of all documents is a row a file.
    held = recipes.groupBy("root", "part").agg(F.first("digests").alias("digests"))
    distinct = held.groupBy("root").agg(F.first("digests").alias("digests"))
    steps = distinct.mapInArrow(_steps, "root binary, place long, digest binary").join(sums, "digest", "left")
    missing = F.raise_error(F.concat(F.lit("missing chunk "), F.hex("digest"))).cast("long")
    steps = steps.select("root", "place", F.coalesce("n", missing).alias("n"), "crc")
    behind = Window.partitionBy("root").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    moved = steps.select("root", "crc", "n", (F.coalesce(F.sum("n").over(behind), F.lit(0)) * 4).alias("behind"))
    by_root = (
        moved.mapInArrow(_shifted, "root binary, crc long, n long")
        .groupBy("root")
        .agg(F.expr("bit_xor(crc)").alias("ids_crc32"), F.sum("n").alias("n_ids"))
    )
    by_part = held.select("root", "part").join(by_root, "root")
    # Ids before each file: a row a file, so a window over all of them is small.
    parts = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select("doc_id", "n_tokens", "root", "part", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("own"))
    odd = F.raise_error(F.concat(F.lit("chunks don't add up to the ids of recipe "), F.hex("root"))).cast("long")
    return (
        placed.join(parts, "part")
        .join(by_part, ["part", "root"])
        .select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", F.when(F.col("n_ids") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(odd).alias("ids_crc32"))
    )


def restore(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, root, ids) with all ids of each document (little-endian unsigned 32 bits), put together from chunks."""
    steps = _recipes(spark, path).select("root", "digests").dropDuplicates(["root"])
    steps = steps.mapInArrow(_steps, "root binary, place long, digest binary")

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, payloads = (batch.column(k).to_pylist() for k in range(3))
            ids = [_unpacked(p, n, k).tobytes() for k, n, p in zip(keys, counts, payloads, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["digest", "ids"])

    chunks = _objects(spark, path, "chunk").select("key", "n_ids", "payload").mapInArrow(wide, "digest binary, ids binary")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"])
    missing = F.raise_error(F.concat(F.lit("missing chunk "), F.hex("digest"))).cast("binary")
    found = steps.join(chunks, "digest", "left").select("root", "place", F.coalesce("ids", missing).alias("ids"))
    whole = found.groupBy("root").agg(ordered.alias("parts"))
    joined = F.aggregate("parts", F.expr("cast('' as binary)"), lambda a, x: F.concat(a, x)).alias("ids")
    return _recipes(spark, path).select("doc_id", "root").join(whole.select("root", joined), "root")
