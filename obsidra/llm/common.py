"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SLICE_BYTES = 4 << 20
SLICE_ROWS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; set here only if the session has none and runs on one
    machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark, "_obsidra_shared", None)
        if not found:
            found = tempfile.mkdtemp(prefix="obsidra-shared-")
            spark._obsidra_shared = found
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/obsidra/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; the split rule of the labelled operators."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def rows_as_batches(schema: pa.Schema, columns: dict[str, list], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from equally long column lists."""
    total = len(next(iter(columns.values())))
    for at in range(0, total, size):
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name][at : at + size], type=f.type) for f in schema], schema=schema
        )


def checked_columns(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` cut down to the needed columns, so that extra columns with clashing names can't interfere."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in needed])


def _sizes(column: pa.Array) -> np.ndarray | int:
    """Bytes per row of a column of texts, bytes or lists; for others a constant."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(column.type):
        return 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return 8


def sliced(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``most`` bytes (or of one row, if that is longer) and at most ``rows``
    rows, so that what a task works out at once is bounded in bytes whatever a batch holds. An empty batch gives itself."""
    for batch in batches:
        n = batch.num_rows
        size = sum((_sizes(c) for c in batch.columns), np.zeros(n, np.int64))
        part = (np.cumsum(size) - size) // most
        cuts = np.flatnonzero(np.diff(part, prepend=0)) if n else np.zeros(0, np.int64)
        bounds = np.unique(np.concatenate(([0, n], cuts, np.arange(0, n, rows))))
        if n <= 1 or len(bounds) == 2:
            yield batch
        else:
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):  # noqa: B905
                yield batch.slice(a, b - a)
        del batch
        released()


def released() -> None:
    """Gives freed memory back to the system: a Python worker outlives its tasks, and keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _TRIM = None
