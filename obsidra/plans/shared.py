"""Tables between the rounds of iterative operators: written to the folder that all executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of its own only where the session has none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark, "_obsidra_rounds", None) or tempfile.mkdtemp(prefix="obsidra-rounds-")
        spark._obsidra_rounds = found
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/obsidra/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
