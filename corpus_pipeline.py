"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

Every stage works on all that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from obsidra.llm import minhash, mixing, packing, quality, suffix_dedup
from obsidra.llm.common import stored, table
from obsidra.llm.queries import MIX_WEIGHTS
from obsidra.llm.tokens import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.keep_first(docs, width=5, percent=80)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes or more that stand earlier in the corpus."""
    return suffix_dedup.without_repeats(docs, length=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all tokens, shared out by the target weights."""
    return mixing.mix(docs, fraction=0.9, weights=MIX_WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 token ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_stage),
    ("suffix-array dedup", passage_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Training, sketches and dynamic programming: no SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.split()[0].lower())
    return docs
