"""The registered queries of this package: thin, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from obsidra.llm import chat, cross_polytope, exact_search, langid, minhash, mixing, packing, quality, suffix_dedup, token_store
from obsidra.llm.common import fresh_path, table
from obsidra.llm.tokens import vocabulary


#: Target weights of the mixing tree; nodes not named here weigh 1 among their siblings.
MIX_WEIGHTS = {("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0, ("d0", "en"): 2.0}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=False).drop("ids")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated(table(spark, sf_dir, "documents")).drop("kept")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op5_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(table(spark, sf_dir, "embeddings"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_store.read(spark, path)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select_prefixes(table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS)


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_search": EXACT_SEARCH, "op8_chat": CHAT}


EXACT_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""

CHAT = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY place) AS turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
  FROM t GROUP BY conv_id
)
SELECT a.conv_id, a.n AS n_turns, a.rendered FROM c a WHERE NOT EXISTS (
  SELECT 1 FROM c b WHERE b.turns[1] = a.turns[1] AND b.turns[1:a.n] = a.turns
    AND (b.n > a.n OR (b.n = a.n AND b.conv_id < a.conv_id))
)
"""
