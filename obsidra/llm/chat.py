"""Chat formatting: logs that store every turn's snapshot are collapsed to maximal conversations, then rendered.

Native: DataFrame functions only. Turns are numbered within a conversation; the exclusive or of position-tagged hashes
of the turns so far is a rolling hash of each prefix. A conversation whose (length, hash) is a strict prefix of another
goes by an anti-join; of equal conversations the one with the smallest id stays.

Defined cases: turns are ordered by turn, role, text, nulls first, so ties and repeated rows have a place; null role or
text counts as empty; a null conv_id is one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsidra.llm.common import checked_columns


def with_prefixes(turns: DataFrame) -> DataFrame:
    """Turns with their place (from 1) and two rolling hashes of the prefix that they end."""
    turns = checked_columns(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("place", F.row_number().over(order))
    tagged = placed.withColumn("h1", F.xxhash64("place", "role", "text")).withColumn("h2", F.xxhash64("text", "place", "role", F.lit(1)))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn("p1", F.expr("bit_xor(h1)").over(upto)).withColumn("p2", F.expr("bit_xor(h2)").over(upto))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of another; one of each group of equal ones."""
    marks = with_prefixes(turns).select("conv_id", "place", "p1", "p2")
    last = marks.groupBy("conv_id").agg(F.max(F.struct("place", "p1", "p2")).alias("m"))
    whole = last.select("conv_id", F.col("m.place").alias("place"), F.col("m.p1").alias("p1"), F.col("m.p2").alias("p2"))
    one = whole.groupBy("place", "p1", "p2").agg(F.min(F.struct(F.col("conv_id"))).alias("first"))
    ends = whole.select("conv_id", F.col("place").alias("n"))
    inner = marks.join(ends, marks["conv_id"].eqNullSafe(ends["conv_id"])).where(F.col("place") < F.col("n"))
    prefixes = inner.select("place", "p1", "p2").distinct()
    return one.join(prefixes, ["place", "p1", "p2"], "left_anti").select(F.col("first.conv_id").alias("conv_id"), F.col("place").alias("n_turns"))


def render(turns: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, rendered) per maximal conversation."""
    kept = maximal(turns).withColumnRenamed("conv_id", "kept_id")
    placed = with_prefixes(turns).select(
        "conv_id", "place", F.concat(F.lit(opening), "role", F.lit("\n"), "text", F.lit(closing + "\n")).alias("line")
    )
    joined = placed.join(kept, placed["conv_id"].eqNullSafe(kept["kept_id"]))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
    return joined.groupBy("conv_id", "n_turns").agg(F.array_join(lines, "").alias("rendered")).select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), "rendered"
    )
