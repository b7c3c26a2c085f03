"""Sliding windows over a grid of steps, without a copy of a row for each step that it counts for.

Rows are first aggregated into cells, whose width divides both step and range, so a window is a whole number of cells.
Cells are cut into blocks of a window's length; a window is then the end of one block and the beginning of the next, and
running aggregates from both ends of each block give every window from two of them. Work is in proportion to cells and
results, whatever the range. Parts have to be mergeable: sums, least, greatest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Part = tuple[Column, Callable[[Column], Column]]  # of the rows of a cell, and how two such are put together


def sliding(df: DataFrame, parts: Mapping[str, Part], *, start: int, end: int, step: int, size: int, time: str = "ts_ms") -> DataFrame:
    """(labels, at, *parts) per label set and step ``at`` in start, start + step .. end whose window (at - size, at] has
    rows; ``df`` has labels, series (a name of the label set) and ``time``."""
    cell = size if start == end else math.gcd(step, size)
    cells, stride, most = size // cell, max(step // cell, 1), 0 if start == end else (end - start) // step
    pos = F.ceil((F.col(time) - F.lit(start)) / F.lit(cell)).cast("long")
    own = df.withColumn("pos", pos).where((F.col("pos") > -cells) & (F.col("pos") <= most * stride))
    own = own.groupBy("series", "pos").agg(F.first("labels").alias("labels"), *[made.alias(n) for n, (made, _) in parts.items()])
    # Each step is asked for by the last cell at or before it.
    after = F.lead("pos").over(Window.partitionBy("series").orderBy("pos"))
    last = F.least(F.coalesce(after - 1, F.lit(1 << 61)), F.col("pos") + cells - 1, F.lit(most * stride))
    marked = own.withColumns({"first_step": F.greatest(F.lit(0), F.ceil(F.col("pos") / stride)).cast("long"), "last_step": F.floor(last / stride).cast("long")})
    asked = F.when(F.col("first_step") <= F.col("last_step"), F.sequence("first_step", "last_step"))
    # A row is a cell (kind 0), or asks for the cells up to pos (kind 1) or from it on (kind 2) within its block.
    one = lambda kind, at, where: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"), where.cast("long").alias("pos"))
    turns = F.transform(asked, lambda k: F.array(one(1, k, k * stride), one(2, k, k * stride - cells + 1)))
    rows = F.concat(F.array(one(0, F.lit(None), F.col("pos"))), F.coalesce(F.flatten(turns), F.expr("cast(array() as array<struct<kind:int,at:bigint,pos:bigint>>)")))
    dealt = marked.withColumn("x", F.explode(rows)).select(
        "series", "labels", "x.kind", "x.at", F.col("x.pos").alias("pos"), *[F.when(F.col("x.kind") == 0, F.col(n)).alias(n) for n in parts]
    )
    # A window that is one whole block has no other part.
    dealt = dealt.where((F.col("kind") < 2) | (F.pmod("pos", F.lit(cells)) != 0)).withColumn("block", F.floor(F.col("pos") / cells))
    block = Window.partitionBy("series", "block")
    up = block.orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = block.orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumns({f"up_{n}": join(F.col(n)).over(up) for n, (_, join) in parts.items()})
    seen = seen.withColumns({f"down_{n}": join(F.col(n)).over(down) for n, (_, join) in parts.items()}).where("kind > 0")
    of = lambda n: F.when(F.col("kind") == 1, F.col(f"up_{n}")).otherwise(F.col(f"down_{n}"))
    both = seen.groupBy("series", "at").agg(F.first("labels").alias("labels"), *[join(of(n)).alias(n) for n, (_, join) in parts.items()])
    return both.withColumn("at", F.col("at") * step + start).drop("series")
