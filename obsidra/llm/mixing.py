"""Mixing sources to target weights by hierarchical budgeting. Native: DataFrame functions only on the data.

Tree: root, domain, language, source. A node's capacity is what its leaves hold in ``max_epochs`` epochs. Going down,
a node's budget is shared among its children by weight, none above its capacity; what a child can't take goes to its
siblings by weight, and only what all of them can't take is left to the levels above, which know it from the
capacities. A leaf takes a token-prefix of its documents in the order of a seeded hash, anew in each epoch.

Tokens are counted once, into a table of (doc_id, leaf, tokens). Prefix sums are split by hash range and dealt by it, so
no task holds a whole leaf. Only leaf totals, one row a leaf, reach the driver; budgets are broadcast if there are at most
``BROADCAST`` leaves, else joined.

Defined cases: null language or source is a leaf of its own, named ``(none)``; null text holds no tokens; such a row is
taken where its place is inside the prefix; a null doc_id is hashed as an empty one; rows that repeat a doc_id in a leaf
stand and go together; an empty table gives no rows; other columns, whatever their names, are ignored by
``select_prefixes`` and kept by ``mix``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsidra.llm.common import checked_columns, stored

LEAF = ["mix_domain", "mix_lang", "mix_source"]
BROADCAST = 10_000


def numbered_domain(source: Column, domains: int = 4) -> Column:
    """Domain of a source that ends in a number: the number modulo ``domains``; 0 for others."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(mix_source, '([0-9]{1,9})$', 1) as int)"), F.lit(0))
    return F.concat(F.lit("d"), (number % domains).cast("string"))


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    trimmed = F.trim(F.translate(text, "\t\n\r\f\v", "     "))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, " +"))).cast("long")


def share(budget: float, weights: Mapping[str, float], capacity: Mapping[str, float]) -> dict[str, float]:
    """``budget`` by weight, none above its capacity; what one can't take goes to the others by weight."""
    given = dict.fromkeys(capacity, 0.0)
    open_ = {k for k in capacity if weights.get(k, 0) > 0 and capacity[k] > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in sorted(open_))
        part = {k: left * weights[k] / total for k in sorted(open_)}
        full = {k for k in part if given[k] + part[k] >= capacity[k]}
        if not full:
            for k, v in part.items():
                given[k] += v
            break
        for k in sorted(full):
            left -= capacity[k] - given[k]
            given[k] = capacity[k]
        open_ -= full
    return given


def leaf_budgets(leaves: Mapping[tuple[str, str, str], float], budget: float, weights: Mapping[tuple[str, ...], float], max_epochs: int) -> dict[tuple[str, str, str], float]:
    """Tokens for each leaf; ``leaves`` has the tokens each holds. Nodes without a weight of their own weigh 1."""

    below: dict[tuple[str, ...], set[str]] = {}
    room: dict[tuple[str, ...], float] = {}
    for leaf, held in leaves.items():
        for k in range(len(leaf)):
            below.setdefault(leaf[:k], set()).add(leaf[k])
            room[leaf[: k + 1]] = room.get(leaf[: k + 1], 0.0) + max_epochs * held

    def down(path: tuple[str, ...], amount: float) -> dict[tuple[str, str, str], float]:
        if len(path) == 3:
            return {path: amount}
        names = sorted(below.get(path, ()))
        given = share(amount, {c: weights.get((*path, c), 1.0) for c in names}, {c: room[(*path, c)] for c in names})
        return {leaf: v for c in names for leaf, v in down((*path, c), given[c]).items()}

    return down((), budget)


def _leafed(docs: DataFrame, domain: Column | None) -> DataFrame:
    """(doc_id, mix_tokens, LEAF) per row, stored: texts are read once."""
    named = checked_columns(docs, "doc_id", "text", "lang", "source").withColumns({
        "mix_lang": F.coalesce(F.col("lang"), F.lit("(none)")), "mix_source": F.coalesce(F.col("source"), F.lit("(none)")),
        "mix_tokens": tokens_of(F.col("text")),
    })
    named = named.withColumn("mix_domain", numbered_domain(F.col("mix_source")) if domain is None else domain)
    return stored(named.select("doc_id", "mix_tokens", *LEAF), "mix-leaves")


def _key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("mix_epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def plan(leafed: DataFrame, fraction: float, weights: Mapping[tuple[str, ...], float], max_epochs: int) -> tuple[DataFrame, int, int]:
    """Leaf budgets (LEAF, mix_held, mix_budget, mix_epochs), the rows of the largest leaf, and how many leaves."""
    totals = leafed.groupBy(*LEAF).agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    held = {tuple(r[c] for c in LEAF): float(r.tokens) for r in totals}
    # The share of a whole number of tokens; a leaf's budget is rounded up, so a full leaf keeps its last row.
    budgets = leaf_budgets(held, fraction * sum(held.values()), weights, max_epochs)
    rows = [(*leaf, int(held[leaf]), b := math.ceil(v - 1e-6), max(1, math.ceil(b / held[leaf])) if held[leaf] else 1) for leaf, v in budgets.items()]
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in LEAF], T.StructField("mix_held", T.LongType()), T.StructField("mix_budget", T.LongType()), T.StructField("mix_epochs", T.IntegerType())])
    return leafed.sparkSession.createDataFrame(rows, schema), max([r.n for r in totals], default=0), len(rows)


def _bounded(budgets: DataFrame, n: int) -> DataFrame:
    """Marked for broadcast if ``n`` rows are few."""
    return F.broadcast(budgets) if n <= BROADCAST else budgets


def _placed(leafed: DataFrame, budgets: DataFrame, seed: int, largest: int, rows_a_range: int) -> DataFrame:
    """Rows per epoch with the tokens before them in their leaf's order (``mix_before``)."""
    digits = min(6, max(1, math.ceil(math.log(max(largest, 1) / rows_a_range, 16)) if largest > rows_a_range else 1))
    narrow = leafed.join(budgets, LEAF).where("mix_budget > 0")
    keyed = narrow.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_epochs") - 1))).withColumn("mix_key", _key(seed))
    ranged = keyed.withColumn("mix_range", F.substring("mix_key", 1, digits))
    group = [*LEAF, "mix_epoch"]
    sums = ranged.groupBy(*group, "mix_range").agg(F.sum("mix_tokens").alias("t"))
    before = Window.partitionBy(*group).orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*group, "mix_range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("mix_base"))
    ranged = ranged.repartition(*group, "mix_range")
    inside = Window.partitionBy(*group, "mix_range")
    upto = inside.orderBy("mix_key")  # rows of one key count together
    own = F.sum("mix_tokens").over(upto) - F.sum("mix_tokens").over(Window.partitionBy(*group, "mix_range", "mix_key"))
    return ranged.withColumn("mix_own", own).join(bases, [*group, "mix_range"]).withColumn(
        "mix_before", F.col("mix_epoch") * F.col("mix_held") + F.col("mix_base") + F.col("mix_own")
    )


def select_prefixes(docs: DataFrame, *, fraction: float = 0.5, weights: Mapping[tuple[str, ...], float] | None = None, domain: Column | None = None, max_epochs: int = 4, seed: int = 17, rows_a_range: int = 20_000) -> DataFrame:
    """What each leaf takes of ``docs`` (doc_id, text, lang, source): (doc_id, domain, lang, source, epoch, before,
    take_tokens). The budget is ``fraction`` of all tokens; ``weights`` has paths such as (domain,) or (domain, lang)."""
    leafed = _leafed(docs, domain)
    budgets, largest, leaves = plan(leafed, fraction, weights or {}, max_epochs)
    rows = _placed(leafed, _bounded(budgets, leaves), seed, largest, rows_a_range).where("mix_before < mix_budget")
    return rows.select(
        "doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"),
        F.col("mix_epoch").alias("epoch"), F.col("mix_before").alias("before"),
        F.least("mix_tokens", F.col("mix_budget") - F.col("mix_before")).alias("take_tokens"),
    )


def mix(docs: DataFrame, *, fraction: float = 0.9, weights: Mapping[tuple[str, ...], float] | None = None, domain: Column | None = None, max_epochs: int = 4, seed: int = 17, rows_a_range: int = 20_000) -> DataFrame:
    """The documents taken, whole and with all their columns, once an epoch; the text is never shuffled: a leaf's
    prefix is the rows up to its last key. ``domain`` is a column of doc_id, mix_lang and mix_source."""
    leafed = _leafed(docs, domain)
    budgets, largest, leaves = plan(leafed, fraction, weights or {}, max_epochs)
    taken = _placed(leafed, _bounded(budgets, leaves), seed, largest, rows_a_range).where("mix_before < mix_budget")
    last = taken.groupBy(*LEAF, "mix_epoch").agg(F.max("mix_key").alias("mix_last"))
    # The caller's columns stand in one struct, out of the way of those worked with.
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"))
    named = kept.select("mix_row", F.col("mix_row.doc_id").alias("doc_id"), F.coalesce("mix_row.lang", F.lit("(none)")).alias("mix_lang"), F.coalesce("mix_row.source", F.lit("(none)")).alias("mix_source"))
    named = named.withColumn("mix_domain", numbered_domain(F.col("mix_source")) if domain is None else domain)
    out = named.join(_bounded(last, leaves * max_epochs), LEAF).where(_key(seed) <= F.col("mix_last"))
    return out.select(*[F.col(f"mix_row.`{c}`").alias(c) for c in docs.columns])
