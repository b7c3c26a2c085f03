"""The log query language on DataFrames of entries.

Log queries give (timestamp_ns, labels, string, value); metric queries give (labels, bucket_ns, value). Range functions
count in tumbling buckets, or with ``sliding`` in windows that end at each step. Samples of value 0 are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsidra.functions import labels as L
from obsidra.functions.templates import compiled
from obsidra.plans import logql as Q
from obsidra.plans import plugins
from obsidra.plans.lexing import QueryError
from obsidra.plans.model import Timed, canonical


@dataclass(frozen=True)
class Options:
    from_ns: int | None = None
    to_ns: int | None = None
    step_ns: int | None = None
    limit: int = 0
    ordered: bool = False  # by label set and time, in the query's direction
    approximate: bool = False  # quantiles without a buffer of all values
    forward: bool = False
    sliding: bool = False
    zeros: bool = False  # keep samples of value 0


def query(entries: DataFrame, text: str, options: Options | None = None) -> DataFrame:
    """Runs a query over entries (timestamp_ns, labels, string, value)."""
    options = options or Options()
    if (own := plugins.planned("log_query", entries, text, options)) is not None:
        return own
    tree = Q.parse(text)
    if isinstance(tree, Q.Selection):
        found = selected(entries, tree, options)
        if options.limit:
            order = F.asc if options.forward else F.desc
            found = found.orderBy(order("timestamp_ns"), canonical(F.col("labels")), "string").limit(options.limit)
        if options.ordered:
            found = found.orderBy(canonical(F.col("labels")), (F.asc if options.forward else F.desc)("timestamp_ns"), "string")
        return found
    found = metric(entries, tree, options)
    if not isinstance(found, DataFrame):
        raise QueryError("the query is a number")
    found = found if options.zeros else found.where("value <> 0")
    return found.orderBy(canonical(F.col("labels")), "bucket_ns") if options.ordered else found


def instant(entries: DataFrame, text: str, at_ns: int, lookback_ns: int = 300 * 10**9) -> DataFrame:
    """(labels, value): each series' last value in the ``lookback_ns`` up to ``at_ns``."""
    found = query(entries, text, Options(from_ns=at_ns - lookback_ns, to_ns=at_ns))
    return found.groupBy("labels").agg(F.max_by("value", "bucket_ns").alias("value"))


def _bounded(entries: DataFrame | Timed, options: Options, offset: int = 0) -> DataFrame:
    if isinstance(entries, Timed):
        low, high = (None if x is None else x - offset for x in (options.from_ns, options.to_ns))
        entries = entries.between(low, high)
    if options.from_ns is not None:
        entries = entries.where(F.col("timestamp_ns") >= options.from_ns - offset)
    if options.to_ns is not None:
        entries = entries.where(F.col("timestamp_ns") < options.to_ns - offset)
    return entries


def selected(entries: DataFrame | Timed, tree: Q.Selection, options: Options, offset: int = 0, labels: tuple[str, ...] | None = None) -> DataFrame:
    """Entries of the streams that match, through the pipeline's stages in order. ``labels`` names those that are wanted
    of the result, if not all are; JSON is then only read for them."""
    df = _bounded(entries, options, offset)
    for m in tree.matchers:
        test = L.matched(F.col("labels"), m.name, m.op, m.value)
        if test is not None:
            df = df.where(test)
    for k, stage in enumerate(tree.stages):
        needed = None if labels is None else _needed(tree.stages[k + 1 :], labels)
        if isinstance(stage, Q.Stage) and stage.kind == "json" and not stage.args and needed is not None:
            df = df.withColumn("labels", L.updated(F.col("labels"), L.json_some(F.col("string"), needed))) if needed else df
        else:
            df = _staged(df, stage)
    return df


def _needed(stages: tuple, labels: tuple[str, ...]) -> tuple[str, ...] | None:
    """The labels that these stages and the result read; None unless that is certain, and the names are plain enough."""
    names = set(labels)
    for stage in stages:
        if isinstance(stage, Q.LineFilter):
            continue
        if stage.kind == "filter":
            names |= _tested(stage.args[0])
        elif stage.kind == "unwrap" and stage.args[0] != "_entry":
            names.add(stage.args[0])
        elif stage.kind != "unwrap":
            return None
    return None if any(n.startswith("__") for n in names) else tuple(sorted(names))


def _tested(tree: object) -> set[str]:
    return _tested(tree.left) | _tested(tree.right) if isinstance(tree, Q.Both) else {tree.name}


def _test(labels: Column, tree: object) -> Column:
    if isinstance(tree, Q.Both):
        a, b = _test(labels, tree.left), _test(labels, tree.right)
        return a & b if tree.op == "and" else a | b
    return L.label_test(labels, tree.name, tree.op, tree.value)


def _staged(df: DataFrame, stage: object) -> DataFrame:
    labels, line = F.col("labels"), F.col("string")
    if isinstance(stage, Q.LineFilter):
        return df.where(L.line_test(line, stage.op, stage.tree))
    kind, args = stage.kind, stage.args
    if kind == "filter":
        return df.where(_test(labels, args[0]))
    if kind == "json":
        return df.withColumn("labels", L.updated(labels, L.json_labels_at(line, args) if args else L.json_labels(line)))
    if kind == "logfmt":
        return df.withColumn("labels", L.updated(labels, L.logfmt_labels(line, args)))
    if kind == "regexp":
        return df.withColumn("labels", L.updated(labels, L.regexp_labels(line, args[0])))
    if kind == "drop":
        return df.withColumn("labels", L.dropped(labels, args))
    if kind == "keep":
        return df.withColumn("labels", L.kept(labels, args))
    if kind == "label_format":
        for name, source, const in args:
            value = F.lit(source) if const else labels[source]
            own = F.create_map(F.lit(name), value)
            df = df.withColumn("labels", L.updated(labels, own) if const else F.when(F.coalesce(value, F.lit("")) != "", L.updated(labels, own)).otherwise(labels))
        return df
    if kind == "line_format":
        stamp = F.date_format(F.timestamp_micros(F.expr("timestamp_ns div 1000")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return df.withColumn("string", compiled(args[0], labels, line, stamp))
    if kind == "unwrap":
        text = line if args[0] == "_entry" else labels[args[0]]
        return df.withColumn("value", L.number(text)).where(F.col("value").isNotNull())
    raise QueryError(f"unknown stage {kind}")


def grouped(labels: Column, grouping: tuple[str, tuple[str, ...]] | None) -> Column:
    """The label set that a grouping leaves; none leaves the empty one."""
    if grouping is None:
        return F.expr("cast(map() as map<string,string>)")
    kind, names = grouping
    if kind == "by":
        if not names:
            return F.expr("cast(map() as map<string,string>)")
        return F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), labels[n])]), lambda _, v: v.isNotNull())
    return F.map_filter(labels, lambda k, _: ~k.isin(*names)) if names else labels


def _aggregate(df: DataFrame, grouping: tuple[str, tuple[str, ...]] | None, keep_all: bool, keys: list[str], out: Column) -> DataFrame:
    """``out`` per label group and ``keys``. A by-group is made of plain columns, so only those labels are read."""
    if keep_all:
        return df.groupBy("labels", *keys).agg(out.alias("value"))
    kind, names = grouping or ("by", ())
    if kind == "without":
        return df.withColumn("labels", grouped(F.col("labels"), grouping)).groupBy("labels", *keys).agg(out.alias("value"))
    own = [F.col("labels")[n].alias(f"__by_{k}") for k, n in enumerate(names)]
    found = df.groupBy(*own, *keys).agg(out.alias("value"))
    pairs = [x for k, n in enumerate(names) for x in (F.lit(n), F.col(f"__by_{k}"))]
    made = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.expr("cast(map() as map<string,string>)")
    return found.select(made.alias("labels"), *keys, "value")


def _range_value(fn: str, unwrapped: bool, seconds: float, param: float | None, approximate: bool = False) -> Column:
    value, moment = F.col("value"), F.struct("timestamp_ns", "string")
    n, size = F.count(F.lit(1)).cast("double"), F.sum(F.octet_length("string")).cast("double")
    if fn == "rate":
        return (F.sum(value) if unwrapped else n) / seconds
    return {
        "count_over_time": n, "bytes_rate": size / seconds, "bytes_over_time": size, "sum_over_time": F.sum(value), "avg_over_time": F.avg(value),
        "max_over_time": F.max(value), "min_over_time": F.min(value), "first_over_time": F.min_by(value, moment), "last_over_time": F.max_by(value, moment),
        "stddev_over_time": F.stddev_pop(value), "stdvar_over_time": F.var_pop(value), "quantile_over_time": F.percentile_approx(value, param or 0.0, 10_000) if approximate else F.percentile(value, F.lit(param or 0.0)),
    }[fn]


def range_agg(entries: DataFrame, tree: Q.RangeAgg, options: Options) -> DataFrame:
    names = tree.grouping[1] if tree.grouping and tree.grouping[0] == "by" else None
    df = selected(entries, tree.inner, options, tree.offset_ns, names)
    if tree.offset_ns:
        df = df.withColumn("timestamp_ns", F.col("timestamp_ns") + tree.offset_ns)
    size = tree.range_ns
    if tree.fn == "absent_over_time":
        return _absent(df, tree, options)
    if options.sliding:
        step = options.step_ns or size
        first = F.expr(f"(timestamp_ns + {step - 1}) div {step}") * step  # the first step at or after the entry
        ends = F.sequence(first, first + F.lit((size - 1) // step * step), F.lit(step))
        df = df.withColumn("bucket_ns", F.explode(ends)).where(F.col("bucket_ns") - F.col("timestamp_ns") < size)
    else:
        df = df.withColumn("bucket_ns", F.expr(f"timestamp_ns div {size} * {size}"))
    unwrapped = any(isinstance(s, Q.Stage) and s.kind == "unwrap" for s in tree.inner.stages)
    value = _range_value(tree.fn, unwrapped, size / 1e9, tree.param, options.approximate)
    return _aggregate(df, tree.grouping, tree.grouping is None, ["bucket_ns"], value)


def _absent(df: DataFrame, tree: Q.RangeAgg, options: Options) -> DataFrame:
    """1 for each bucket of the query's time in which an existing stream has no entry."""
    if options.from_ns is None or options.to_ns is None:
        raise QueryError("absent_over_time needs the query's time bounds")
    size = tree.range_ns
    there = df.select("labels", F.expr(f"timestamp_ns div {size} * {size}").alias("bucket_ns"))
    grid = F.sequence(F.lit(options.from_ns // size * size), F.lit((options.to_ns - 1) // size * size), F.lit(size))
    every = there.groupBy("labels").agg(F.collect_set("bucket_ns").alias("seen")).withColumn("bucket_ns", F.explode(F.array_except(grid, "seen")))
    return every.select("labels", "bucket_ns", F.lit(1.0).alias("value"))


VECTOR = {
    "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "stddev": F.stddev_pop, "stdvar": F.var_pop, "count": lambda c: F.count(c).cast("double"),
}


def _ranked(df: DataFrame, fn: str, k: int, grouping: tuple[str, tuple[str, ...]] | None) -> DataFrame:
    keys = [F.col("bucket_ns")] + ([canonical(grouped(F.col("labels"), grouping))] if grouping else [])
    order = F.desc("value") if fn == "topk" else F.asc("value")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, canonical(F.col("labels"))))
    return df.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def _arithmetic(op: str, a: Column, b: Column) -> Column:
    return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "%": F.when(b != 0, F.try_mod(a, b))}[op]


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def _commutes(tree: Q.VectorAgg) -> bool:
    """Whether grouping before the range function gives the same as grouping after it."""
    inner = tree.inner
    if not isinstance(inner, Q.RangeAgg) or inner.grouping is not None:
        return False
    sums = ("rate", "count_over_time", "bytes_rate", "bytes_over_time", "sum_over_time")
    return tree.fn == "sum" and inner.fn in sums or (tree.fn, inner.fn) in (("max", "max_over_time"), ("min", "min_over_time"))


def metric(entries: DataFrame, tree: object, options: Options) -> DataFrame | float:
    """(labels, bucket_ns, value) of a metric query, or the number it is."""
    if isinstance(tree, Q.Number):
        return tree.value
    if isinstance(tree, Q.Constant):
        spark: SparkSession = entries.sparkSession
        return spark.range(1).select(F.expr("cast(map() as map<string,string>)").alias("labels"), F.lit(options.to_ns or 0).cast("long").alias("bucket_ns"), F.lit(tree.value).alias("value"))
    if isinstance(tree, Q.RangeAgg):
        return range_agg(entries, tree, options)
    if isinstance(tree, Q.VectorAgg):
        if _commutes(tree):  # one aggregation instead of two
            return range_agg(entries, replace(tree.inner, grouping=tree.grouping or ("by", ())), options)
        inner = metric(entries, tree.inner, options)
        if not isinstance(inner, DataFrame):
            raise QueryError(f"{tree.fn} of a number")
        if tree.fn in Q.RANKINGS:
            return _ranked(inner, tree.fn, int(tree.param or 0), tree.grouping)
        return _aggregate(inner, tree.grouping, False, ["bucket_ns"], VECTOR[tree.fn](F.col("value")))
    if isinstance(tree, Q.Binary):
        left, right = metric(entries, tree.left, options), metric(entries, tree.right, options)
        test = tree.op in Q.COMPARISONS
        if isinstance(left, DataFrame) and isinstance(right, DataFrame):
            a = left.withColumn("__k", canonical(F.col("labels")))
            b = right.select(canonical(F.col("labels")).alias("__k"), "bucket_ns", F.col("value").alias("__r"))
            both = a.join(b, ["__k", "bucket_ns"]).drop("__k")
            if test:
                return both.where(_compare(tree.op, F.col("value"), F.col("__r"))).drop("__r")
            return both.withColumn("value", _arithmetic(tree.op, F.col("value"), F.col("__r"))).drop("__r").where(F.col("value").isNotNull())
        if isinstance(left, DataFrame) or isinstance(right, DataFrame):
            df, a, b = (left, F.col("value"), F.lit(right)) if isinstance(left, DataFrame) else (right, F.lit(left), F.col("value"))
            if test:
                return df.where(_compare(tree.op, a, b))
            return df.withColumn("value", _arithmetic(tree.op, a, b)).where(F.col("value").isNotNull())
        plain = {"+": left + right, "-": left - right, "*": left * right, "/": left / right if right else 0.0, "%": left % right if right else 0.0}
        return plain[tree.op]
    raise QueryError("a log query stands where a metric is needed")


def stepped(points: DataFrame, range_ns: int, options: Options) -> DataFrame:
    """Tumbling results on the query's step grid: expanded over the steps a bucket covers, or where steps are longer, the
    first value in each."""
    step, start, end = options.step_ns or range_ns, options.from_ns or 0, options.to_ns or 1 << 62
    if range_ns < step:
        on = points.withColumn("__step", F.expr(f"bucket_ns div {step} * {step}"))
        out = on.groupBy("labels", "__step").agg(F.min_by("value", "bucket_ns").alias("value"))
        return out.select("labels", F.col("__step").alias("bucket_ns"), "value")
    origin = start // range_ns * range_ns
    first = F.greatest(F.expr(f"(bucket_ns - {origin} + {step - 1}) div {step}") * step + origin, F.lit(origin))
    last = F.least(F.col("bucket_ns") + range_ns - 1, F.lit(end))
    steps = F.when(first <= last, F.sequence(first, last, F.lit(step)))
    return points.withColumn("__step", F.explode(steps)).where(F.col("value") != 0).select("labels", F.col("__step").alias("bucket_ns"), "value")


