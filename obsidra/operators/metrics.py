"""The metric query language on points (labels, ts_ms, val), over a grid of steps.

A vector is a DataFrame (labels, ts_ms, val) with a row per series and step; a scalar has labels null-free and empty.
Instant values are put on the grid by a lead over each series and a sequence of the steps that a point is the last for;
mergeable range functions go by cells and blocks (see ``frames``), the others deal each point to the steps whose range
holds it. rate and its kin take the last point up
to five minutes before the range as their start, else the first inside, and don't extrapolate unless asked to.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsidra.functions.labels import matched, updated
from obsidra.operators.frames import sliding
from obsidra.operators.logs import grouped
from obsidra.plans import plugins
from obsidra.plans import promql as Q
from obsidra.plans.lexing import QueryError
from obsidra.plans.model import Timed, canonical

LOOKBACK_MS = 300_000
EMPTY = "cast(map() as map<string,string>)"


@dataclass(frozen=True)
class Grid:
    start: int
    end: int
    step: int
    extrapolate: bool = False
    lookback: int = LOOKBACK_MS
    outer: tuple[int, int] | None = None  # start and end of the whole query

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.start, self.end + 1, self.step).select(F.col("id").alias("ts_ms"))


@dataclass(frozen=True)
class Scalar:
    """A number per step: a Column over ts_ms, or a frame (ts_ms, val)."""

    value: Column | None = None
    frame: DataFrame | None = None


def query_range(points: DataFrame, text: str, start_ms: int, end_ms: int, step_ms: int, extrapolate: bool = False, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """(labels, ts_ms, val) at each step from start to end."""
    if (own := plugins.planned("metric_query", points, text, (start_ms, end_ms, step_ms))) is not None:
        return own
    grid = Grid(start_ms, end_ms, step_ms, extrapolate, lookback_ms, (start_ms, end_ms))
    found = evaluate(points, Q.parse(text), grid)
    return _as_vector(found, points.sparkSession, grid) if isinstance(found, Scalar) else found


def query(points: DataFrame, text: str, at_ms: int) -> DataFrame:
    return query_range(points, text, at_ms, at_ms, 1)


def _as_vector(s: Scalar, spark: SparkSession, grid: Grid) -> DataFrame:
    base = s.frame if s.frame is not None else grid.frame(spark).withColumn("val", s.value.cast("double"))
    return base.select(F.expr(EMPTY).alias("labels"), "ts_ms", "val")


def from_rollup(rolled: DataFrame) -> DataFrame:
    """Points of a rollup (see ``streaming.rollup``): the last value of each step at its time, and the step's count, sum,
    least and greatest, from which functions over time are made. A query's step and ranges should be whole rollup steps."""
    return rolled.select(
        "labels", F.expr("last_ts div 1000000").alias("ts_ms"), F.col("last").alias("val"), F.col("sum").alias("roll_sum"), F.col("count").alias("roll_count"),
        F.col("min").alias("roll_min"), F.col("max").alias("roll_max"),
    )


def suits_rollup(text: str, start_ms: int, step_ms: int, rollup_ms: int = 15_000) -> bool:
    """Whether a query can be answered from the rollup: whole steps, ranges and offsets, and only functions that it has."""

    def fits(node: object) -> bool:
        if isinstance(node, Q.Call):
            if node.fn in RANGE_FUNCTIONS + ("quantile_over_time", "predict_linear") and node.fn not in ROLLED:
                return False
            return all(fits(a) for a in node.args)
        if isinstance(node, Q.Selector | Q.Subquery):
            whole = (node.range_ms or 0) % rollup_ms == 0 and node.offset_ms % rollup_ms == 0
            return whole and (isinstance(node, Q.Selector) or fits(node.inner))
        return all(fits(x) for name in ("left", "right", "inner", "param") if (x := getattr(node, name, None)) is not None)

    return start_ms % rollup_ms == 0 and (step_ms % rollup_ms == 0) and fits(Q.parse(text))


def query_any(points: DataFrame | Timed, rolled: DataFrame | None, text: str, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
    """query_range() from the rollup where that suits, else from the points."""
    use = rolled is not None and suits_rollup(text, start_ms, step_ms)
    return query_range(from_rollup(rolled) if use else points, text, start_ms, end_ms, step_ms)


def thinned(points: DataFrame, step_ms: int, range_ms: int) -> DataFrame:
    """Only the points that ranges ending at whole steps can hold, where steps are longer than ranges."""
    if step_ms <= range_ms:
        return points
    return points.where((F.pmod("ts_ms", F.lit(step_ms)) == 0) | (F.pmod("ts_ms", F.lit(step_ms)) > step_ms - range_ms))


def _select(points: DataFrame | Timed, sel: Q.Selector, low: int, high: int) -> DataFrame:
    if isinstance(points, Timed):
        points = points.between(low * 10**6, (high + 1) * 10**6)
    df = points.where((F.col("ts_ms") > low) & (F.col("ts_ms") <= high))
    for m in sel.matchers:
        test = matched(F.col("labels"), m.name, m.op, m.value, anchored=True, absent_matches=True)
        if test is not None:
            df = df.where(test)
    return df


def _shift(node: Q.Selector | Q.Subquery, grid: Grid) -> Grid:
    """The steps that are really read: moved by the offset, or all at one time."""
    if node.at_ms is not None:
        at = _moment(node, grid) - node.offset_ms
        return Grid(at, at, 1, grid.extrapolate, grid.lookback, grid.outer)
    return Grid(grid.start - node.offset_ms, grid.end - node.offset_ms, grid.step, grid.extrapolate, grid.lookback, grid.outer)


def _moment(node: Q.Selector | Q.Subquery, grid: Grid) -> int:
    low, high = grid.outer or (grid.start, grid.end)
    return {"start": low, "end": high}.get(node.at_ms, node.at_ms)


def _unshift(df: DataFrame, node: Q.Selector | Q.Subquery, grid: Grid) -> DataFrame:
    if node.at_ms is not None:
        return df.drop("ts_ms").withColumn("ts_ms", F.explode(F.sequence(F.lit(grid.start), F.lit(grid.end), F.lit(grid.step)))).select("labels", "ts_ms", "val")
    return df.withColumn("ts_ms", F.col("ts_ms") + node.offset_ms) if node.offset_ms else df


def _step_at_or_after(ts: Column, grid: Grid) -> Column:
    return F.greatest(F.lit(0), F.ceil((ts - grid.start) / F.lit(grid.step))) * grid.step + grid.start


def instant(points: DataFrame, sel: Q.Selector, grid: Grid) -> DataFrame:
    """The last value of each series in (t - lookback, t] at each step t."""
    on = _shift(sel, grid)
    df = _select(points, sel, on.start - on.lookback, on.end)
    after = F.lead("ts_ms").over(Window.partitionBy(F.xxhash64(canonical(F.col("labels")))).orderBy("ts_ms"))
    first = _step_at_or_after(F.col("ts_ms"), on)
    last = F.least(F.coalesce(F.col("after"), F.lit(1 << 62)), F.col("ts_ms") + on.lookback) - 1
    df = df.withColumn("after", after).withColumns({"first": first, "last": F.least(last, F.lit(on.end))}).where("first <= last")
    df = df.withColumn("at", F.explode(F.sequence("first", "last", F.lit(on.step))))
    return _unshift(df.select("labels", F.col("at").alias("ts_ms"), "val"), sel, grid)


def _inside(points: DataFrame, node: Q.Selector | Q.Subquery, grid: Grid, before_ms: int = 0) -> tuple[DataFrame, Grid]:
    """Points that some step's range (t - range, t] may hold, each with its predecessor in the series."""
    on = _shift(node, grid)
    if isinstance(node, Q.Subquery):
        step = node.step_ms or 60_000
        low = -(-(on.start - node.range_ms - before_ms + 1) // step) * step
        df = _vector(points, node.inner, Grid(low, on.end, step, grid.extrapolate, grid.lookback, grid.outer or (grid.start, grid.end)))
    else:
        df = _select(points, node, on.start - node.range_ms - before_ms, on.end)
    df = df.withColumn("series", F.xxhash64(canonical(F.col("labels"))))
    if before_ms:
        order = Window.partitionBy("series").orderBy("ts_ms")
        df = df.withColumns({"prev": F.lag("val").over(order), "prev_ts": F.lag("ts_ms").over(order)})
    return df, on


def _dealt(df: DataFrame, node: Q.Selector | Q.Subquery, on: Grid) -> DataFrame:
    """Points with each step t (``at``) whose range holds them."""
    first = _step_at_or_after(F.col("ts_ms"), on)
    df = df.withColumns({"first": first, "last": F.least(F.col("ts_ms") + node.range_ms - 1, F.lit(on.end))}).where("first <= last")
    return df.withColumn("at", F.explode(F.sequence("first", "last", F.lit(on.step))))


def _bare(labels: Column) -> Column:
    return F.map_filter(labels, lambda k, _: k != "__name__")


def _mergeable(fn: str, rolled: bool) -> tuple[dict, Column] | None:
    """The parts (see ``frames``) of a function over time, and its value from them. Rolled-up points bring their own."""
    val, moment = F.col("val"), F.struct("ts_ms", "val")
    own = lambda name, plain: F.col(name) if rolled else plain
    total, n = (F.sum(own("roll_sum", val)), F.sum), (F.sum(own("roll_count", F.when(val.isNotNull(), 1).otherwise(0))), F.sum)
    return {
        "sum_over_time": ({"s": total}, F.col("s")), "count_over_time": ({"n": n}, F.col("n").cast("double")), "avg_over_time": ({"s": total, "n": n}, F.col("s") / F.col("n")),
        "min_over_time": ({"v": (F.min(own("roll_min", val)), F.min)}, F.col("v")), "max_over_time": ({"v": (F.max(own("roll_max", val)), F.max)}, F.col("v")),
        "last_over_time": ({"m": (F.max(moment), F.max)}, F.col("m.val")), "first_over_time": ({"m": (F.min(moment), F.min)}, F.col("m.val")), "present_over_time": ({"n": n}, F.lit(1.0)),
    }.get(fn)


def _counted(df: DataFrame, fn: str, node: Q.Selector | Q.Subquery, grid: Grid, on: Grid) -> DataFrame:
    """rate and its kin. What was lost in resets is summed over all points but the first of each window, whose
    predecessor lies before it."""
    val = F.col("val")
    fell, moved = F.coalesce(F.col("prev") > val, F.lit(False)), ~F.coalesce(F.col("prev").eqNullSafe(val), F.lit(False)) & F.col("prev").isNotNull()
    df = df.withColumns({"fell": F.when(fell, F.col("prev")).otherwise(0.0), "reset": fell.cast("long"), "moved": moved.cast("long")})
    point = F.struct("ts_ms", "val", "prev", "prev_ts", "fell", "reset", "moved")
    parts = {"first": (F.min(point), F.min), "last": (F.max(point), F.max), "n": (F.count(val), F.sum)}
    parts |= {name: (F.sum(name), F.sum) for name in ("fell", "reset", "moved")}
    out = sliding(df, parts, start=on.start, end=on.end, step=on.step, size=node.range_ms)
    first, last = F.col("first"), F.col("last")
    if fn in ("resets", "changes"):
        name = "reset" if fn == "resets" else "moved"
        return out.select("labels", "at", (F.col(name) - first[name]).cast("double").alias("val"))
    if fn in ("irate", "idelta"):
        rise = last["val"] - last["prev"]
        value = rise if fn == "idelta" else F.when(rise < 0, last["val"]).otherwise(rise) / ((last["ts_ms"] - last["prev_ts"]) / 1000)
        return out.where("n >= 2").select("labels", "at", value.alias("val"))
    early = F.coalesce(first["prev_ts"] > F.col("at") - node.range_ms - LOOKBACK_MS, F.lit(False)) & F.lit(not grid.extrapolate)
    lost = F.lit(0.0) if fn == "delta" else F.col("fell") - first["fell"] + F.when(early & (first["prev"] > first["val"]), first["prev"]).otherwise(0.0)
    value = last["val"] - F.when(early, first["prev"]).otherwise(first["val"]) + lost
    if grid.extrapolate:
        value = value * _stretch(node.range_ms, fn, value)
    value = value / (node.range_ms / 1000) if fn == "rate" else value
    return out.where(early | (F.col("n") >= 2)).select("labels", "at", value.alias("val"))


def range_function(points: DataFrame, fn: str, node: Q.Selector | Q.Subquery, grid: Grid, param: float | None = None, approximate: bool = False) -> DataFrame:
    val, ts = F.col("val"), F.col("ts_ms")
    counters = ("rate", "increase", "delta", "resets", "changes", "irate", "idelta")
    df, on = _inside(points, node, grid, LOOKBACK_MS if fn in counters else 0)
    if fn in counters:
        out = _counted(df, fn, node, grid, on)
    elif (found := _mergeable(fn, "roll_sum" in df.columns)) is not None:
        parts, value = found
        out = sliding(df, parts, start=on.start, end=on.end, step=on.step, size=node.range_ms).select("labels", "at", value.alias("val"))
    elif fn in ("deriv", "predict_linear"):
        x = (ts - F.col("at")) / 1000
        slope = F.regr_slope(val, x)
        value = slope if fn == "deriv" else F.regr_intercept(val, x) + slope * (param or 0.0)
        out = _dealt(df, node, on).groupBy("labels", "at").agg(value.alias("val"), F.count(val).alias("n")).where("n >= 2").select("labels", "at", "val")
    else:
        q = min(max(param or 0.0, 0.0), 1.0)
        middle = F.percentile_approx(val, q, 10_000) if approximate else F.percentile(val, F.lit(q))
        values = {"stddev_over_time": F.stddev_pop(val), "stdvar_over_time": F.var_pop(val), "quantile_over_time": middle, "mad_over_time": F.percentile(val, F.lit(0.5))}
        if fn not in values:
            raise QueryError(f"unknown range function {fn}")
        df = _dealt(df, node, on)
        if fn == "mad_over_time":
            out = df.groupBy("labels", "at").agg(F.collect_list("val").alias("all"), values[fn].alias("mid"))
            out = out.withColumn("d", F.array_sort(F.transform("all", lambda x: F.abs(x - F.col("mid")))))
            k = F.size("d")
            out = out.select("labels", "at", ((F.element_at("d", ((k + 1) / 2).cast("int")) + F.element_at("d", (k / 2 + 1).cast("int"))) / 2).alias("val"))
        else:
            out = df.groupBy("labels", "at").agg(values[fn].alias("val"))
    keep_name = fn in ("last_over_time", "first_over_time")
    out = out.select((F.col("labels") if keep_name else _bare(F.col("labels"))).alias("labels"), F.col("at").alias("ts_ms"), "val")
    return _unshift(out, node, grid)


def _stretch(range_ms: int, fn: str, rise: Column) -> Column:
    """How far the points' own span is carried on towards the ends of the range (the public definition)."""
    first, last = F.col("first"), F.col("last")
    span = (last["ts_ms"] - first["ts_ms"]) / 1000
    gap = span / (F.col("n") - 1)
    head = (first["ts_ms"] - (F.col("at") - range_ms)) / 1000
    tail = (F.col("at") - last["ts_ms"]) / 1000
    if fn != "delta":
        zero = F.when((rise > 0) & (first["val"] >= 0), span * first["val"] / rise)
        head = F.least(head, F.coalesce(zero, head))
    near = lambda x: F.when(x < gap * 1.1, x).otherwise(gap / 2)
    return (span + near(head) + near(tail)) / span


RANGE_FUNCTIONS = (
    "rate", "increase", "delta", "irate", "idelta", "resets", "changes", "deriv", "sum_over_time", "count_over_time", "avg_over_time", "min_over_time",
    "max_over_time", "last_over_time", "first_over_time", "present_over_time", "stddev_over_time", "stdvar_over_time", "mad_over_time",
)

ROLLED = ("rate", "increase", "delta", "irate", "idelta", "resets", "changes", "sum_over_time", "count_over_time", "avg_over_time", "min_over_time", "max_over_time", "last_over_time", "present_over_time")

MATH = {
    "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "exp": F.exp, "sqrt": F.sqrt,
    "ln": lambda x: F.when(x > 0, F.log(x)).when(x == 0, float("-inf")).otherwise(float("nan")), "log2": lambda x: F.when(x > 0, F.log2(x)).when(x == 0, float("-inf")).otherwise(float("nan")),
    "log10": lambda x: F.when(x > 0, F.log10(x)).when(x == 0, float("-inf")).otherwise(float("nan")), "sgn": F.signum, "deg": F.degrees, "rad": F.radians,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
}
_T = lambda x: F.timestamp_seconds(x)
DATES = {
    "minute": lambda x: F.minute(_T(x)), "hour": lambda x: F.hour(_T(x)), "day_of_week": lambda x: F.dayofweek(_T(x)) - 1, "day_of_month": lambda x: F.dayofmonth(_T(x)),
    "day_of_year": lambda x: F.dayofyear(_T(x)), "days_in_month": lambda x: F.dayofmonth(F.last_day(_T(x))), "month": lambda x: F.month(_T(x)), "year": lambda x: F.year(_T(x)),
}


def _number(node: object) -> float:
    if isinstance(node, Q.Number):
        return node.value
    if isinstance(node, Q.Negative):
        return -_number(node.inner)
    raise QueryError("a constant number is needed here")


def _text(node: object) -> str:
    if not isinstance(node, Q.Text):
        raise QueryError("a string is needed here")
    return node.value


def _vector(points: DataFrame, node: object, grid: Grid) -> DataFrame:
    found = evaluate(points, node, grid)
    return _as_vector(found, points.sparkSession, grid) if isinstance(found, Scalar) else found


def evaluate(points: DataFrame, node: object, grid: Grid) -> DataFrame | Scalar:
    if isinstance(node, Q.Number):
        return Scalar(F.lit(node.value))
    if isinstance(node, Q.Negative):
        found = evaluate(points, node.inner, grid)
        if isinstance(found, Scalar):
            return Scalar(-found.value) if found.frame is None else Scalar(frame=found.frame.withColumn("val", -F.col("val")))
        return found.select(_bare(F.col("labels")).alias("labels"), "ts_ms", (-F.col("val")).alias("val"))
    if isinstance(node, Q.Selector):
        if node.range_ms is not None:
            raise QueryError("a range stands where an instant vector is needed")
        return instant(points, node, grid)
    if isinstance(node, Q.Aggregation):
        return _aggregate(points, node, grid)
    if isinstance(node, Q.Binary):
        return _binary(points, node, grid)
    if isinstance(node, Q.Call):
        return _call(points, node, grid)
    raise QueryError(f"can't evaluate {node}")


def _aggregate(points: DataFrame, node: Q.Aggregation, grid: Grid) -> DataFrame:
    df, val = _vector(points, node.inner, grid), F.col("val")
    kind, names = node.grouping or ("by", ())
    group = grouped(F.col("labels"), (kind, (*names, "__name__") if kind == "without" else names))
    if node.fn in ("topk", "bottomk"):
        order = F.desc("val") if node.fn == "topk" else F.asc("val")
        place = F.row_number().over(Window.partitionBy(canonical(group), "ts_ms").orderBy(order, canonical(F.col("labels"))))
        return df.withColumn("p", place).where(F.col("p") <= int(_number(node.param))).drop("p")
    if node.fn == "count_values":
        shown = F.regexp_replace(val.cast("string"), r"\.0$", "")
        df = df.withColumn("labels", updated(group, F.create_map(F.lit(_text(node.param)), shown)))
        return df.groupBy("labels", "ts_ms").agg(F.count(F.lit(1)).cast("double").alias("val"))
    value = {
        "sum": F.sum(val), "avg": F.avg(val), "min": F.min(val), "max": F.max(val), "count": F.count(val).cast("double"), "group": F.lit(1.0),
        "stddev": F.stddev_pop(val), "stdvar": F.var_pop(val), "quantile": F.percentile(val, F.lit(min(max(_number(node.param), 0.0), 1.0))) if node.fn == "quantile" else None,
    }[node.fn]
    return df.withColumn("labels", group).groupBy("labels", "ts_ms").agg(value.alias("val"))


def _arithmetic(op: str, a: Column, b: Column) -> Column:
    zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return {"+": a + b, "-": a - b, "*": a * b, "/": F.when(b == 0, zero).otherwise(F.try_divide(a, b)), "%": F.when(b == 0, float("nan")).otherwise(F.try_mod(a, b)), "^": F.pow(a, b), "atan2": F.atan2(a, b)}[op]


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def _result(op: str, a: Column, b: Column, returns_bool: bool) -> Column:
    if op not in Q.LEVELS[2]:
        return _arithmetic(op, a, b)
    test = _compare(op, a, b)
    return test.cast("double") if returns_bool else F.when(test, a)


def _key(labels: Column, m: Q.Matching) -> Column:
    own = F.map_filter(labels, lambda k, _: k.isin(*m.names)) if m.on and m.names else F.expr(EMPTY) if m.on else F.map_filter(labels, lambda k, _: ~k.isin("__name__", *m.names))
    return canonical(own)


def _binary(points: DataFrame, node: Q.Binary, grid: Grid) -> DataFrame | Scalar:
    left, right = evaluate(points, node.left, grid), evaluate(points, node.right, grid)
    op, m = node.op, node.matching
    drops = op not in Q.LEVELS[2] or node.returns_bool
    if isinstance(left, Scalar) and isinstance(right, Scalar):
        if left.frame is None and right.frame is None:
            return Scalar(_result(op, left.value, right.value, True))
        a, b = (_as_vector(s, points.sparkSession, grid).drop("labels") for s in (left, right))
        return Scalar(frame=a.join(b.withColumnRenamed("val", "r"), "ts_ms").select("ts_ms", _result(op, F.col("val"), F.col("r"), True).alias("val")))
    if isinstance(left, Scalar) or isinstance(right, Scalar):
        vector, scalar = (left, right) if isinstance(right, Scalar) else (right, left)
        if scalar.frame is not None:
            vector = vector.join(scalar.frame.withColumnRenamed("val", "s"), "ts_ms")
        s = F.col("s") if scalar.frame is not None else scalar.value
        a, b = (F.col("val"), s) if isinstance(right, Scalar) else (s, F.col("val"))
        value = _result(op, a, b, node.returns_bool)
        if op in Q.LEVELS[2] and not node.returns_bool:
            return vector.where(_compare(op, a, b)).select("labels", "ts_ms", "val")
        labels = _bare(F.col("labels")) if drops else F.col("labels")
        return vector.select(labels.alias("labels"), "ts_ms", value.alias("val")).where(F.col("val").isNotNull())
    a = left.withColumn("k", _key(F.col("labels"), m))
    b = right.withColumn("k", _key(F.col("labels"), m))
    if op in ("and", "unless"):
        how = "left_semi" if op == "and" else "left_anti"
        return a.join(b.select("k", "ts_ms"), ["k", "ts_ms"], how).select("labels", "ts_ms", "val")
    if op == "or":
        more = b.join(a.select("k", "ts_ms"), ["k", "ts_ms"], "left_anti")
        return a.select("labels", "ts_ms", "val").union(more.select("labels", "ts_ms", "val"))
    if m.group == "group_right":
        a, b = b, a
    one = b.select("k", "ts_ms", F.col("labels").alias("one_labels"), F.col("val").alias("one_val"))
    # One-to-one and many-to-one need a single partner on the one side: several are an error, as the language says.
    counted = one.withColumn("twins", F.count(F.lit(1)).over(Window.partitionBy("k", "ts_ms")))
    one = counted.where(F.when(F.col("twins") > 1, F.raise_error(F.lit("several series match on the one side"))).otherwise(F.lit(True))).drop("twins")
    joined = a.join(one, ["k", "ts_ms"])
    x, y = (F.col("val"), F.col("one_val")) if m.group != "group_right" else (F.col("one_val"), F.col("val"))
    value = _result(op, x, y, node.returns_bool)
    labels = F.col("labels")
    if m.group is None:
        labels = F.map_filter(labels, lambda k, _: k.isin(*m.names)) if m.on and m.names else F.map_filter(labels, lambda k, _: ~k.isin(*m.names)) if m.names else F.expr(EMPTY) if m.on else labels
    elif m.include:
        own = F.map_filter(F.col("one_labels"), lambda k, _: k.isin(*m.include))
        labels = updated(F.map_filter(labels, lambda k, _: ~k.isin(*m.include)), own)
    return joined.select((_bare(labels) if drops else labels).alias("labels"), "ts_ms", value.alias("val")).where(F.col("val").isNotNull())


def _call(points: DataFrame, node: Q.Call, grid: Grid) -> DataFrame | Scalar:
    fn, args, val = node.fn, node.args, F.col("val")
    spark = points.sparkSession

    def mapped(df: DataFrame, value: Column) -> DataFrame:
        return df.select(_bare(F.col("labels")).alias("labels"), "ts_ms", value.cast("double").alias("val"))

    if fn in RANGE_FUNCTIONS:
        return range_function(points, fn, args[0], grid)
    if fn == "quantile_over_time":
        return range_function(points, fn, args[1], grid, _number(args[0]))
    if fn == "predict_linear":
        return range_function(points, fn, args[0], grid, _number(args[1]))
    if fn == "absent_over_time":
        return _absent(range_function(points, "present_over_time", args[0], grid), args[0], spark, grid)
    if fn == "absent":
        return _absent(_vector(points, args[0], grid), args[0], spark, grid)
    if fn == "time":
        return Scalar(F.col("ts_ms") / 1000)
    if fn == "pi":
        return Scalar(F.lit(math.pi))
    if fn == "vector":
        return _vector(points, args[0], grid)
    if fn == "scalar":
        one = _vector(points, args[0], grid).groupBy("ts_ms").agg(F.count(F.lit(1)).alias("n"), F.first("val").alias("v"))
        frame = grid.frame(spark).join(one, "ts_ms", "left")
        return Scalar(frame=frame.select("ts_ms", F.when(F.col("n") == 1, F.col("v")).otherwise(float("nan")).alias("val")))
    if fn == "timestamp" and isinstance(args[0], Q.Selector):
        stamped = replace(points, shape=lambda df: points.shape(df).withColumn("val", F.col("ts_ms") / 1000)) if isinstance(points, Timed) else points.withColumn("val", F.col("ts_ms") / 1000)
        return mapped(instant(stamped, args[0], grid), val)
    if fn in DATES:
        df = _vector(points, args[0], grid) if args else _as_vector(Scalar(F.col("ts_ms") / 1000), spark, grid)
        return mapped(df, DATES[fn](val))
    df = _vector(points, args[1 if fn == "histogram_quantile" else 0], grid)
    if fn in MATH:
        return mapped(df, MATH[fn](val))
    if fn == "timestamp":
        return mapped(df, F.col("ts_ms") / 1000)
    if fn == "round":
        to = _number(args[1]) if len(args) > 1 else 1.0
        return mapped(df, F.floor(val / to + 0.5) * to)
    if fn == "clamp":
        return mapped(df, F.greatest(F.lit(_number(args[1])), F.least(F.lit(_number(args[2])), val)))
    if fn == "clamp_min":
        return mapped(df, F.greatest(F.lit(_number(args[1])), val))
    if fn == "clamp_max":
        return mapped(df, F.least(F.lit(_number(args[1])), val))
    if fn in ("sort", "sort_desc"):
        return df.orderBy("ts_ms", F.asc("val") if fn == "sort" else F.desc("val"))
    if fn in ("sort_by_label", "sort_by_label_desc"):
        keys = [F.col("labels")[_text(a)] for a in args[1:]]
        return df.orderBy("ts_ms", *[k.desc() if fn.endswith("desc") else k.asc() for k in keys])
    if fn == "label_replace":
        to, new, source, pattern = (_text(a) for a in args[1:])
        have = F.coalesce(F.col("labels")[source], F.lit(""))
        full = f"^(?:{pattern})$"
        made = F.regexp_replace(have, full, new)
        changed = F.map_filter(updated(F.col("labels"), F.create_map(F.lit(to), made)), lambda k, v: (k != to) | (v != ""))
        return df.withColumn("labels", F.when(have.rlike(full), changed).otherwise(F.col("labels")))
    if fn == "label_join":
        to, glue, *names = (_text(a) for a in args[1:])
        made = F.concat_ws(glue, *[F.coalesce(F.col("labels")[n], F.lit("")) for n in names])
        return df.withColumn("labels", updated(F.col("labels"), F.create_map(F.lit(to), made)))
    if fn == "histogram_quantile":
        return _histogram_quantile(df, _number(args[0]))
    raise QueryError(f"unknown function {fn}")


def _absent(df: DataFrame, node: object, spark: SparkSession, grid: Grid) -> DataFrame:
    known = [(m.name, m.value) for m in getattr(node, "matchers", ()) if m.op == "=" and m.name != "__name__"]
    labels = F.create_map(*[F.lit(x) for pair in known for x in pair]) if known else F.expr(EMPTY)
    return grid.frame(spark).join(df.select("ts_ms").distinct(), "ts_ms", "left_anti").select(labels.alias("labels"), "ts_ms", F.lit(1.0).alias("val"))


def _histogram_quantile(df: DataFrame, q: float) -> DataFrame:
    """Linear within the bucket that the rank falls in; buckets are cumulative and named by their label ``le``."""
    bound = F.when(F.col("labels")["le"].isin("+Inf", "Inf"), float("inf")).otherwise(F.col("labels")["le"].try_cast("double"))
    rest = F.map_filter("labels", lambda k, _: ~k.isin("le", "__name__"))
    rows = df.withColumns({"le": bound}).withColumn("labels", rest).where(F.col("le").isNotNull())
    series = rows.groupBy("labels", "ts_ms").agg(F.sort_array(F.collect_list(F.struct("le", "val"))).alias("b"))
    rank = q * F.element_at("b", -1)["val"]
    k = F.size(F.filter("b", lambda x: x["val"] < rank)) + 1
    at = F.try_element_at("b", k)
    below = F.when(k > 1, F.try_element_at("b", k - 1))
    low, low_n = F.coalesce(below["le"], F.lit(0.0)), F.coalesce(below["val"], F.lit(0.0))
    value = F.when(at["le"] == float("inf"), below["le"]).otherwise(low + (at["le"] - low) * F.try_divide(rank - low_n, at["val"] - low_n))
    edge = F.lit(float("-inf")) if q < 0 else F.lit(float("inf")) if q > 1 else None
    return series.select("labels", "ts_ms", (edge if edge is not None else F.when(F.element_at("b", -1)["le"] == float("inf"), value)).alias("val")).where(F.col("val").isNotNull())
