"""The trace query language on spans; see plans.model for their columns.

Conditions read span columns and the attribute map, so they stay in the scan; a negative test needs the attribute to be
there. Spansets join at trace level, or at span level with ``same_span``; structural operators follow parent_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsidra.functions.labels import java_regex, number
from obsidra.plans import plugins
from obsidra.plans import traceql as Q
from obsidra.plans.lexing import QueryError
from obsidra.plans.model import Timed
from obsidra.plans.shared import stored

SPANS_A_TRACE = 100
SPANS_BY_ID = 2000
KEY = ["trace_id", "span_id"]


def bare(name: str) -> str:
    for scope in ("span.", "resource.", "."):
        if name.startswith(scope):
            return name[len(scope) :]
    return name.removeprefix("span:").removeprefix("trace:")


def attribute(name: str) -> Column:
    own = bare(name)
    intrinsic = {"name": "name", "duration": "duration_ns", "service.name": "service_name", "rootServiceName": "root_service", "rootName": "root_name", "traceDuration": "trace_duration_ns"}
    if own in intrinsic:
        return F.col(intrinsic[own])
    return F.col("attrs")[own]


def _test(x: Column, op: str, value: object) -> Column:
    return {"=": x == value, "!=": x != value, ">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value}[op]


def condition(tree: object) -> Column:
    if tree is None or isinstance(tree, bool):
        return F.lit(tree is not False)
    if isinstance(tree, Q.Both):
        a, b = condition(tree.left), condition(tree.right)
        return a & b if tree.op == "and" else a | b
    if isinstance(tree, Q.Not):
        return ~condition(tree.inner)
    if isinstance(tree, Q.Comparison):
        if tree.op in ("=~", "!~"):
            raise QueryError("a pattern can't be compared with a sum")
        plain = isinstance(tree.left, Q.Attr | Q.Value) and isinstance(tree.right, Q.Attr | Q.Value) and tree.op in ("=", "!=")
        a, b = ((_shown if plain else _figure)(x) for x in (tree.left, tree.right))
        return F.coalesce(_test(a, tree.op, b), F.lit(False))
    name, have = bare(tree.name), attribute(tree.name)
    if name.startswith("nestedSet"):
        return F.col("parent_id") == "" if name == "nestedSetParent" and tree.op == "<" else F.lit(True)
    if tree.value == "nil":
        return have.isNotNull() if tree.op == "!=" else have.isNull()
    if tree.kind in ("string", "word"):
        if tree.op in ("=~", "!~"):
            found = have.rlike(java_regex(tree.value))
            test = ~found if tree.op == "!~" else found
        else:
            test = _test(have, tree.op, tree.value)
    else:
        x = have.cast("double") if name in ("duration", "traceDuration") else number(have)
        test = _test(x, tree.op, float(tree.value))
    return F.coalesce(test, F.lit(False))


def _shown(x: object) -> Column:
    return attribute(x.name).cast("string") if isinstance(x, Q.Attr) else F.lit(str(x.value))


def _figure(x: object) -> Column:
    """A sum's value as a number; durations are in nanoseconds."""
    if isinstance(x, Q.Attr):
        return attribute(x.name).cast("double") if bare(x.name) in ("duration", "traceDuration") else number(attribute(x.name))
    if isinstance(x, Q.Value):
        if x.kind == "string":
            raise QueryError("a sum of texts")
        return F.lit(float(x.value))
    a, b = _figure(x.left), _figure(x.right)
    return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "%": F.try_mod(a, b), "^": F.pow(a, b)}[x.op]


def _with_roots(spans: DataFrame) -> DataFrame:
    trace = Window.partitionBy("trace_id")
    first = F.struct("timestamp_ns", "span_id")
    return spans.withColumns({
        "root_service": F.min_by("service_name", first).over(trace), "root_name": F.min_by("name", first).over(trace),
        "trace_duration_ns": F.max(F.col("timestamp_ns") + F.col("duration_ns")).over(trace) - F.min("timestamp_ns").over(trace),
    })


def _names(tree: object) -> set[str]:
    if isinstance(tree, Q.Term | Q.Attr):
        return {bare(tree.name)}
    return set().union(*(_names(getattr(tree, x)) for x in ("left", "right", "condition", "spans", "inner") if hasattr(tree, x)), set())


def spansets(spans: DataFrame, tree: object, same_span: bool = False) -> DataFrame:
    """The spans that a spanset expression keeps."""
    if isinstance(tree, Q.Spanset):
        return spans.where(condition(tree.condition))
    if isinstance(tree, Q.Query):
        return _filtered(spansets(spans, tree.spans, same_span), tree.stages, strict=True)
    if isinstance(tree.left, Q.Spanset) and isinstance(tree.right, Q.Spanset) and tree.op in ("||", "&&"):
        a, b = condition(tree.left.condition), condition(tree.right.condition)
        if tree.op == "||" or same_span:
            return spans.where(a | b if tree.op == "||" else a & b)
        some = spans.where(a | b)
        both = some.groupBy("trace_id").agg(F.max(a).alias("a"), F.max(b).alias("b")).where("a AND b").select("trace_id")
        return some.join(both, "trace_id", "left_semi")
    left, right = spansets(spans, tree.left, same_span), spansets(spans, tree.right, same_span)
    if tree.op == "&&" and same_span:
        return left.join(right.select(*KEY), KEY, "left_semi")
    if tree.op in ("||", "&&"):
        keys = left.select(*KEY).union(right.select(*KEY))
        if tree.op == "&&":
            keys = keys.join(_shared_traces(left, right), "trace_id", "left_semi")
        return spans.join(keys, KEY, "left_semi")
    if tree.op.startswith("&"):  # both sides of each relation
        op = tree.op[1:]
        back = {">": "<", "<": ">", ">>": "<<", "<<": ">>", "~": "~"}[op]
        keys = _related(spans, left, right, op, "left_semi").select(*KEY).union(_related(spans, right, left, back, "left_semi").select(*KEY))
        return spans.join(keys, KEY, "left_semi")
    return _related(spans, left, right, tree.op.lstrip("!"), "left_anti" if tree.op.startswith("!") else "left_semi")


def _shared_traces(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("trace_id").distinct().join(right.select("trace_id"), "trace_id", "left_semi")


def _related(spans: DataFrame, left: DataFrame, right: DataFrame, op: str, how: str) -> DataFrame:
    """The spans of ``right`` that stand in the relation ``op`` to one of ``left``, or (anti) to none."""
    if op == ">":
        parents = left.select("trace_id", F.col("span_id").alias("parent_id"))
        return right.join(parents, ["trace_id", "parent_id"], how)
    if op == "<":
        children = left.where("parent_id <> ''").select("trace_id", F.col("parent_id").alias("span_id"))
        return right.join(children, KEY, how)
    if op == "~":
        a = left.where("parent_id <> ''").select("trace_id", "parent_id", F.col("span_id").alias("other"))
        return right.alias("r").join(a.alias("a"), (F.col("r.trace_id") == F.col("a.trace_id")) & (F.col("r.parent_id") == F.col("a.parent_id")) & (F.col("r.span_id") != F.col("a.other")), how)
    if op in (">>", "<<"):
        return right.join(_reached(spans, left, right, op), KEY, how)
    raise QueryError(f"unknown operator {op}")


def _reached(spans: DataFrame, left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """Keys of the spans below (>>) or above (<<) a span of ``left``, in the traces that hold spans of both sides.

    Each span points to an ancestor, at first its parent. A round lets it point to where that one points, so distances
    double, and carries the marks over: a table stays as long as the traces, and depth costs rounds by its logarithm."""
    shared = _shared_traces(left, right)
    marked = left.select(*KEY, F.lit(True).alias("is_left"))
    at = spans.join(shared, "trace_id", "left_semi").select(*KEY, F.nullif("parent_id", F.lit("")).alias("up")).join(marked, KEY, "left").withColumn("hit", F.coalesce("is_left", F.lit(False)))
    start = stored(at.select(*KEY, "up", "hit"), "lineage")
    now = start.where("up IS NOT NULL" if op == ">>" else "true")
    above = start.select("trace_id", F.col("span_id").alias("up"), F.col("hit").alias("up_hit"))
    if op == ">>":  # hit: one of the ancestors looked at so far is of the left side
        now = now.join(above, ["trace_id", "up"], "left").select(*KEY, "up", F.coalesce("up_hit", F.lit(False)).alias("hit"))
        ends = now.select(*KEY, "up", "hit")
        for _ in _rounds(start, lambda: ends.where("up IS NOT NULL AND NOT hit")):
            far = ends.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("hit").alias("far_hit"))
            grown = ends.join(far, ["trace_id", "up"], "left").select(*KEY, F.col("next").alias("up"), (F.col("hit") | F.coalesce("far_hit", F.lit(False))).alias("hit"))
            ends = stored(grown, "lineage")
        return ends.where("hit").select(*KEY)
    # hit: of the left side itself, or with such a span below among those looked at so far.
    for _ in _rounds(start, lambda: now.where("up IS NOT NULL AND hit")):
        raised = now.where("hit AND up IS NOT NULL").select("trace_id", F.col("up").alias("span_id"), F.lit(True).alias("more")).distinct()
        far = now.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"))
        grown = now.join(raised, KEY, "left").join(far, ["trace_id", "up"], "left").select(*KEY, F.col("next").alias("up"), (F.col("hit") | F.coalesce("more", F.lit(False))).alias("hit"))
        now = stored(grown, "lineage")
    hits = now.where("hit").select(*KEY).join(start.select(*KEY, F.col("up").alias("parent")), KEY)
    return hits.where("parent IS NOT NULL").select("trace_id", F.col("parent").alias("span_id")).distinct()


def _rounds(start: DataFrame, left_over: Callable[[], DataFrame]) -> Iterator[int]:
    """Rounds until nothing is left over or, where parents make a cycle, until the reach is beyond the longest trace."""
    longest = 1 << 62
    for k in count():
        if k == 6:
            longest = start.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
        if 1 << k > longest or left_over().limit(1).isEmpty():
            return
        yield k


def _filtered(found: DataFrame, stages: tuple, strict: bool = False) -> DataFrame:
    """``found`` through the stages that drop spans; ``by`` makes those after it count per value, not per trace."""
    by: list[Column] = []
    for stage in stages:
        if isinstance(stage, Q.Having):
            found = _having(found, stage, by)
        elif isinstance(stage, tuple) and stage[0] == "by":
            by = [attribute(n).cast("string") for n in stage[1]]
        elif strict:
            raise QueryError("this stage has to stand at the end")
    return found


def _having(found: DataFrame, stage: Q.Having, by: list[Column]) -> DataFrame:
    x = None if stage.attr is None else F.col("duration_ns").cast("double") if bare(stage.attr) == "duration" else number(attribute(stage.attr))
    value = {"count": lambda: F.count_distinct("span_id"), "avg": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x), "sum": lambda: F.sum(x)}[stage.fn]()
    keys = {f"by_{k}": F.coalesce(c, F.lit("")) for k, c in enumerate(by)}
    marked = found.withColumns(keys) if keys else found
    groups = marked.groupBy("trace_id", *keys).agg(value.alias("v")).where(_test(F.col("v"), stage.op, stage.value)).select("trace_id", *keys)
    return marked.join(groups, ["trace_id", *keys], "left_semi").select(*found.columns)


def _prepared(spans: DataFrame, tree: Q.Query) -> DataFrame:
    by = {bare(n) for s in tree.stages for n in (s.by if isinstance(s, Q.Metric) else s[1] if isinstance(s, tuple) and s[0] in ("by", "select") else ())}
    needs = {"rootServiceName", "rootName", "traceDuration"} & (_names(tree.spans) | by)
    return _with_roots(spans) if needs else spans


def _bounded(spans: DataFrame | Timed, from_ns: int | None, to_ns: int | None) -> DataFrame:
    if isinstance(spans, Timed):
        spans = spans.between(from_ns, to_ns)
    if from_ns is not None:
        spans = spans.where(F.col("timestamp_ns") >= from_ns)
    return spans if to_ns is None else spans.where(F.col("timestamp_ns") < to_ns)


def search(spans: DataFrame, text: str, *, from_ns: int | None = None, to_ns: int | None = None, limit: int = 0, same_span: bool = False, spans_a_trace: int | None = SPANS_A_TRACE) -> DataFrame:
    """A row per trace that matches: trace_id, root_service, root_name, start_ns, duration_ms, and its matched spans,
    newest first (at most ``spans_a_trace`` of them, None for all)."""
    if (own := plugins.planned("trace_query", spans, text, (from_ns, to_ns, limit))) is not None:
        return own
    tree = Q.parse(text)
    inside = _prepared(_bounded(spans, from_ns, to_ns), tree)
    found = _filtered(spansets(inside, tree.spans, same_span), tree.stages)
    for stage in tree.stages:
        if isinstance(stage, tuple) and stage[0] == "select":
            found = found.withColumn("attrs", F.map_filter("attrs", lambda k, _, keep=stage[1]: k.isin(*map(bare, keep))))
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("timestamp_ns"), "span_id"))
    kept = found.withColumn("p", place)
    kept = kept if spans_a_trace is None else kept.where(F.col("p") <= spans_a_trace)
    matched = kept.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("p", "span_id", "name", "service_name", "timestamp_ns", "duration_ns"))).alias("spans"), F.count(F.lit(1)).alias("matched"))
    # Only traces that match are summed up.
    out = summaries(inside.join(matched.select("trace_id"), "trace_id", "left_semi")).join(matched, "trace_id")
    return out.orderBy(F.desc("start_ns"), "trace_id").limit(limit) if limit else out


def summaries(spans: DataFrame) -> DataFrame:
    first = F.struct("timestamp_ns", "span_id")
    end = F.max(F.col("timestamp_ns") + F.col("duration_ns"))
    return spans.groupBy("trace_id").agg(
        F.min_by("service_name", first).alias("root_service"), F.min_by("name", first).alias("root_name"), F.min("timestamp_ns").alias("start_ns"),
        ((end - F.min("timestamp_ns")) / F.lit(10**6)).cast("long").alias("duration_ms"),
    )


def by_id(spans: DataFrame, trace_id: str, from_ns: int | None = None, to_ns: int | None = None, limit: int | None = SPANS_BY_ID) -> DataFrame:
    found = _bounded(spans, from_ns, to_ns).where(F.col("trace_id") == trace_id).orderBy("timestamp_ns", "span_id")
    return found if limit is None else found.limit(limit)


def tags(spans: DataFrame, text: str | None = None) -> DataFrame:
    """Distinct attribute names, of all spans or of those that match."""
    found = spans if text is None else spansets(spans, Q.parse(text).spans)
    return found.select(F.explode(F.map_keys("attrs")).alias("tag")).distinct()


def tag_values(spans: DataFrame, tag: str, text: str | None = None) -> DataFrame:
    found = spans if text is None else spansets(spans, Q.parse(text).spans)
    return found.select(attribute(tag).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()


def tag_search(spans: DataFrame, pairs: dict[str, str], min_ns: int | None = None, max_ns: int | None = None) -> DataFrame:
    """Spans with all the given attribute values; a value that starts with ~ is a pattern."""
    for k, v in pairs.items():
        spans = spans.where(attribute(k).rlike(java_regex(v[1:])) if v.startswith("~") else attribute(k) == v)
    if min_ns is not None:
        spans = spans.where(F.col("duration_ns") >= min_ns)
    return spans if max_ns is None else spans.where(F.col("duration_ns") <= max_ns)


def _power_of_two(d: Column) -> Column:
    """The power of two at or above."""
    return F.when(d <= 0, F.lit(0)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(d)))).cast("long")


def metrics(spans: DataFrame, text: str, from_ns: int, to_ns: int, step_ns: int | None, zero_fill: bool = False, approximate: bool = False) -> DataFrame:
    """Span metrics: the by-columns, ts_ns (the step; left out for an instant query, ``step_ns`` None) and value. A
    histogram has the column ``bucket``: the power of two at or above the duration in ns. Several quantiles make a row each,
    told apart by the column ``p``. ``approximate`` quantiles need no buffer of all values."""
    tree = Q.parse(text)
    stage = next((s for s in tree.stages if isinstance(s, Q.Metric)), None)
    if stage is None:
        raise QueryError("a metrics stage is needed")
    found = _filtered(spansets(_prepared(_bounded(spans, from_ns, to_ns), tree), tree.spans), tree.stages)
    keys = [attribute(n).cast("string").alias(bare(n)) for n in stage.by]
    names = [bare(n) for n in stage.by]
    seconds = (step_ns or to_ns - from_ns) / 1e9
    x = None if stage.attr is None else F.col("duration_ns") / 1e9 if bare(stage.attr) == "duration" else number(attribute(stage.attr))
    n = F.count(F.lit(1)).cast("double")
    if stage.fn == "histogram_over_time":
        keys.append(_power_of_two(F.col("duration_ns")).alias("bucket"))
        names.append("bucket")
    several = stage.fn == "quantile_over_time" and len(stage.params) > 1
    shares = F.array(*map(F.lit, stage.params)) if several else F.lit(stage.params[0] if stage.params else 0.5)
    value = {
        "rate": lambda: n / seconds, "count_over_time": lambda: n, "histogram_over_time": lambda: n, "avg_over_time": lambda: F.avg(x), "min_over_time": lambda: F.min(x),
        "max_over_time": lambda: F.max(x), "sum_over_time": lambda: F.sum(x), "quantile_over_time": lambda: F.percentile_approx(x, shares, 10_000) if approximate else F.percentile(x, shares),
    }[stage.fn]()
    if step_ns is None:
        out = found.groupBy(*keys).agg(value.alias("value"))
    else:
        out = found.groupBy(*keys, F.expr(f"timestamp_ns div {step_ns} * {step_ns}").alias("ts_ns")).agg(value.alias("value"))
        if zero_fill:
            grid = F.explode(F.sequence(F.lit(from_ns // step_ns * step_ns), F.lit(to_ns), F.lit(step_ns))).alias("ts_ns")
            series = out.groupBy(*names).agg(F.lit(1).alias("one")).select(*names, grid)
            have = out.select(*[F.col(n).alias(f"own_{n}") for n in names], F.col("ts_ns").alias("own_ts"), F.col("value").alias("own_value"))
            near = F.col("own_ts") == F.col("ts_ns")
            for n in names:
                near = near & F.col(f"own_{n}").eqNullSafe(F.col(n))
            none = F.array(*[F.lit(0.0)] * len(stage.params)) if several else F.lit(0.0)
            out = series.join(have, near, "left").select(*names, "ts_ns", F.coalesce("own_value", none).alias("value"))
    if several:
        pairs = F.explode(F.arrays_zip(shares.alias("p"), F.col("value").alias("v"))).alias("x")
        out = out.select(*[c for c in out.columns if c != "value"], pairs).select("*", F.col("x.p").alias("p"), F.col("x.v").alias("value")).drop("x")
        names.append("p")
    for s in tree.stages:
        if isinstance(s, tuple) and s[0] in ("topk", "bottomk"):
            order = F.desc("value") if s[0] == "topk" else F.asc("value")
            place = F.row_number().over(Window.partitionBy(*(["ts_ns"] if step_ns else [])).orderBy(order, *names))
            out = out.withColumn("__place", place).where(F.col("__place") <= s[1]).drop("__place")
    return out


def exemplars(spans: DataFrame, text: str, from_ns: int, to_ns: int, step_ns: int) -> DataFrame:
    """One span per step and group (of a histogram: and bucket): the earliest."""
    tree = Q.parse(text)
    stage = next(s for s in tree.stages if isinstance(s, Q.Metric))
    found = _filtered(spansets(_prepared(_bounded(spans, from_ns, to_ns), tree), tree.spans), tree.stages)
    keys = [attribute(n).cast("string").alias(bare(n)) for n in stage.by]
    if stage.fn == "histogram_over_time":
        keys.append(_power_of_two(F.col("duration_ns")).alias("bucket"))
    names = [bare(n) for n in stage.by] + ["bucket"] * (stage.fn == "histogram_over_time")
    first = F.min(F.struct("timestamp_ns", "trace_id", "span_id", "duration_ns")).alias("e")
    return found.groupBy(*keys, F.expr(f"timestamp_ns div {step_ns} * {step_ns}").alias("ts_ns")).agg(first).select(*names, "ts_ns", "e.trace_id", "e.span_id", "e.duration_ns")


def compare(spans: DataFrame, text: str, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """(key, val, selection, baseline): spans with each attribute value in the compared selection and in the rest; per
    key the values with most spans."""
    tree = Q.parse(text)
    stage = next(s for s in tree.stages if isinstance(s, Q.Compare))
    found = spansets(_bounded(spans, from_ns, to_ns), tree.spans)
    chosen = condition(stage.selection.condition)
    if stage.from_ns is not None and stage.to_ns is not None:
        chosen = chosen & (F.col("timestamp_ns") >= stage.from_ns) & (F.col("timestamp_ns") < stage.to_ns)
    pairs = found.select(chosen.alias("chosen"), F.explode("attrs").alias("key", "val"))
    counts = pairs.groupBy("key", "val").agg(F.count_if(F.col("chosen")).alias("selection"), F.count_if(~F.col("chosen")).alias("baseline"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.col("selection") + F.col("baseline")), "val"))
    return counts.withColumn("p", place).where(F.col("p") <= stage.top).drop("p")
