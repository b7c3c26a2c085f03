"""Profiles: selection, series, merged call trees, flame graphs, their difference and a graph drawing.

A profile row: type_id, service_name, timestamp_ns, labels MAP, stack ARRAY<STRING> (root first), value LONG.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from obsidra.functions.labels import matched
from obsidra.operators.logs import grouped
from obsidra.plans.lexing import Cursor, QueryError
from obsidra.plans.logql import matchers
from obsidra.plans.model import canonical

MOST_NODES = 2_000_000  # of a layout, which is for one screen; merged trees have no limit


def type_parts(type_id: str) -> dict[str, str]:
    """type:sampleType:sampleUnit:periodType:periodUnit, or the short form of the first three."""
    parts = type_id.split(":")
    if len(parts) not in (3, 5):
        raise QueryError(f"can't read the type id {type_id!r}")
    return dict(zip(("type", "sample_type", "sample_unit", "period_type", "period_unit"), parts, strict=False))


def selected(profiles: DataFrame, selector: str, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    c = Cursor(selector)
    found = profiles
    part = F.split("type_id", ":")
    special = {"__name__": part[0], "__sample_type__": part[1], "__sample_unit__": part[2], "__period_type__": F.get(part, F.lit(3)), "__period_unit__": F.get(part, F.lit(4)), "__profile_type__": F.col("type_id"), "service_name": F.col("service_name")}
    for m in matchers(c):
        labels = F.create_map(F.lit(m.name), special[m.name]) if m.name in special else F.col("labels")
        test = matched(labels, m.name, m.op, m.value)
        found = found if test is None else found.where(test)
    if from_ns is not None:
        found = found.where(F.col("timestamp_ns") >= from_ns)
    return found if to_ns is None else found.where(F.col("timestamp_ns") < to_ns)


def types(profiles: DataFrame) -> DataFrame:
    return profiles.select("type_id").distinct()


def label_names(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.explode(F.map_keys("labels")).alias("name")).distinct()


def label_values(profiles: DataFrame, name: str) -> DataFrame:
    return profiles.select(F.col("labels")[name].alias("value")).where("value IS NOT NULL").distinct()


def series(profiles: DataFrame, *selectors: str) -> DataFrame:
    """Distinct (type_id, service_name, labels) that any of the selectors matches."""
    found = [selected(profiles, s).select("type_id", "service_name", "labels") for s in selectors]
    return reduce(DataFrame.union, found).groupBy("type_id", "service_name", "labels").agg(F.lit(1).alias("one")).drop("one")


def size(profiles: DataFrame, selector: str | None = None) -> DataFrame:
    """(bytes, series): what the stacks and values take, and distinct series."""
    found = profiles if selector is None else selected(profiles, selector)
    own = F.octet_length(F.array_join("stack", ";")) + 8
    return found.agg(F.coalesce(F.sum(own), F.lit(0)).alias("bytes"), F.count_distinct("type_id", "service_name", canonical(F.col("labels"))).alias("series"))


def stats(profiles: DataFrame) -> DataFrame:
    """(ingested, oldest_ms, newest_ms); 0 where there is nothing."""
    ms = lambda c: F.coalesce(F.expr(f"{c}(timestamp_ns) div 1000000"), F.lit(0))
    return profiles.agg((F.count(F.lit(1)) > 0).alias("ingested"), ms("min").alias("oldest_ms"), ms("max").alias("newest_ms"))


def analyze(profiles: DataFrame, selector: str) -> DataFrame:
    """(series, samples, bytes) that a query reads."""
    found = selected(profiles, selector)
    return size(found).join(found.agg(F.count(F.lit(1)).alias("samples"))).select("series", "samples", "bytes")


def render(profiles: DataFrame, selector: str, step_ns: int, from_ns: int | None = None, to_ns: int | None = None) -> dict:
    """What a page shows of a query: its flame graph and its series over time."""
    found = profiles if from_ns is None and to_ns is None else selected(profiles, "{}", from_ns, to_ns)
    line = select_series(found, selector, step_ns).orderBy("ts_ns").collect()  # a row a step
    return {"flamegraph": flamegraph(merged_tree(found, selector)), "timeline": {"step_ns": step_ns, "samples": [[r.ts_ns, r.value] for r in line]}}


def render_diff(profiles: DataFrame, left: str, right: str) -> dict:
    return flamegraph_diff(diff_tree(profiles, left, right))


def select_series(profiles: DataFrame, selector: str, step_ns: int, by: tuple[str, ...] = (), average: bool = False) -> DataFrame:
    """(labels, ts_ns, value) per step: the sum, or the average per profile row."""
    found = selected(profiles, selector).withColumn("labels", grouped(F.col("labels"), ("by", by)))
    value = F.avg("value") if average else F.sum("value").cast("double")
    return found.groupBy("labels", F.expr(f"timestamp_ns div {step_ns} * {step_ns}").alias("ts_ns")).agg(value.alias("value"))


def merged_stacks(profiles: DataFrame, selector: str) -> DataFrame:
    """(stack, value): samples with one stack summed up."""
    return selected(profiles, selector).groupBy("stack").agg(F.sum("value").alias("value"))


def merged_tree(profiles: DataFrame, selector: str) -> DataFrame:
    """(path, depth, self, total) per node of the merged call tree; a path is the functions from the root joined by ;"""
    stacks = merged_stacks(profiles, selector)
    nodes = stacks.select("value", F.size("stack").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("stack")), lambda k: F.array_join(F.slice("stack", 1, k), ";"))).alias("k", "path"))
    own = F.sum(F.when(F.col("k") + 1 == F.col("n"), F.col("value")).otherwise(0))
    return nodes.groupBy("path", (F.col("k") + 1).alias("depth")).agg(own.alias("self"), F.sum("value").alias("total"))


def diff_tree(profiles: DataFrame, left: str, right: str) -> DataFrame:
    """(path, left_self, left_total, right_self, right_total): both trees side by side, 0 where a node is missing."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    a = merged_tree(profiles, left).select("path", F.col("self").alias("ls"), F.col("total").alias("lt"))
    b = merged_tree(profiles, right).select("path", F.col("self").alias("rs"), F.col("total").alias("rt"))
    return a.join(b, "path", "full_outer").select("path", *[zero(c).alias(n) for c, n in (("ls", "left_self"), ("lt", "left_total"), ("rs", "right_self"), ("rt", "right_total"))])


def merged_profile(profiles: DataFrame, selector: str) -> bytes:
    """A pprof body of the merged stacks, with one sample type a type id."""
    from obsidra.sources.wire import message

    found = selected(profiles, selector).groupBy("type_id", "stack").agg(F.sum("value").alias("value")).orderBy("type_id", "stack")
    rows = found.limit(MOST_NODES).collect()
    types_, strings, names = list(dict.fromkeys(r.type_id for r in rows)), {"": 0}, {}
    text = lambda x: strings.setdefault(x, len(strings))
    place = lambda x: names.setdefault(x, len(names) + 1)
    packed = lambda values: b"".join(message((1, v))[1:] for v in values)
    out = [message((1, message((1, text(p["sample_type"])), (2, text(p["sample_unit"]))))) for p in map(type_parts, types_)]
    for r in rows:
        values = [r.value if t == r.type_id else 0 for t in types_]
        out.append(message((2, message((1, packed(place(f) for f in reversed(r.stack))), (2, packed(values))))))
    for name, k in names.items():
        out.append(message((4, message((1, k), (4, message((1, k)))))) + message((5, message((1, k), (2, text(name))))))
    return b"".join([*out, *(message((6, s)) for s in strings)])


def _layout(tree: DataFrame, total: Callable[[Row], int], bar: Callable[[Row], list[int]], order: str) -> tuple[list[str], list[list[int]], list[Row]]:
    """Names and levels: per level a flat list, per bar its offset from the last one's end, then ``bar`` and its name."""
    children: dict[str, list[Row]] = {}
    rows = tree.orderBy(F.desc(order), "path").limit(MOST_NODES).collect()
    for r in sorted(rows, key=lambda r: r.path):
        children.setdefault(r.path.rpartition(";")[0], []).append(r)
    index, levels = {"total": 0}, []
    placed, at = [], 0
    for r in children.get("", []):
        placed.append((at, r))
        at += total(r)
    while placed:
        level: list[int] = []
        end, below = 0, []
        for x, r in placed:
            level += [x - end, *bar(r), index.setdefault(r.path.rpartition(";")[2], len(index))]
            end, inner = x + total(r), x
            for child in children.get(r.path, []):
                below.append((inner, child))
                inner += total(child)
        levels.append(level)
        placed = below
    return list(index), levels, children.get("", [])


def flamegraph(tree: DataFrame) -> dict:
    """Names and levels for drawing: per bar the offset from the last bar's end, total, self, name."""
    names, levels, roots = _layout(tree, lambda r: r.total, lambda r: [r.total, r.self], "total")
    total = sum(r.total for r in roots)
    return {"names": names, "levels": [[0, total, 0, 0], *levels], "total": total, "max_self": max([x for level in levels for x in level[2::4]], default=0)}


def flamegraph_diff(tree: DataFrame) -> dict:
    """As flamegraph(), of a difference: per bar offset, total and self of the left, then of the right side, name. A bar
    is as wide as both its totals, so that every node of either side has room."""
    both = lambda r: r.left_total + r.right_total
    tree = tree.withColumn("both", F.col("left_total") + F.col("right_total"))
    names, levels, roots = _layout(tree, both, lambda r: [r.left_total, r.left_self, r.right_total, r.right_self], "both")
    left, right = (sum(r[f"{side}_total"] for r in roots) for side in ("left", "right"))
    most = max([max(level[k], level[k + 2]) for level in levels for k in range(2, len(level) - 3, 6)], default=0)
    return {"names": names, "levels": [[0, left, 0, right, 0, 0], *levels], "total": left + right, "left_ticks": left, "right_ticks": right, "max_self": most}


def dot(tree: DataFrame, most: int = 100) -> str:
    """The nodes with the largest totals as a graph in DOT."""
    rows = tree.orderBy(F.desc("total"), "path").limit(most).collect()
    kept = {r.path: k for k, r in enumerate(rows)}
    total = max([r.total for r in rows], default=1) or 1
    lines = ["digraph profile {", "  node [shape=box];"]
    for path, k in kept.items():
        r = rows[k]
        lines.append(f'  n{k} [label="{path.rpartition(";")[2]}\\n{r.self} of {r.total}" fontsize={8 + round(16 * r.total / total)}];')
        up = path.rpartition(";")[0]
        if up in kept:
            lines.append(f'  n{kept[up]} -> n{k} [label="{r.total}"];')
    return "\n".join([*lines, "}"])
