"""Rule groups: read, checked, evaluated on a schedule, with their points written back and their health kept.

A rule's query is a log query or a metric query; its samples at an evaluation's time become points of the rule's metric.
The schedule is plain arithmetic on times, so that a restart goes on where the last one stopped.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidra.operators import logs, metrics
from obsidra.plans import logql, promql
from obsidra.plans.lexing import QueryError, duration_ns
from obsidra.plans.model import Timed, canonical
from obsidra.streaming import rollup

LOGS, METRICS = "logql", "promql"


@dataclass(frozen=True)
class Rule:
    """``record`` names a recording rule's metric; an alerting rule has a name in ``alert`` and how long it has to hold."""

    expr: str
    record: str = ""
    alert: str = ""
    for_ms: int = 0
    labels: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Group:
    name: str
    interval_ms: int
    rules: tuple[Rule, ...]
    namespace: str = ""
    kind: str = METRICS
    offset_ms: int = 0


@dataclass(frozen=True)
class Health:
    """How a rule's last evaluation went."""

    state: str = "unknown"  # ok, err
    error: str = ""
    at_ms: int = 0
    seconds: float = 0.0


def group_of(config: str | Mapping, namespace: str = "", kind: str = METRICS) -> Group:
    """A group from its JSON: {name, interval, rules: [{record | alert, expr, labels, for}]}."""
    raw = json.loads(config) if isinstance(config, str) else config
    ms = lambda x: duration_ns(str(x)) // 10**6
    rules = tuple(Rule(r["expr"], r.get("record", ""), r.get("alert", ""), ms(r.get("for", "0s")), r.get("labels") or {}) for r in raw.get("rules", ()))
    group = Group(raw["name"], ms(raw.get("interval", "1m")), rules, namespace, kind, ms(raw.get("query_offset", "0s")))
    check(group)
    return group


def check(group: Group) -> None:
    """Raises a QueryError if a rule can't be read."""
    if not group.name or group.interval_ms <= 0:
        raise QueryError("a group needs a name and an interval")
    for rule in group.rules:
        if bool(rule.record) == bool(rule.alert):
            raise QueryError("a rule either records or alerts")
        tree = (logql if group.kind == LOGS else promql).parse(rule.expr)
        if isinstance(tree, logql.Selection):
            raise QueryError("a rule needs a metric query")


def due(group: Group, last_ms: int | None, now_ms: int) -> list[int]:
    """The times after ``last_ms`` up to now at which the group is to be evaluated: whole intervals, moved by a share of
    one that its name gives, so that groups don't all run at once. Without a last time, only the latest."""
    shift = sum(f"{group.namespace}/{group.name}".encode()) * 7919 % group.interval_ms
    latest = (now_ms - shift) // group.interval_ms * group.interval_ms + shift
    if last_ms is None:
        return [latest]
    first = (last_ms - shift) // group.interval_ms * group.interval_ms + shift + group.interval_ms
    return list(range(first, latest + 1, group.interval_ms))


def samples(group: Group, rule: Rule, entries: DataFrame | Timed | None, points: DataFrame | Timed | None, at_ms: int) -> DataFrame:
    """(labels, ts_ms, val) of a rule's query at a time."""
    at = at_ms - group.offset_ms
    if group.kind == LOGS:
        tree = logql.parse(rule.expr)
        found = logs.instant(entries, rule.expr, at * 10**6, _range_ns(tree) or 300 * 10**9).withColumnRenamed("value", "val")
    else:
        found = metrics.query(points, rule.expr, at).drop("ts_ms")
    return found.select("labels", F.lit(at_ms).cast("long").alias("ts_ms"), F.col("val").cast("double").alias("val"))


def _range_ns(tree: object) -> int:
    if isinstance(tree, logql.RangeAgg):
        return tree.range_ns
    return max([_range_ns(x) for name in ("inner", "left", "right") if (x := getattr(tree, name, None)) is not None], default=0)


def recorded(rule: Rule, found: DataFrame) -> DataFrame:
    """A recording rule's points: the query's, renamed, with the rule's labels over their own."""
    more = F.create_map(*[F.lit(x) for pair in {"__name__": rule.record, **rule.labels}.items() for x in pair])
    own = F.map_filter("labels", lambda k, _: ~F.map_contains_key(more, k))
    return found.select(F.map_concat(own, more).alias("labels"), "ts_ms", "val")


def alerts(rule: Rule, found: DataFrame, active: DataFrame | None) -> DataFrame:
    """(labels, state, since_ms, val): what an alerting rule's query gives is pending, and firing once it has done so for
    ``for_ms``. ``active`` is the result of the evaluation before; what isn't there any more is left out."""
    more = F.create_map(*[F.lit(x) for pair in {"alertname": rule.alert, **rule.labels}.items() for x in pair])
    own = F.map_filter("labels", lambda k, _: ~F.map_contains_key(more, k) & (k != "__name__"))
    now = found.select(F.map_concat(own, more).alias("labels"), "ts_ms", "val").withColumn("k", canonical(F.col("labels")))
    since = F.col("ts_ms")
    if active is not None:
        now = now.join(active.select(canonical(F.col("labels")).alias("k"), F.col("since_ms").alias("before")), "k", "left")
        since = F.coalesce("before", "ts_ms")
    state = F.when(F.col("ts_ms") - since >= rule.for_ms, "firing").otherwise("pending")
    return now.select("labels", state.alias("state"), since.alias("since_ms"), "val")


@dataclass
class Manager:
    """Evaluates groups. ``save`` takes a recording rule's points, ``notify`` an alerting rule's alerts."""

    entries: Callable[[], DataFrame | Timed] | None
    points: Callable[[], DataFrame | Timed] | None
    save: Callable[[DataFrame], None]
    notify: Callable[[Rule, DataFrame], DataFrame] | None = None
    groups: dict[tuple[str, str], Group] = field(default_factory=dict)
    last_ms: dict[tuple[str, str], int] = field(default_factory=dict)
    health: dict[tuple[str, str, int], Health] = field(default_factory=dict)
    active: dict[tuple[str, str, int], DataFrame] = field(default_factory=dict)

    def put(self, group: Group) -> None:
        check(group)
        self.groups[group.namespace, group.name] = group

    def remove(self, namespace: str, name: str) -> bool:
        for kept in (self.health, self.active):
            for key in [k for k in kept if k[:2] == (namespace, name)]:
                del kept[key]
        self.last_ms.pop((namespace, name), None)
        return self.groups.pop((namespace, name), None) is not None

    def load(self, rules: DataFrame) -> None:
        """Takes over the newest valid groups of a table (namespace, group_name, config, updated_at, is_valid, type)."""
        found = {(r.namespace, r.group_name): group_of(r.config, r.namespace, r.type) for r in rollup.latest_rules(rules).collect()}
        for key in set(self.groups) - set(found):
            self.remove(*key)
        self.groups = found

    def run(self, now_ms: int) -> int:
        """Evaluates all that is due; returns how many evaluations that were. A rule that fails doesn't stop others."""
        done = 0
        for key, group in self.groups.items():
            for at in due(group, self.last_ms.get(key), now_ms):
                self.evaluate(group, at)
                self.last_ms[key] = at
                done += 1
        return done

    def evaluate(self, group: Group, at_ms: int) -> None:
        for k, rule in enumerate(group.rules):
            key, began = (group.namespace, group.name, k), time.monotonic()
            try:
                found = samples(group, rule, self.entries and self.entries(), self.points and self.points(), at_ms)
                if rule.record:
                    self.save(recorded(rule, found))
                elif self.notify is not None:
                    self.active[key] = self.notify(rule, alerts(rule, found, self.active.get(key)))
                self.health[key] = Health("ok", "", at_ms)
            except Exception as e:  # kept as the rule's state, as one bad rule mustn't end the others
                self.health[key] = Health("err", f"{type(e).__name__}: {e}"[:500], at_ms)
            self.health[key] = replace(self.health[key], seconds=round(time.monotonic() - began, 3))
