"""What is there: label names, values, series, detected labels and fields, statistics, volume."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidra.functions.labels import json_labels, number
from obsidra.operators.logs import Options, grouped, selected
from obsidra.plans import logql as Q
from obsidra.plans import promql as P
from obsidra.plans.lexing import Cursor
from obsidra.plans.model import fingerprint


def _matched(entries: DataFrame, selector: str | None, options: Options | None) -> DataFrame:
    if selector is None:
        return selected(entries, Q.Selection(()), options or Options())
    c = Cursor(selector)
    prefix = (Q.Matcher("__name__", "=", c.next().text),) if c.peek().kind == "word" else ()
    return selected(entries, Q.Selection(prefix + (Q.matchers(c) if c.sees("{") else ())), options or Options())


def label_names(entries: DataFrame, selector: str | None = None, options: Options | None = None) -> DataFrame:
    return _matched(entries, selector, options).select(F.explode(F.map_keys("labels")).alias("name")).distinct()


def label_values(entries: DataFrame, name: str, selector: str | None = None, options: Options | None = None, limit: int | None = None) -> DataFrame:
    """Distinct values of a label; with ``limit``, the first in order."""
    found = _matched(entries, selector, options).select(F.col("labels")[name].alias("value")).where(F.col("value").isNotNull())
    found = found.distinct()
    return found if limit is None else found.orderBy("value").limit(limit)


def series(entries: DataFrame, selectors: list[str], options: Options | None = None, limit: int | None = None) -> DataFrame:
    """Distinct label sets that any of the selectors matches; with ``limit``, the first in order."""
    found = None
    for s in selectors:
        some = _matched(entries, s, options).select("labels")
        found = some if found is None else found.union(some)
    found = found.groupBy("labels").agg(F.lit(1).alias("one")).select("labels")
    return found if limit is None else found.orderBy(F.to_json(F.array_sort(F.map_entries("labels")))).limit(limit)


def detected_labels(entries: DataFrame, selector: str | None = None, options: Options | None = None) -> DataFrame:
    pairs = _matched(entries, selector, options).select(F.explode("labels").alias("label", "value"))
    return pairs.groupBy("label").agg(F.count_distinct("value").alias("cardinality"))


def detected_fields(entries: DataFrame, selector: str | None = None, options: Options | None = None) -> DataFrame:
    """Fields found in JSON lines: name, distinct values, and the type all values read as."""
    pairs = _matched(entries, selector, options).select(F.explode(json_labels(F.col("string"))).alias("field", "value"))
    kind = F.when(F.count(number(F.col("value"))) == F.count("value"), "number").when(F.count_if(~F.col("value").isin("true", "false")) == 0, "boolean").otherwise("string")
    return pairs.where("field NOT LIKE '\\\\_\\\\_%'").groupBy("field").agg(F.count_distinct("value").alias("cardinality"), kind.alias("type"))


def index_stats(entries: DataFrame, selector: str | None = None, options: Options | None = None) -> DataFrame:
    """(streams, entries, bytes)."""
    return _matched(entries, selector, options).agg(
        F.count_distinct(F.to_json(F.array_sort(F.map_entries("labels")))).alias("streams"), F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum(F.octet_length("string")), F.lit(0)).alias("bytes"),
    )


def volume(entries: DataFrame, selector: str, by: tuple[str, ...] = (), limit: int | None = 100, options: Options | None = None) -> DataFrame:
    """(labels, bytes) of the label sets with most bytes, or of all without a limit; grouped by the target labels, if there are any."""
    found = _matched(entries, selector, options)
    if by:
        found = found.withColumn("labels", grouped(F.col("labels"), ("by", by)))
    sums = found.groupBy("labels").agg(F.sum(F.octet_length("string")).alias("bytes"))
    return sums if limit is None else sums.orderBy(F.desc("bytes"), F.to_json(F.array_sort(F.map_entries("labels")))).limit(limit)


def cardinality(entries: DataFrame, selector: str | None = None, options: Options | None = None, most: int | None = 10_000) -> DataFrame:
    """(series): how many streams match; counted no further than one above ``most``, unless that is None."""
    ids = _matched(entries, selector, options).select(fingerprint(F.col("labels")).alias("id")).distinct()
    return (ids if most is None else ids.limit(most + 1)).agg(F.count(F.lit(1)).alias("series"))


def selectors_of(text: str) -> list[str]:
    """The selectors that a metric query reads, as log selectors."""
    found: list[str] = []

    def visit(node: object) -> None:
        if isinstance(node, P.Selector):
            found.append("{" + ", ".join(f"{m.name}{m.op}{json.dumps(m.value)}" for m in node.matchers) + "}")
        for child in (*getattr(node, "args", ()), *(getattr(node, n, None) for n in ("left", "right", "inner", "param"))):
            if child is not None:
                visit(child)

    visit(P.parse(text))
    return list(dict.fromkeys(found))


def moment_ns(text: str | float) -> int:
    """A time in nanoseconds: unix seconds, milli-, micro- or nanoseconds told by size, or RFC 3339."""
    try:
        value = Decimal(str(text))
    except InvalidOperation:
        moment = datetime.fromisoformat(str(text).replace("Z", "+00:00"))
        moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
        gap = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return ((gap.days * 86400 + gap.seconds) * 10**6 + gap.microseconds) * 1000
    for limit, scale in ((Decimal(10) ** 11, 10**9), (Decimal(10) ** 14, 10**6), (Decimal(10) ** 17, 1000)):
        if abs(value) < limit:
            return int(value * scale)
    return int(value)


def auto_step_ns(from_ns: int, to_ns: int, least_ns: int = 10**9, points: int = 5000) -> int:
    """The least whole number of seconds that gives at most ``points`` steps."""
    return max(least_ns, -(-(to_ns - from_ns) // points // 10**9) * 10**9)
