"""15-second rollups, the query shortcut over them, live tail and recording rules; the same code for batch and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidra.operators import logs
from obsidra.operators.logs import Options
from obsidra.plans import logql as Q
from obsidra.plans.model import canonical, frame_of

STEP_NS = 15 * 10**9


def rollup(entries: DataFrame, step_ns: int = STEP_NS) -> DataFrame:
    """Mergeable aggregates per label set and step. On a stream, give it a watermark on ``event_time`` first."""
    keys = ["labels", "timestamp_ns"]
    entries = frame_of(entries)
    stepped = entries.withColumns({"raw_ns": F.col("timestamp_ns"), "timestamp_ns": F.expr(f"timestamp_ns div {step_ns} * {step_ns}")})
    return stepped.groupBy(*keys).agg(*_parts("raw_ns"))


def _parts(time: str) -> list[Column]:
    return [
        F.max_by("value", F.struct(time, "string")).alias("last"), F.max(time).alias("last_ts"), F.max("value").alias("max"), F.min("value").alias("min"),
        F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"), F.sum(F.octet_length("string")).cast("double").alias("bytes"),
    ]


def merged(parts: DataFrame) -> DataFrame:
    """Rollups of late or split input, put together."""
    return parts.groupBy("labels", "timestamp_ns").agg(
        F.max_by("last", "last_ts").alias("last"), F.max("last_ts").alias("last_ts"), F.max("max").alias("max"), F.min("min").alias("min"),
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.sum("bytes").alias("bytes"),
    )


def shortcut(rolled: DataFrame, text: str) -> DataFrame | None:
    """A rate or count query from the rollup, or None where only raw entries can answer it: any stage, an offset or range
    that isn't whole steps, or another function."""
    tree = Q.parse(text)
    grouping, inner = (tree.grouping or ("by", ()), tree.inner) if isinstance(tree, Q.VectorAgg) else (None, tree)
    if isinstance(tree, Q.VectorAgg) and tree.fn != "sum" or not isinstance(inner, Q.RangeAgg):
        return None
    if inner.fn not in ("rate", "count_over_time", "bytes_rate", "bytes_over_time") or inner.inner.stages or inner.range_ns % STEP_NS or inner.offset_ns % STEP_NS or inner.grouping:
        return None
    df = logs.selected(rolled, inner.inner, Options())
    size = inner.range_ns
    value = F.sum("bytes") if inner.fn.startswith("bytes") else F.sum("count").cast("double")
    value = value / (size / 1e9) if inner.fn.endswith("rate") else value
    labels = F.col("labels") if grouping is None else logs.grouped(F.col("labels"), grouping)
    df = df.select(labels.alias("labels"), F.expr(f"(timestamp_ns + {inner.offset_ns}) div {size} * {size}").alias("bucket_ns"), "count", "bytes")
    return df.groupBy("labels", "bucket_ns").agg(value.alias("value")).where("value <> 0")


def tail(stream: DataFrame, text: str, deliver: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "1 second"):  # noqa: ANN201
    """Starts a live tail: each micro-batch of new entries goes through the query, and on to ``deliver``."""
    tree = Q.parse(text)
    found = logs.selected(stream, tree, Options())
    return found.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def stream_rollup(stream: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """rollup() of a stream: a step is given out once the watermark has passed it. Entries later than ``lateness`` are
    left to a batch over what is stored, whose rows ``merged`` puts together with these."""
    timed = stream.withColumn("event_time", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark("event_time", lateness)
    keyed = timed.groupBy(F.window("event_time", "15 seconds").alias("step"), canonical(F.col("labels")).alias("series"))
    made = keyed.agg(*_parts("timestamp_ns"))
    labels = F.map_from_entries(F.from_json("series", "array<struct<key:string,value:string>>"))
    return made.select(labels.alias("labels"), (F.unix_micros("step.start") * 1000).alias("timestamp_ns"), "last", "last_ts", "max", "min", "count", "sum", "bytes")


def record(entries: DataFrame, name: str, text: str, labels: dict[str, str] | None = None, options: Options | None = None) -> DataFrame:
    """A recording rule: the query's samples as points of metric ``name`` with the rule's labels."""
    more = F.create_map(*[F.lit(x) for pair in {"__name__": name, **(labels or {})}.items() for x in pair])
    found = logs.query(entries, text, options)
    own = F.map_filter(F.col("labels"), lambda k, _: ~F.map_contains_key(more, k))
    return found.select(F.map_concat(own, more).alias("labels"), F.expr("bucket_ns div 1000000").alias("ts_ms"), F.col("value").alias("val"))


def latest_rules(rules: DataFrame) -> DataFrame:
    """The newest valid row per rule group; an invalid newest row removes it."""
    last = rules.groupBy("namespace", "group_name").agg(F.max_by(F.struct("config", "updated_at", "is_valid", "type"), "updated_at").alias("r"))
    return last.where("r.is_valid = 1").select("namespace", "group_name", "r.*")
