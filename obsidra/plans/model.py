"""Tables of the data model and adapters that put ordinary tables into it.

Entries (log lines and metric points): timestamp_ns LONG, labels MAP<STRING,STRING>, string STRING, value DOUBLE.
Points (metric samples): labels MAP<STRING,STRING>, ts_ms LONG, val DOUBLE.
Spans: trace_id, span_id, parent_id, name, service_name STRING, timestamp_ns, duration_ns LONG, attrs MAP<STRING,STRING>.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Timed:
    """A source whose time bounds are put on its own time column, so that they reach the scan, before ``shape`` turns it
    into entries, points or spans. ``day``, if there is one, is a date column that partitions the source."""

    raw: DataFrame
    time: str
    shape: Callable[[DataFrame], DataFrame]
    day: str | None = None

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802
        return self.raw.sparkSession

    def all(self) -> DataFrame:
        return self.shape(self.raw)

    def between(self, low_ns: int | None, high_ns: int | None) -> DataFrame:
        """Rows from ``low_ns`` up to ``high_ns``, rounded outwards to what the time column tells apart."""
        df, kind = self.raw, self.raw.schema[self.time].dataType
        for bound, low in ((low_ns, True), (high_ns, False)):
            if bound is None or abs(bound) >= 1 << 62:
                continue
            micros = bound // 1000 if low else -(-bound // 1000)
            moment = datetime(1970, 1, 1) + timedelta(microseconds=micros)
            own = F.lit(bound) if isinstance(kind, T.LongType) else F.lit(moment).cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else F.timestamp_micros(F.lit(micros))
            df = df.where(F.col(self.time) >= own if low else F.col(self.time) <= own)
            if self.day is not None:
                on = F.lit(moment.date())
                df = df.where(F.col(self.day) >= on if low else F.col(self.day) <= on)
        return self.shape(df)


def canonical(labels: Column) -> Column:
    """The label set as text, the same for any order of its entries."""
    return F.to_json(F.array_sort(F.map_entries(labels)))


def fingerprint(labels: Column) -> Column:
    return F.xxhash64(canonical(labels))


def label(name: str) -> Column:
    return F.col("labels")[name]


def frame_of(source: DataFrame | Timed) -> DataFrame:
    return source.all() if isinstance(source, Timed) else source


def _events_entries(events: DataFrame) -> DataFrame:
    return events.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"),
        F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string")).alias("labels"),
        F.col("props").alias("string"), "value",
    )


def events_entries(events: DataFrame) -> Timed:
    """Entries of an events table: labels event_type and user_id, line props, value value."""
    return Timed(events, "ts", _events_entries)


def events_counters(events: DataFrame, name: str = "events_total") -> DataFrame:
    """Points of a counter per event type that grows by one with each event, and of a gauge with the event's value."""
    ordered = Window.partitionBy("event_type").orderBy("ts", "event_id")
    counted = events.withColumn("n", F.row_number().over(ordered).cast("double"))
    return counted.select(
        F.create_map(F.lit("__name__"), F.lit(name), F.lit("event_type"), F.col("event_type")).alias("labels"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("n").alias("val"),
    )


def events_points(events: DataFrame, name: str = "event_value") -> Timed:
    """Points of a gauge per event type with each event's value."""
    shape = lambda df: df.select(
        F.create_map(F.lit("__name__"), F.lit(name), F.lit("event_type"), F.col("event_type")).alias("labels"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("value").alias("val"),
    )
    return Timed(events, "ts", shape)


def order_spans(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Spans: a root per order and a child per line, numbered within the order as a line number may repeat."""
    number = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    roots = orders.select(
        F.col("o_orderkey").cast("string").alias("trace_id"), F.lit("0").alias("span_id"), F.lit("").alias("parent_id"),
        F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("service_name"), ns("o_orderdate").alias("timestamp_ns"),
        F.lit(10**9).cast("long").alias("duration_ns"),
        F.create_map(F.lit("price"), F.col("o_totalprice").cast("string"), F.lit("custkey"), F.col("o_custkey").cast("string")).alias("attrs"),
    )
    lines = lineitem.withColumn("k", F.row_number().over(number)).select(
        F.col("l_orderkey").cast("string").alias("trace_id"), F.col("k").cast("string").alias("span_id"), F.lit("0").alias("parent_id"),
        F.col("l_linestatus").alias("name"), F.lit("lines").alias("service_name"), ns("l_shipdate").alias("timestamp_ns"),
        (F.col("l_quantity") * 10**9).cast("long").alias("duration_ns"),
        F.create_map(F.lit("returnflag"), F.col("l_returnflag"), F.lit("quantity"), F.col("l_quantity").cast("string"), F.lit("partkey"), F.col("l_partkey").cast("string")).alias("attrs"),
    )
    return roots.unionByName(lines)
