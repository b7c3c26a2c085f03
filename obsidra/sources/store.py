"""The stored model: samples, series, label index, rollup, spans and profiles as Parquet, partitioned by day.

Writers append; readers give ``Timed`` sources, so that time bounds prune partitions and reach the scan, and matchers on
labels run on the series before they meet the samples. A series has one row a day, whatever its number of samples.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsidra.plans.lexing import QueryError
from obsidra.plans.model import Timed, fingerprint
from obsidra.streaming import rollup

LOG, METRIC = 1, 2
#: Columns and partition columns of each table.
TABLES = {
    "samples": ("fingerprint LONG, timestamp_ns LONG, value DOUBLE, string STRING, type INT, day DATE", ["type", "day"]),
    "time_series": ("fingerprint LONG, labels MAP<STRING,STRING>, updated_at_ns LONG, type INT, day DATE", ["type", "day"]),
    "label_index": ("key STRING, val STRING, fingerprint LONG, type INT, day DATE", ["type", "day"]),
    "metrics_15s": ("fingerprint LONG, timestamp_ns LONG, last DOUBLE, last_ts LONG, max DOUBLE, min DOUBLE, count LONG, sum DOUBLE, bytes DOUBLE, day DATE", ["day"]),
    "metadata": ("metric STRING, type STRING, help STRING, unit STRING, updated_at_ns LONG, day DATE", ["day"]),
    "spans": ("trace_id STRING, span_id STRING, parent_id STRING, name STRING, service_name STRING, timestamp_ns LONG, duration_ns LONG, attrs MAP<STRING,STRING>, day DATE", ["day"]),
    "span_attrs": ("key STRING, val STRING, trace_id STRING, span_id STRING, timestamp_ns LONG, duration_ns LONG, day DATE", ["day"]),
    "profiles": ("type_id STRING, service_name STRING, fingerprint LONG, timestamp_ns LONG, duration_ns LONG, labels MAP<STRING,STRING>, stack ARRAY<STRING>, value LONG, day DATE", ["day"]),
    "profile_series": ("type_id STRING, service_name STRING, fingerprint LONG, labels MAP<STRING,STRING>, day DATE", ["day"]),
    "patterns": ("fingerprint LONG, pattern STRING, timestamp_s LONG, count LONG, day DATE", ["day"]),
}


def day_of(ns: Column | str) -> Column:
    return F.date_add(F.lit(date(1970, 1, 1)), F.expr(f"cast(floor({ns} / 86400000000000) as int)") if isinstance(ns, str) else F.floor(ns / 86400000000000).cast("int"))


@dataclass(frozen=True)
class Store:
    """Tables under one folder. ``names`` gives tables other names, as a deployment with several stores would. A ``flat``
    store has no folder per day, which suits little data over many days; it can't expire."""

    spark: SparkSession
    path: str
    names: dict[str, str] = field(default_factory=dict)
    flat: bool = False

    def where(self, table: str) -> str:
        if table not in TABLES:
            raise QueryError(f"no table {table}")
        return f"{self.path}/{self.names.get(table, table)}"

    def table(self, table: str) -> DataFrame:
        """A table; empty if nothing was written yet."""
        shape, _ = TABLES[table]
        try:
            return self.spark.read.schema(shape).parquet(self.where(table))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], shape)

    def append(self, table: str, rows: DataFrame) -> None:
        shape, by = TABLES[table]
        columns = [c.split()[0] for c in _columns(shape)]
        # One file a day and task, not one per day, task and hash; samples of a series stand together in it.
        order = [c for c in ("fingerprint", "trace_id", "key", "timestamp_ns") if c in columns]
        rows.select(*columns).sortWithinPartitions(*by, *order).write.mode("append").partitionBy(*([] if self.flat else by)).parquet(self.where(table))

    def _fresh(self, rows: DataFrame, table: str, keys: list[str]) -> DataFrame:
        """Rows whose keys the table doesn't have yet, once each. Only the days at hand are read of it."""
        once = rows.dropDuplicates(keys)
        return once.join(self.table(table).select(*keys), keys, "left_anti")

    def write_entries(self, entries: DataFrame, type_: int = LOG, rolled: bool = True) -> None:
        """Entries to samples, new series, their labels' index and, with ``rolled``, the 15-second rollup."""
        marked = entries.withColumns({"fingerprint": fingerprint(F.col("labels")), "day": day_of("timestamp_ns"), "type": F.lit(type_)})
        self.append("samples", marked)
        series = marked.groupBy("fingerprint", "type", "day").agg(F.first("labels").alias("labels"), F.max("timestamp_ns").alias("updated_at_ns"))
        series = self._fresh(series, "time_series", ["fingerprint", "type", "day"])
        index = series.select(F.explode("labels").alias("key", "val"), "fingerprint", "type", "day")
        self.append("label_index", index)
        self.append("time_series", series)
        if rolled:
            made = rollup.rollup(entries).withColumns({"fingerprint": fingerprint(F.col("labels")), "day": day_of("timestamp_ns")})
            self.append("metrics_15s", made)

    def write_metadata(self, rows: DataFrame, at_ns: int) -> None:
        self.append("metadata", rows.withColumns({"updated_at_ns": F.lit(at_ns), "day": day_of(F.lit(at_ns))}))

    def write_spans(self, spans: DataFrame) -> None:
        """Spans, and a row per attribute for searches that start from one."""
        dated = spans.withColumn("day", day_of("timestamp_ns"))
        self.append("spans", dated)
        self.append("span_attrs", dated.select(F.explode("attrs").alias("key", "val"), "trace_id", "span_id", "timestamp_ns", "duration_ns", "day"))

    def write_profiles(self, rows: DataFrame) -> None:
        dated = rows.withColumns({"day": day_of("timestamp_ns"), "fingerprint": fingerprint(F.col("labels"))})
        if "duration_ns" not in rows.columns:
            dated = dated.withColumn("duration_ns", F.lit(0).cast("long"))
        self.append("profiles", dated)
        self.append("profile_series", self._fresh(dated, "profile_series", ["type_id", "service_name", "fingerprint", "day"]))

    def entries(self, type_: int = LOG) -> Timed:
        """Stored samples as entries."""
        series = self.table("time_series").where(F.col("type") == type_).select("fingerprint", "day", "labels")
        shape = lambda samples: samples.join(series, ["fingerprint", "day"]).select("timestamp_ns", "labels", "string", "value")
        return Timed(self.table("samples").where(F.col("type") == type_), "timestamp_ns", shape, "day")

    def points(self) -> Timed:
        """Stored metric samples as points."""
        found = self.entries(METRIC)
        return Timed(found.raw, found.time, lambda df: found.shape(df).select("labels", F.expr("timestamp_ns div 1000000").alias("ts_ms"), F.col("value").alias("val")), "day")

    def rolled(self, type_: int = LOG) -> DataFrame:
        """The rollup with its labels, put together where late or split input made several rows of one step."""
        series = self.table("time_series").where(F.col("type") == type_).select("fingerprint", "day", "labels")
        return rollup.merged(self.table("metrics_15s").join(series, ["fingerprint", "day"]).drop("fingerprint"))

    def spans(self) -> Timed:
        return Timed(self.table("spans"), "timestamp_ns", lambda df: df.drop("day"), "day")

    def spans_with(self, key: str, val: str) -> DataFrame:
        """Keys (trace_id, span_id) of the spans with an attribute, from its index."""
        return self.table("span_attrs").where((F.col("key") == key) & (F.col("val") == val)).select("trace_id", "span_id").distinct()

    def profiles(self) -> DataFrame:
        return self.table("profiles").drop("day", "fingerprint")

    def write_rule(self, points: DataFrame) -> None:
        """A recording rule's points (labels, ts_ms, val) as samples of a metric."""
        self.write_entries(points.select((F.col("ts_ms") * 10**6).alias("timestamp_ns"), "labels", F.lit("").alias("string"), F.col("val").alias("value")), METRIC)

    def expire(self, today: date, days: int = 7, tables: tuple[str, ...] = tuple(TABLES)) -> list[str]:
        """Deletes whole days that lie ``days`` or more before ``today``; returns their folders. Days are folders, so no
        file is rewritten and nothing is read but their names."""
        if self.flat:
            raise QueryError("a flat store can't expire")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf, last, gone = self.spark.sparkContext._jsc.hadoopConfiguration(), today - timedelta(days=days), []

        def visit(path: object, levels: int, own: str | None) -> None:
            fs = path.getFileSystem(conf)
            if not fs.exists(path):
                return
            for status in fs.listStatus(path):
                name = status.getPath().getName()
                if not status.isDirectory() or "=" not in name:
                    continue
                if name.startswith("day=") and name[4:] <= last.isoformat():
                    fs.delete(status.getPath(), True)
                    gone.append(f"{own}/{name}")
                elif levels > 1:
                    visit(status.getPath(), levels - 1, f"{own}/{name}")

        for table in tables:
            visit(hadoop(self.where(table)), len(TABLES[table][1]), table)
        return sorted(gone)


def _columns(shape: str) -> list[str]:
    """Column definitions of a DDL text; commas inside brackets are part of a type."""
    out, deep, at = [], 0, 0
    for k, ch in enumerate(shape):
        deep += (ch == "<") - (ch == ">")
        if ch == "," and deep == 0:
            out.append(shape[at:k].strip())
            at = k + 1
    return [*out, shape[at:].strip()]


def latest_metadata(metadata: DataFrame, limit: int | None = None, metric: str | None = None, per_metric: int = 1) -> DataFrame:
    """(metric, type, help, unit): the newest entries of each metric, metrics in order."""
    if metric is not None:
        metadata = metadata.where(F.col("metric") == metric)
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("updated_at_ns"), "type", "help", "unit"))
    found = metadata.dropDuplicates(["metric", "type", "help", "unit"]).withColumn("p", place).where(F.col("p") <= per_metric)
    found = found.select("metric", "type", "help", "unit")
    return found if limit is None else found.orderBy("metric", "type", "help", "unit").limit(limit)
