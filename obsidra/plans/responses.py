"""Query results as response JSON: a text per series, put together in the engine, and the whole body from those."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _figure(value: Column) -> Column:
    """A number as such bodies write it: no exponent or trailing zero where it is whole."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    special = F.when(F.isnan(value), F.lit("NaN")).when(value == float("inf"), F.lit("+Inf")).when(value == float("-inf"), F.lit("-Inf"))
    return F.coalesce(special, F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string")))


def _seconds(ms: Column) -> Column:
    text = (ms / 1000).cast("decimal(20,3)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def _joined(pairs: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(pairs)), lambda p: p["text"]), ","), F.lit("]"))


def _labels() -> Column:
    """The label set in the order of its names."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))


def streams(entries: DataFrame, forward: bool = False) -> DataFrame:
    """(labels, json) per stream of a log query's result; values are [time in ns, line], newest first unless ``forward``."""
    line = F.to_json(F.array(F.col("timestamp_ns").cast("string"), "string"))
    order = F.col("timestamp_ns") if forward else -F.col("timestamp_ns")
    own = entries.groupBy(_labels().alias("labels")).agg(_joined(F.struct(order.alias("at"), F.col("string").alias("by"), line.alias("text"))).alias("values"))
    return own.select("labels", F.concat(F.lit('{"stream":'), "labels", F.lit(',"values":'), "values", F.lit("}")).alias("json"))


def matrix(points: DataFrame) -> DataFrame:
    """(labels, json) per series of points (labels, ts_ms, val): values are [seconds, "figure"] in order."""
    pair = F.concat(F.lit("["), _seconds(F.col("ts_ms")), F.lit(',"'), _figure(F.col("val")), F.lit('"]'))
    own = points.groupBy(_labels().alias("labels")).agg(_joined(F.struct(F.col("ts_ms").alias("at"), pair.alias("text"))).alias("values"))
    return own.select("labels", F.concat(F.lit('{"metric":'), "labels", F.lit(',"values":'), "values", F.lit("}")).alias("json"))


def vector(points: DataFrame) -> DataFrame:
    """(labels, json) per series, of its one value."""
    pair = F.concat(F.lit("["), _seconds(F.col("ts_ms")), F.lit(',"'), _figure(F.col("val")), F.lit('"]'))
    return points.select(_labels().alias("labels"), F.concat(F.lit('{"metric":'), _labels(), F.lit(',"value":'), pair, F.lit("}")).alias("json"))


def as_points(buckets: DataFrame) -> DataFrame:
    """A log metric query's result (labels, bucket_ns, value) as points."""
    return buckets.select("labels", F.expr("bucket_ns div 1000000").alias("ts_ms"), F.col("value").alias("val"))


def body(kind: str, rows: DataFrame) -> Iterator[str]:
    """The whole response in pieces; series come from the engine one partition at a time, so no list of all is made."""
    yield f'{{"status":"success","data":{{"resultType":"{kind}","result":['
    for k, row in enumerate(rows.orderBy("labels").select("json").toLocalIterator()):
        yield ("," if k else "") + row.json
    yield "]}}"
