"""More registered queries: ingest formats read back from bodies made of the supplied tables, the stored model, patterns,
rules, responses, structural trace operators and the rest of the metric functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsidra.operators import catalog, logs, metrics, profiles, traces
from obsidra.plans import model, registry, responses
from obsidra.plans.registry import END, EVENTS, GRID, HOUR, START, STEP, add, bucketed, over, prom, search, spread, table, where
from obsidra.plans.shared import shared_dir
from obsidra.sources import decoders, store, wire
from obsidra.streaming import patterns, rollup, rules

EVENT = ("event_type", "user_id")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with all they are as text: ns, event_type, user_id, props, value."""
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns")
    return table(spark, sf_dir, "events").select(ns, "event_type", F.col("user_id").cast("string").alias("user_id"), "props", "value", F.lit(0).cast("long").alias("received_ns"))


class _Later:
    """Stands for the functions module while there is no session to make columns with: whatever is asked of it, itself."""

    def __getattr__(self, name: str) -> _Later:
        return self

    def __call__(self, *args: object, **more: object) -> _Later:
        return self

    __getitem__ = __add__ = __sub__ = __call__


def _source(add: Callable, name: str, make: Callable[[DataFrame], DataFrame], read: Callable[[DataFrame], DataFrame], names: tuple[str, ...], sql: str) -> None:
    """A query that makes bodies of events and reads them back; ``sql`` has the columns names, ts_ns, string, value."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spread(read(make(_rows(spark, sf_dir))), names, F.col("timestamp_ns").alias("ts_ns"), "string", "value")

    add(name, run, f"{EVENTS} {sql}")


def _encoded(make: Callable[[dict], bytes], snappy: bool = True) -> Callable[[DataFrame], DataFrame]:
    """Bodies made row by row, as a client would send them; only for queries that show a reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [make(r) for r in b.to_pylist()]
            if snappy:
                out = [_block(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["body"])

    return lambda rows: rows.mapInArrow(run, "body binary")


def _block(raw: bytes) -> bytes:
    return pa.compress(raw, codec="snappy", asbytes=True)


def _attr(key: str, value: bytes) -> bytes:
    return wire.message((1, key), (2, value))


def _ns(ns: int) -> bytes:
    return ns.to_bytes(8, "little")


def _raw64(number: int, value: int) -> bytes:
    """A field of eight bytes."""
    return bytes([number << 3 | 1]) + _ns(value)


def _sources(F: object, add: Callable) -> None:  # noqa: N803
    """Told to ``add``: name, query, SQL. ``F`` is the functions module, or stands for it."""
    _put = partial(_source, add)
    text = lambda c: F.to_json(c)
    labels = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id"))
    body = lambda c: lambda rows: rows.select(c.alias("body"), "received_ns")
    plain = "SELECT event_type, user_id, 'unknown' AS service_name, ts_ns, string, CAST(0 AS DOUBLE) AS value FROM e"
    named = (*EVENT, "service_name")
    values = F.array(F.array(F.col("ns").cast("string"), "props"))
    _put("src_push_values", body(text(F.struct(F.array(F.struct(labels.alias("stream"), values.alias("values"))).alias("streams")))), decoders.log_push, named, plain)
    written = F.concat(F.lit('{event_type="'), "event_type", F.lit('", user_id="'), "user_id", F.lit('"}'))
    entries = F.array(F.struct(F.col("ns").cast("string").alias("ts"), F.col("props").alias("line"), "value"))
    _put("src_push_entries", body(text(F.struct(F.array(F.struct(written.alias("labels"), entries.alias("entries"))).alias("streams")))), decoders.log_push, named, plain.replace("CAST(0 AS DOUBLE) AS value", "value"))
    clash = text(F.struct(F.array(F.struct(F.create_map(F.lit("a-b"), F.lit("x"), F.lit("a_b"), F.col("user_id"), F.lit("app_name"), F.col("event_type")).alias("stream"), values.alias("values"))).alias("streams")))
    _put("src_push_clash", body(clash), decoders.log_push, ("a_b", "service_name"), "SELECT user_id AS a_b, event_type AS service_name, ts_ns, string, CAST(0 AS DOUBLE) AS value FROM e")
    line = F.concat(F.lit("my\\ ev,event_type="), "event_type", F.lit(",u\\,id="), "user_id", F.lit(" value="), F.col("value").cast("string"), F.lit(',note="a, b=c" '), F.col("ns").cast("string"))
    as_value = lambda c: lambda rows: rows.select(c.alias("value"), "received_ns")
    _put("src_influx_points", as_value(line), decoders.influx_lines, ("measurement", "event_type", "u_id", "__name__"), "SELECT 'my ev' AS measurement, event_type, user_id AS u_id, 'value' AS __name__, ts_ns, '' AS string, value FROM e")
    line = F.concat(F.lit("ev,event_type="), "event_type", F.lit(' message="seen by \\"'), "user_id", F.lit('\\"",n=7i'))
    _put("src_influx_log", as_value(line), decoders.influx_lines, ("measurement", "event_type"), """SELECT 'ev' AS measurement, event_type, CAST(0 AS BIGINT) AS ts_ns, 'message="seen by \\"' || user_id || '\\"" n=7i' AS string, CAST(0 AS DOUBLE) AS value FROM e""")
    item = F.struct(F.lit("app").alias("ddsource"), F.concat(F.lit("env:p,env:q,user:"), "user_id").alias("ddtags"), F.lit("h1").alias("hostname"), F.col("props").alias("message"), F.col("event_type").alias("service"))
    _put("src_datadog_logs", body(text(F.array(item))), decoders.datadog_logs, ("env", "user", "ddsource", "hostname", "service_name"), "SELECT 'q' AS env, user_id AS user, 'app' AS ddsource, 'h1' AS hostname, event_type AS service_name, CAST(0 AS BIGINT) AS ts_ns, string, CAST(0 AS DOUBLE) AS value FROM e")
    points = F.array(F.struct(F.expr("ns div 1000000000").alias("timestamp"), "value"))
    series = F.struct(F.array(F.struct(F.lit("ev").alias("metric"), points.alias("points"), F.array(F.struct(F.col("event_type").alias("name"), F.lit("kind").alias("type"))).alias("resources"))).alias("series"))
    _put("src_datadog_metrics", body(text(series)), decoders.datadog_metrics, ("__name__", "resource_kind"), "SELECT 'ev' AS __name__, event_type AS resource_kind, ts_ns // 1000000000 * 1000000000 AS ts_ns, '' AS string, value FROM e")
    worker = text(F.struct(F.col("event_type").alias("EventType"), F.col("user_id").alias("ScriptName"), F.expr("ns div 1000000").alias("EventTimestampMs"), F.lit(True).alias("ActionResult")))
    _put("src_cloudflare", body(F.concat(worker, F.lit("\n"))), lambda raw: decoders.cloudflare_logs(decoders.lines_of(raw), "cf").withColumn("string", F.lit("")), ("EventType", "ScriptName", "ActionResult", "ddsource"), "SELECT event_type AS EventType, user_id AS ScriptName, 'true' AS ActionResult, 'cf' AS ddsource, ts_ns // 1000000 * 1000000 AS ts_ns, '' AS string, CAST(0 AS DOUBLE) AS value FROM e")
    act = lambda kind: text(F.struct(F.struct(F.col("event_type").alias("_index"), F.col("user_id").alias("_id")).alias(kind)))
    bulk = F.concat_ws("\n", act("index"), "props", act("delete"), act("update"), F.lit('{"doc":1}'), act("create"), F.lit('{"new":2}'))
    one = "SELECT event_type AS _index, user_id AS _id, 'elastic' AS type, CAST(0 AS BIGINT) AS ts_ns, {} AS string, CAST(0 AS DOUBLE) AS value FROM e"
    _put("src_elastic_bulk", body(bulk), decoders.elastic_bulk, ("_index", "_id", "type"), one.format("string") + " UNION ALL " + one.format("""'{"new":2}'""").replace(EVENTS, ""))
    _put("src_elastic_document", lambda rows: rows.select(F.col("props").alias("body"), F.col("user_id").alias("id"), "received_ns"), lambda raw: decoders.elastic_documents(raw, "ix"), ("_index", "_id"), "SELECT 'ix' AS _index, user_id AS _id, CAST(0 AS BIGINT) AS ts_ns, string, CAST(0 AS DOUBLE) AS value FROM e")
    attr = lambda key, kind, value: F.struct(F.lit(key).alias("key"), F.struct(value.alias(kind)).alias("value"))
    record = F.struct(F.col("ns").cast("string").alias("timeUnixNano"), F.lit("INFO").alias("severityText"), F.struct(F.col("props").alias("stringValue")).alias("body"), F.array(attr("user_id", "stringValue", F.col("user_id"))).alias("attributes"))
    resource = F.struct(F.array(attr("event_type", "stringValue", F.col("event_type")), attr("user_id", "stringValue", F.lit("none"))).alias("attributes"))
    request = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    otlp = plain.replace("'unknown' AS service_name", "'INFO' AS level")
    _put("src_otlp_logs", body(text(request)), decoders.otlp_logs, (*EVENT, "level"), otlp)
    # The same by the wire format.
    label = lambda r: f'{{event_type="{r["event_type"]}", user_id="{r["user_id"]}"}}'
    stamp = lambda r: wire.message((1, r["ns"] // 10**9), (2, r["ns"] % 10**9))
    _put("src_push_wire", _encoded(lambda r: wire.message((1, wire.message((1, label(r)), (2, wire.message((1, stamp(r)), (2, r["props"]))))))), wire.log_push, named, plain)
    pair = lambda k, v: (1, wire.message((1, k), (2, v)))
    written_ = lambda r: wire.message((1, wire.message(pair("__name__", "ev"), pair("event_type", r["event_type"]), (2, wire.message((1, r["value"]), (2, r["ns"] // 10**6))))))
    _put("src_remote_write", _encoded(written_), wire.remote_write, ("__name__", "event_type"), "SELECT 'ev' AS __name__, event_type, ts_ns // 1000000 * 1000000 AS ts_ns, '' AS string, value FROM e")
    said = lambda v: wire.message((1, v))
    found = lambda r: wire.message((1, wire.message((1, wire.message((1, _attr("event_type", said(r["event_type"]))), (1, _attr("user_id", said("none"))))), (2, wire.message((2, _raw64(1, r["ns"]) + wire.message((3, "INFO"), (5, said(r["props"])), (6, _attr("user_id", said(r["user_id"]))))))))))
    _put("src_otlp_logs_wire", _encoded(found, snappy=False), wire.otlp_logs, (*EVENT, "level"), otlp)

    def spans(name: str, make: Callable[[DataFrame], DataFrame], read: Callable[[DataFrame], DataFrame]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = read(make(_rows(spark, sf_dir)))
            return got.select("trace_id", "parent_id", "name", "service_name", "timestamp_ns", "duration_ns", F.col("attrs")["user"].alias("user"))

        add(name, run, f"{EVENTS} SELECT lpad(user_id, 32, '0') AS trace_id, '' AS parent_id, event_type AS name, event_type AS service_name, ts_ns // 1000 * 1000 AS timestamp_ns, 5000 AS duration_ns, user_id AS user FROM e")

    trace = F.lpad("user_id", 32, "0").alias("traceId")
    span = F.struct(trace, F.lit("00000000000000ab").alias("spanId"), F.col("event_type").alias("name"), F.col("ns").cast("string").alias("startTimeUnixNano"), (F.col("ns") + 5000).cast("string").alias("endTimeUnixNano"), F.array(attr("user", "stringValue", F.col("user_id"))).alias("attributes"))
    service = F.struct(F.array(attr("service.name", "stringValue", F.col("event_type"))).alias("attributes"))
    request = F.struct(F.array(F.struct(service.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    spans("src_otlp_traces", body(text(request)), decoders.otlp_traces)
    zip_ = F.struct(F.col("user_id").alias("traceId"), F.lit("AB").alias("id"), F.col("event_type").alias("name"), F.expr("ns div 1000").alias("timestamp"), F.lit(5).alias("duration"), F.struct(F.col("event_type").alias("serviceName")).alias("localEndpoint"), F.create_map(F.lit("user"), F.col("user_id")).alias("tags"))
    spans("src_zipkin", body(text(F.array(zip_))), decoders.zipkin)
    spans("src_zipkin_lines", body(F.concat(text(zip_), F.lit("\n"))), lambda raw: decoders.zipkin(decoders.lines_of(raw)))
    whole = lambda r: wire.message((1, bytes.fromhex(r["user_id"].rjust(32, "0"))), (2, bytes(7) + b"\xab"), (5, r["event_type"]), (9, _attr("user", said(r["user_id"])))) + _raw64(7, r["ns"]) + _raw64(8, r["ns"] + 5000)
    spans("src_otlp_traces_wire", _encoded(lambda r: wire.message((1, wire.message((1, wire.message((1, _attr("service.name", said(r["event_type"]))))), (2, wire.message((2, whole(r))))))), snappy=False), wire.otlp_traces)

    def stacks(name: str, make: Callable[[dict], bytes], read: Callable[[DataFrame], DataFrame], service: str) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = read(_encoded(make, snappy=False)(_rows(spark, sf_dir)))
            return got.select("type_id", "service_name", "timestamp_ns", F.array_join("stack", ";").alias("stack"), "value")

        add(name, run, f"{EVENTS} SELECT 'process_cpu:cpu:nanoseconds:cpu:nanoseconds' AS type_id, {service} AS service_name, ts_ns AS timestamp_ns, 'main;' || event_type AS stack, CAST(user_id AS BIGINT) AS value FROM e")

    strings = lambda r: ["", "cpu", "nanoseconds", "main", r["event_type"]]
    kind = wire.message((1, 1), (2, 2))
    stacks("src_pprof", lambda r: wire.message((1, kind), (2, wire.message((1, b"\x02\x01"), (2, int(r["user_id"])))), *((4, wire.message((1, k), (4, wire.message((1, k))))) for k in (1, 2)), *((5, wire.message((1, k), (2, k + 2))) for k in (1, 2)), *((6, s) for s in strings(r)), (9, r["ns"]), (11, kind)), wire.pprof, "'unknown'")
    kept = lambda r: wire.message(*((2, wire.message((3, wire.message((1, k))))) for k in (0, 1)), *((3, wire.message((1, k))) for k in (3, 4)), *((5, s) for s in [*strings(r), "process_cpu"]), (7, wire.message((1, b"\x01\x00"))))
    profile = lambda r: wire.message((1, kind), (2, wire.message((1, 0), (2, int(r["user_id"])))), (5, kind)) + _raw64(3, r["ns"])
    stacks("src_otlp_profiles", lambda r: wire.message((1, wire.message((1, wire.message((1, _attr("service.name", said(r["event_type"]))))), (2, wire.message((2, profile(r)))))), (2, kept(r))), lambda raw: wire.otlp_profiles(raw).withColumn("type_id", F.concat(F.lit("process_"), "type_id")), "event_type")
    add("src_remote_metadata", lambda s, d: wire.remote_metadata(_encoded(lambda r: wire.message((3, wire.message((1, 1), (2, r["event_type"]), (4, "Help."), (5, "s")))))(_rows(s, d))).distinct(), "SELECT DISTINCT event_type AS metric, 'counter' AS type, 'Help.' AS help, 's' AS unit FROM events")


def _stored(spark: SparkSession, name: str) -> store.Store:
    """A store of its own for one run of a query."""
    from uuid import uuid4

    return store.Store(spark, f"{shared_dir(spark)}/obsidra/{name}-{uuid4().hex}", flat=name in ("spans", "profiles"))


def _store() -> None:
    window = logs.Options(START * 10**6, END * 10**6)
    inside = f"ts_ns >= {START}000000 AND ts_ns < {END}000000"

    def filled(spark: SparkSession, sf_dir: str, twice: bool = False) -> store.Store:
        own = _stored(spark, "store")
        rows = registry.entries(spark, sf_dir).all()
        for part in ([rows.where("value < 50"), rows.where("NOT value < 50")] if twice else [rows]):
            own.write_entries(part)
        return own

    def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = logs.query(filled(spark, sf_dir, twice=True).entries(), '{event_type="error"} |= "1"', window)
        return spread(found, EVENT, F.col("timestamp_ns").alias("ts_ns"), "string", "value")

    add("store_logs", logged, f"{EVENTS} SELECT event_type, user_id, ts_ns, string, value FROM e WHERE event_type = 'error' AND contains(string, '1') AND {inside}")
    add("store_index", lambda s, d: filled(s, d, twice=True).table("label_index").select("key", "val").distinct(), f"{EVENTS} SELECT 'event_type' AS key, event_type AS val FROM e UNION SELECT 'user_id', user_id FROM e")
    add("store_series", lambda s, d: filled(s, d, twice=True).table("time_series").groupBy("day").count().select(F.col("day").cast("string").alias("day"), F.col("count").alias("series")), "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT (event_type, user_id)) AS series FROM events GROUP BY ALL")
    rate = f'sum by (event_type) (rate({{event_type=~".+"}}[6h]))'
    add("store_rollup", lambda s, d: spread(rollup.shortcut(filled(s, d, twice=True).rolled(), rate), ("event_type",), F.expr("bucket_ns div 1000000").alias("bucket_ms"), F.round("value", 6).alias("value")), f"{EVENTS} {bucketed('count(*) / 21600.0', 6)}")

    def points(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = _stored(spark, "points")
        gauge = model.events_points(table(spark, sf_dir, "events")).all()
        own.write_rule(gauge)
        return spread(metrics.query_range(own.points(), "sum_over_time(event_value[12h])", START, END, STEP), ("event_type",), "ts_ms", F.round("val", 6).alias("val"))

    add("store_points", points, f"{registry.POINTS} {over('sum(val)')}")

    def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = _stored(spark, "spans")
        own.write_spans(registry.spans(spark, sf_dir))
        keys = own.spans_with("returnflag", "R")
        return own.spans().all().join(keys, ["trace_id", "span_id"], "left_semi").select("trace_id", "span_id", "timestamp_ns")

    add("store_spans", traced, f"{registry.SPANS} SELECT trace_id, span_id, ts AS timestamp_ns FROM s WHERE returnflag = 'R'")

    def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = _stored(spark, "profiles")
        own.write_profiles(registry.part_profiles(spark, sf_dir))
        return profiles.merged_tree(own.profiles(), '{__name__="process_cpu", service_name="R"}')

    add("store_profiles", profiled, registry.PROFILES + " " + registry._tree("service = 'R'"))

    def described(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = _stored(spark, "metadata")
        kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.lit("gauge").alias("type"), F.lit("old").alias("help"), F.lit("").alias("unit")).distinct()
        own.write_metadata(kinds, START * 10**6)
        own.write_metadata(kinds.withColumn("help", F.lit("new")), END * 10**6)
        return store.latest_metadata(own.table("metadata"))

    add("cat_metadata", described, "SELECT DISTINCT event_type AS metric, 'gauge' AS type, 'new' AS help, '' AS unit FROM events")
    add("cat_cardinality", lambda s, d: catalog.cardinality(registry.entries(s, d), '{event_type="error"}', most=None), "SELECT count(DISTINCT user_id) AS series FROM events WHERE event_type = 'error'")


def _more_logs() -> None:
    any_ = '{event_type=~".+"}'
    registry.log("log_json_dup", any_ + ' | line_format "{\\"x\\":1,\\"x\\":\\"{{.user_id}}\\"}" | json', "true", {"x": "user_id"}, line="""'{"x":1,"x":"' || user_id || '"}'""")
    registry.log("log_json_deep", any_ + ' | line_format "{\\"p\\":{\\"q\\":{\\"r\\":{\\"s\\":{\\"t\\":\\"{{.user_id}}\\"}}}}}" | json', "true", {"p_q_r_s_t": "user_id"}, line="""'{"p":{"q":{"r":{"s":{"t":"' || user_id || '"}}}}}'""")
    registry.log("log_json_odd_keys", any_ + ' | line_format "{\\"a-b\\":\\"{{.user_id}}\\",\\"c d\\":[1,{\\"e\\":2}]}" | json', "true", {"a_b": "user_id", "c_d": "CAST(NULL AS VARCHAR)"}, line="""'{"a-b":"' || user_id || '","c d":[1,{"e":2}]}'""")
    registry.log("log_template_replace", any_ + ' | line_format "{{Replace .event_type \\"e\\" \\"_\\" 2}}"', "true", line="CASE WHEN length(event_type) - length(replace(event_type, 'e', '')) > 2 THEN regexp_replace(regexp_replace(event_type, 'e', '_'), 'e', '_') ELSE replace(event_type, 'e', '_') END")
    registry.log("log_template_date", any_ + ' | line_format "{{date \\"2006-01-02T15:04\\" __timestamp__}}"', "true", line="strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M')")
    registry.log("log_template_json", any_ + ' | line_format "{{fromJson `\\"a\\\\u0041\\"`}}"', "true", line="'aA'")
    ordered = logs.Options(START * 10**6, END * 10**6, ordered=True, forward=True)
    registry.log("log_ordered", any_, f"ts_ns >= {START}000000 AND ts_ns < {END}000000", options=ordered)
    # Responses.
    count = f"sum by (event_type) (count_over_time({any_}[6h]))"
    rows = bucketed("count(*)", 6)
    add("response_matrix", lambda s, d: responses.matrix(responses.as_points(logs.query(registry.entries(s, d), count))),
        f"""{EVENTS} SELECT '{{"event_type":"' || event_type || '"}}' AS labels, '{{"metric":{{"event_type":"' || event_type || '"}},"values":[' || string_agg('[' || CAST(bucket_ms // 1000 AS VARCHAR) || ',"' || CAST(CAST(value AS BIGINT) AS VARCHAR) || '"]', ',' ORDER BY bucket_ms) || ']}}' AS json FROM ({rows}) GROUP BY event_type""")
    add("response_vector", lambda s, d: responses.vector(metrics.query(model.events_points(table(s, d, "events")), "count_over_time(event_value[12h])", END)),
        f"""{EVENTS} SELECT '{{"event_type":"' || event_type || '"}}' AS labels, '{{"metric":{{"event_type":"' || event_type || '"}},"value":[{END // 1000},"' || CAST(count(*) AS VARCHAR) || '"]}}' AS json FROM e WHERE ts_ns // 1000000 > {END - 12 * HOUR} AND ts_ns // 1000000 <= {END} GROUP BY event_type""")
    add("response_streams", lambda s, d: responses.streams(logs.query(registry.entries(s, d), '{event_type="error"}')),
        f"""{EVENTS} SELECT '{{"event_type":"error","user_id":"' || user_id || '"}}' AS labels, '{{"stream":{{"event_type":"error","user_id":"' || user_id || '"}},"values":[' || string_agg('["' || CAST(ts_ns AS VARCHAR) || '",' || to_json(string) || ']', ',' ORDER BY ts_ns DESC, string) || ']}}' AS json FROM e WHERE event_type = 'error' GROUP BY user_id""")
    # Patterns and rules.
    add("pattern_mine", lambda s, d: patterns.query(patterns.mine(registry.entries(s, d))).select("pattern", "total"), """SELECT '{"k": <_>}' AS pattern, count(*) AS total FROM events""")
    worded = lambda s, d: registry.entries(s, d).all().withColumn("string", F.concat(F.lit("user "), F.col("labels")["user_id"], F.lit(" did "), F.col("labels")["event_type"], F.lit(" at 10.0.0.7:80 in 15ms for good")))
    add("pattern_join", lambda s, d: patterns.query(patterns.mine(worded(s, d).withColumn("labels", F.create_map(F.lit("app"), F.lit("x"))))).select("pattern", "total"), "SELECT 'user <_> did <_> at <_> in <_> for good' AS pattern, count(*) AS total FROM events")
    kept = lambda s, d: patterns.mine(registry.entries(s, d))
    add("pattern_samples", lambda s, d: patterns.query(patterns.merged(kept(s, d)), from_s=START // 1000, to_s=END // 1000 - 1, step_s=86400).select("pattern", F.explode("samples").alias("x")).select("pattern", F.col("x.at").alias("at"), F.col("x.count").alias("n")),
        f"""SELECT '{{"k": <_>}}' AS pattern, epoch_us(ts) // 86400000000 * 86400 AS at, count(*) AS n FROM events WHERE epoch_us(ts) >= {START}000 AND epoch_us(ts) < {END}000 GROUP BY ALL""")

    def ruled(kind: str, expr: str) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            saved: list[DataFrame] = []
            manager = rules.Manager(lambda: registry.entries(spark, sf_dir), lambda: model.events_points(table(spark, sf_dir, "events")), saved.append)
            manager.put(rules.group_of(json.dumps({"name": "g", "interval": "1m", "rules": [{"record": "r:x", "expr": expr, "labels": {"team": "a"}}]}), kind=kind))
            manager.evaluate(manager.groups["", "g"], END)
            if manager.health["", "g", 0].state != "ok":
                raise RuntimeError(manager.health["", "g", 0].error)
            return spread(saved[0], ("__name__", "team", "event_type"), "ts_ms", F.round("val", 6).alias("val"))

        return run

    add("rule_eval", ruled(rules.METRICS, "sum_over_time(event_value[12h]) > 100"), f"{EVENTS} SELECT 'r:x' AS __name__, 'a' AS team, event_type, {END} AS ts_ms, round(sum(value), 6) AS val FROM e WHERE ts_ns // 1000000 > {END - 12 * HOUR} AND ts_ns // 1000000 <= {END} GROUP BY event_type HAVING sum(value) > 100")
    add("rule_eval_logs", ruled(rules.LOGS, f"sum by (event_type) (count_over_time({any_}[6h]))"), f"{EVENTS} SELECT 'r:x' AS __name__, 'a' AS team, event_type, {END} AS ts_ms, CAST(count(*) AS DOUBLE) AS val FROM e WHERE ts_ns >= {END - 6 * HOUR}000000 AND ts_ns < {END}000000 GROUP BY event_type")


def _more_metrics() -> None:
    mean = "avg_over_time(event_value[12h])"
    for fn, sql in {"ceil": "ceil({x})", "floor": "floor({x})", "exp": "exp({x} / 100)", "ln": "ln({x} + 1)", "log2": "log2({x} + 1)", "log10": "log10({x} + 1)", "sgn": "sign({x})", "deg": "degrees({x})", "rad": "radians({x})"}.items():
        inner = {"exp": f"{mean} / 100", "ln": f"{mean} + 1", "log2": f"{mean} + 1", "log10": f"{mean} + 1"}.get(fn, mean)
        prom(f"prom_fn_{fn}", f"{fn}({inner})", over(sql.format(x="avg(val)")))
    for fn in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh"):
        inner, sql = ("1 + {} / 100000", "1 + avg(val) / 100000") if fn == "acosh" else ("{} / 100000", "avg(val) / 100000")
        prom(f"prom_fn_{fn}", f"{fn}({inner.format(mean)})", over(f"{fn}({sql})"))
    for fn, sql in {"minute": "minute({t})", "day_of_week": "dayofweek({t})", "day_of_month": "day({t})", "day_of_year": "dayofyear({t})", "days_in_month": "day(last_day({t}))", "month": "month({t})", "year": "year({t})"}.items():
        prom(f"prom_fn_{fn}", f"{fn}()", f"SELECT CAST(NULL AS VARCHAR) AS event_type, t AS ts_ms, CAST({sql.format(t='make_timestamp(t * 1000)')} AS DOUBLE) AS val FROM {GRID}")
    prom("prom_fn_clamp_min", f"clamp_min({mean}, 50)", over("greatest(50, avg(val))"))
    prom("prom_fn_clamp_max", f"clamp_max({mean}, 50)", over("least(50, avg(val))"))
    prom("prom_fn_vector", "vector(7)", f"SELECT CAST(NULL AS VARCHAR) AS event_type, t AS ts_ms, CAST(7 AS DOUBLE) AS val FROM {GRID}")
    prom("prom_fn_pi", "pi() * 2", f"SELECT CAST(NULL AS VARCHAR) AS event_type, t AS ts_ms, round(pi() * 2, 6) AS val FROM {GRID}")
    prom("prom_fn_timestamp", "timestamp(event_value)", f"SELECT event_type, t AS ts_ms, round(max(p.ts_ms) / 1000.0, 6) AS val FROM p, {GRID} WHERE p.ts_ms > t - {HOUR} AND p.ts_ms <= t GROUP BY event_type, t", lookback=HOUR)
    prom("prom_fn_absent_over_time", 'absent_over_time(event_value{event_type="error"}[10m])', f"SELECT 'error' AS event_type, t AS ts_ms, CAST(1 AS DOUBLE) AS val FROM {GRID} WHERE NOT EXISTS (SELECT 1 FROM p WHERE event_type = 'error' AND p.ts_ms > t - 600000 AND p.ts_ms <= t)")
    for fn in ("sort", "sort_desc"):
        prom(f"prom_fn_{fn}", f"{fn}({mean})", over("avg(val)"))
    for fn in ("sort_by_label", "sort_by_label_desc"):
        prom(f"prom_fn_{fn}", f'{fn}({mean}, "event_type")', over("avg(val)"))
    pairs = f"SELECT event_type, t, arg_max(val, ts_ms) AS last, arg_max(coalesce(prev, 0), ts_ms) AS prev, max(ts_ms) AS seen, arg_max(coalesce(prev_ts, 0), ts_ms) AS before FROM p, {GRID} WHERE ts_ms > t - {12 * HOUR} AND ts_ms <= t GROUP BY event_type, t HAVING count(*) >= 2"
    prom("prom_idelta", "idelta(event_value[12h])", f"SELECT event_type, t AS ts_ms, round(last - prev, 6) AS val FROM ({pairs})")
    # epoch_ms() rounds to milliseconds; points' times are cut off, which a rate over two of them shows.
    cut = "(SELECT event_type, epoch_us(ts) // 1000 AS ts_ms, value AS val, lag(value) OVER w AS prev, lag(epoch_us(ts) // 1000) OVER w AS prev_ts FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)) p"
    value = "round((CASE WHEN last < prev THEN last ELSE last - prev END) / ((seen - before) / 1000.0) * 1000, 6)"
    prom("prom_irate", "irate(event_value[12h]) * 1000", f"SELECT event_type, t AS ts_ms, {value} AS val FROM ({pairs.replace('FROM p,', f'FROM {cut},')})")
    prom("prom_predict_linear", "predict_linear(event_value[1d], 3600)", over("regr_intercept(val, (ts_ms - t) / 1000.0) + 3600 * regr_slope(val, (ts_ms - t) / 1000.0)", 24 * HOUR) + " HAVING count(*) >= 2")
    prom("prom_atan2", f"{mean} atan2 count_over_time(event_value[12h])", over("atan2(avg(val), count(val))"))
    prom("prom_pow", "count_over_time(event_value[12h]) ^ 2", over("count(val) ^ 2"))
    for edge, at in {"start": START, "end": END}.items():
        prom(f"prom_at_{edge}", f"sum_over_time(event_value[12h] @ {edge}())", f"SELECT event_type, t AS ts_ms, round(v, 6) AS val FROM (SELECT event_type, sum(val) AS v FROM p WHERE ts_ms > {at - 12 * HOUR} AND ts_ms <= {at} GROUP BY event_type), {GRID}")
    whole = "(SELECT t AS tt, sum(val) AS v FROM p, " + GRID + f" WHERE ts_ms > t - {12 * HOUR} AND ts_ms <= t GROUP BY t)"
    prom("prom_group_right", "sum(sum_over_time(event_value[12h])) / ignoring(event_type) group_right sum_over_time(event_value[12h])", f"SELECT event_type, t AS ts_ms, round(w.v / a.v, 6) AS val FROM (SELECT event_type, t, sum(val) AS v FROM p, {GRID} WHERE ts_ms > t - {12 * HOUR} AND ts_ms <= t GROUP BY event_type, t) a JOIN {whole} w ON w.tt = a.t")
    prom("prom_agg_of_agg", "max(sum by (event_type) (sum_over_time(event_value[12h])))", f"SELECT CAST(NULL AS VARCHAR) AS event_type, ts_ms, max(val) AS val FROM ({over('sum(val)')}) GROUP BY ts_ms")
    prom("prom_long_range", "max_over_time(event_value[3d])", over("max(val)", 72 * HOUR))
    for fn, agg in {"sum": "sum(val)", "count": "count(val)", "min": "min(val)", "max": "max(val)", "avg": "avg(val)"}.items():
        def rolled(spark: SparkSession, sf_dir: str, fn: str = fn) -> DataFrame:
            gauge = model.events_points(table(spark, sf_dir, "events"))
            kept = rollup.rollup(gauge.all().select((F.col("ts_ms") * 10**6).alias("timestamp_ns"), "labels", F.lit("").alias("string"), F.col("val").alias("value")))
            found = metrics.query_any(gauge, kept, f"{fn}_over_time(event_value[12h])", START, END, STEP)
            return spread(found, ("event_type",), "ts_ms", F.round("val", 6).alias("val"))

        add(f"prom_rollup_{fn}", rolled, f"{registry.POINTS} {over(agg)}")

    def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A histogram per event type: how many values are at most each bound."""
        events, bounds = table(spark, sf_dir, "events"), (50.0, 100.0, 200.0, float("inf"))
        sums = events.groupBy("event_type").agg(F.array(*[F.struct(F.lit("+Inf" if b == float("inf") else str(b)).alias("le"), F.count_if(F.col("value") <= b).cast("double").alias("n")) for b in bounds]).alias("x"))
        rows = sums.select("event_type", F.explode("x").alias("x"))
        points = rows.select(F.create_map(F.lit("__name__"), F.lit("h"), F.lit("event_type"), F.col("event_type"), F.lit("le"), F.col("x.le")).alias("labels"), F.lit(START).cast("long").alias("ts_ms"), F.col("x.n").alias("val"))
        return spread(metrics.query(points, "histogram_quantile(0.4, h)", START), ("event_type",), F.round("val", 6).alias("val"))

    add("prom_histogram_quantile", bars, """WITH c AS (SELECT event_type, count(*) FILTER (value <= 50) AS a, count(*) FILTER (value <= 100) AS b, count(*) FILTER (value <= 200) AS d, count(*) AS n FROM events GROUP BY event_type)
      SELECT event_type, round(CASE WHEN 0.4 * n <= a THEN 50 * 0.4 * n / a WHEN 0.4 * n <= b THEN 50 + 50 * (0.4 * n - a) / (b - a) WHEN 0.4 * n <= d THEN 100 + 100 * (0.4 * n - b) / (d - b) ELSE 200 END, 6) AS val FROM c""")


def _more_traces() -> None:
    root, big = '{name = "F" && nestedSetParent < 0}', "{.quantity > 45}"
    roots, lines = "SELECT trace_id FROM s WHERE parent_id = '' AND name = 'F'", "SELECT trace_id FROM s WHERE quantity > 45"
    down = f"quantity > 45 AND trace_id IN ({roots})"
    up = f"parent_id = '' AND name = 'F' AND trace_id IN ({lines})"
    for name, op in {"amp_child": "&>", "amp_desc": "&>>"}.items():
        search(f"trace_{name}", f"{root} {op} {big}", where(f"({down}) OR ({up})"))
    for name, op in {"amp_parent": "&<", "amp_anc": "&<<"}.items():
        search(f"trace_{name}", f"{big} {op} {root}", where(f"({down}) OR ({up})"))
    search("trace_anc", f"{big} << {root}", where(up))
    search("trace_not_desc", f"{root} !>> {big}", where(f"quantity > 45 AND trace_id NOT IN ({roots})"))
    for name, op in {"not_parent": "!<", "not_anc": "!<<"}.items():
        search(f"trace_{name}", f"{big} {op} {root}", where(f"parent_id = '' AND name = 'F' AND trace_id NOT IN ({lines})"))
    near = "trace_id IN (SELECT trace_id FROM s WHERE {})"
    search("trace_amp_sibling", "{.quantity > 49} &~ {.quantity < 2}", where(f"(quantity < 2 AND {near.format('quantity > 49')}) OR (quantity > 49 AND {near.format('quantity < 2')})"))
    search("trace_not_sibling", "{.quantity > 49} !~ {.quantity < 2}", where(f"quantity < 2 AND NOT {near.format('quantity > 49')}"))
    search("trace_negated", '{!(.quantity > 3) && .returnflag = "R"}', where("quantity <= 3 AND returnflag = 'R'"))
    search("trace_arithmetic", "{.quantity * 2 + 1 > 99}", where("quantity * 2 + 1 > 99"))
    search("trace_by", "{.quantity > 0} | by(.returnflag) | count() > 3", "SELECT trace_id, sum(n) AS n FROM (SELECT trace_id, returnflag, count(*) AS n FROM s WHERE quantity > 0 GROUP BY ALL HAVING count(*) > 3) GROUP BY trace_id")

    def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A trace per event type, each span the child of the one before."""
        number = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
        rows = table(spark, sf_dir, "events").withColumn("n", number)
        return rows.select(
            F.col("event_type").alias("trace_id"), F.col("n").cast("string").alias("span_id"), F.when(F.col("n") > 1, (F.col("n") - 1).cast("string")).otherwise("").alias("parent_id"), F.lit("step").alias("name"),
            F.lit("chain").alias("service_name"), (F.col("n") * 10**9).cast("long").alias("timestamp_ns"), F.lit(1).cast("long").alias("duration_ns"), F.create_map(F.lit("n"), F.col("n").cast("string")).alias("attrs"),
        )

    def deep(name: str, text: str, test: str) -> None:
        numbered = "WITH c AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS m FROM events)"
        add(name, lambda s, d: traces.search(chain(s, d), text, spans_a_trace=None).select("trace_id", "matched"), f"{numbered} SELECT event_type AS trace_id, count(*) AS matched FROM c WHERE {test} GROUP BY event_type")

    deep("trace_desc_deep", "{.n = 2} >> {.n > 100}", "n > 100")
    deep("trace_anc_deep", "{.n = 150} << {.n < 20}", "n < 20 AND m >= 150")
    deep("trace_not_desc_deep", "{.n = 120} !>> {.n > 90}", "n > 90 AND n <= 120")
    low, high, month = 694224000 * 10**9, 1136073600 * 10**9, 30 * 86400 * 10**9
    add("span_quantiles", lambda s, d: traces.metrics(registry.spans(s, d), "{.quantity > 10} | quantile_over_time(.quantity, 0.5, 0.9) by (.returnflag)", low, high, month).select("returnflag", "p", "ts_ns", F.round("value", 6).alias("value")),
        f"{registry.SPANS} SELECT returnflag, p, ts_ns, round(CASE WHEN p = 0.5 THEN a ELSE b END, 6) AS value FROM (SELECT returnflag, ts // {month} * {month} AS ts_ns, quantile_cont(quantity, 0.5) AS a, quantile_cont(quantity, 0.9) AS b FROM s WHERE quantity > 10 AND ts >= {low} AND ts < {high} GROUP BY ALL), (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS p)")
    bucket = "CAST(pow(2, ceil(log2(dur))) AS BIGINT)"
    add("span_exemplar_histogram", lambda s, d: traces.exemplars(registry.spans(s, d), "{.quantity > 10} | histogram_over_time(duration)", low, high, month).select("bucket", "ts_ns", "trace_id", "span_id"),
        f"{registry.SPANS} SELECT {bucket} AS bucket, ts // {month} * {month} AS ts_ns, arg_min(trace_id, (ts, trace_id, span_id)) AS trace_id, arg_min(span_id, (ts, trace_id, span_id)) AS span_id FROM s WHERE quantity > 10 AND ts >= {low} AND ts < {high} GROUP BY ALL")
    add("span_zero_fill", lambda s, d: traces.metrics(registry.spans(s, d), "{.quantity > 49} | count_over_time() by (.returnflag)", low, high - 1, month, zero_fill=True).select("returnflag", "ts_ns", "value"),
        f"{registry.SPANS}, f AS (SELECT returnflag, ts // {month} * {month} AS ts_ns, CAST(count(*) AS DOUBLE) AS value FROM s WHERE quantity > 49 AND ts >= {low} AND ts < {high - 1} GROUP BY ALL) SELECT k.returnflag, g.t AS ts_ns, coalesce(f.value, 0) AS value FROM (SELECT DISTINCT returnflag FROM f) k CROSS JOIN (SELECT unnest(generate_series({low // month * month}, {high - 1}, {month})) AS t) g LEFT JOIN f ON f.returnflag = k.returnflag AND f.ts_ns = g.t")


def _more_profiles() -> None:
    cpu = '{__name__="process_cpu"'
    size = "sum(strlen(c) + 8)"
    add("prof_size", lambda s, d: profiles.size(registry.part_profiles(s, d), cpu + ', service_name="R"}'), f"{registry.PROFILES} SELECT CAST({size} AS BIGINT) AS bytes, count(DISTINCT (service, status, a)) AS series FROM r WHERE service = 'R'")
    add("prof_stats", lambda s, d: profiles.stats(registry.part_profiles(s, d)), f"{registry.PROFILES} SELECT count(*) > 0 AS ingested, min(ts) // 1000000 AS oldest_ms, max(ts) // 1000000 AS newest_ms FROM r")
    add("prof_analyze", lambda s, d: profiles.analyze(registry.part_profiles(s, d), cpu + "}"), f"{registry.PROFILES} SELECT count(DISTINCT (service, status, a)) AS series, count(*) AS samples, CAST({size} AS BIGINT) AS bytes FROM r")
    add("prof_series_of_two", lambda s, d: spread(profiles.series(registry.part_profiles(s, d), cpu + ', service_name="R"}', cpu + ', service_name="A"}'), ("status", "mode"), "service_name"), "SELECT DISTINCT l_linestatus AS status, p_type AS mode, l_returnflag AS service_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('R', 'A')")


def _built(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of _sources(), whose columns are made when it runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found: dict[str, Callable] = {}
        _sources(F, lambda n, query, _: found.update({n: query}))
        return found[name](spark, sf_dir)

    return run


def register() -> None:
    _sources(_Later(), lambda name, _, sql: add(name, _built(name), sql))
    for section in (_store, _more_logs, _more_metrics, _more_traces, _more_profiles):
        section()


register()
