"""Sources, store, patterns, rules, hooks and responses; more registered queries against their SQL."""

import json
import math
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from obsidra.operators import catalog, logs, metrics, profiles, traces
from obsidra.plans import extras, model, plugins, promql, registry, responses, traceql
from obsidra.plans.lexing import QueryError
from obsidra.sources import adapters, decoders, store, wire
from obsidra.streaming import patterns, rollup, rules
from tests.test_engine import DATA, _norm, views  # noqa: F401

SOME = [
    "src_push_clash", "src_influx_points", "src_datadog_logs", "src_elastic_bulk", "src_otlp_logs", "src_remote_write", "src_otlp_traces_wire", "src_pprof", "store_logs", "log_json_dup",
    "log_json_deep", "log_template_replace", "response_matrix", "pattern_join", "rule_eval", "prom_at_end", "prom_rollup_sum", "prom_long_range", "prom_irate", "trace_amp_desc", "trace_not_anc",
    "trace_desc_deep", "trace_anc_deep", "trace_by", "span_quantiles", "span_zero_fill",
]


@pytest.mark.parametrize("name", SOME)
def test_more_queries_give_the_rows_of_their_sql(spark, views, name):  # noqa: F811
    assert extras.register
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([_norm(r[c]) for c in columns] for r in df.collect()), key=repr)
    found = views.sql(registry.SQL[name])
    names = list(found.columns)
    assert sorted(names) == columns
    assert got == sorted(([_norm(t[names.index(c)]) for c in columns] for t in found.fetchall()), key=repr)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_bounds_reach_the_scan(spark):
    assert "GreaterThanOrEqual(ts," in _plan(registry.QUERIES["log_time_bounds"](spark, DATA))
    assert "GreaterThanOrEqual(ts," in _plan(registry.QUERIES["prom_sum_over_time"](spark, DATA))


def test_ranges_dont_copy_points(spark):
    """A month's range by 15 seconds over few points: one row a step, not one a point and step."""
    points = spark.createDataFrame([({"a": "b"}, k * 60_000, float(k)) for k in range(50)], "labels map<string,string>, ts_ms long, val double")
    got = {r.ts_ms: r.val for r in metrics.query_range(points, "sum_over_time({a=\"b\"}[30d])", 0, 3_600_000, 15_000).collect()}
    assert len(got) == 241 and got[0] == 0.0 and got[3_600_000] == sum(range(50)) and got[90_000] == 1.0
    one = metrics.query(points, 'min_over_time({a="b"}[2m])', 600_000).collect()
    assert [r.val for r in one] == [9.0]


def test_wire_format_round_trip():
    raw = wire.message((1, "text"), (2, -5), (3, 1.5), (4, b"\x00\xff"), (1, "more"))
    found = wire.grouped(raw)
    assert [wire.text(x) for x in found[1]] == ["text", "more"] and wire.signed(found[2][0]) == -5
    assert wire.double(found[3][0]) == 1.5 and bytes(found[4][0]) == b"\x00\xff"
    assert wire.numbers([b"\x01\xac\x02", 7]) == [1, 300, 7]
    with pytest.raises(ValueError):
        list(wire.fields(raw[:3]))


def test_bodies_that_cant_be_read(spark):
    bad = spark.createDataFrame([(bytearray(b"\x0a\x7f"),), (None,)], "body binary")
    with pytest.raises(Exception, match="beyond"):
        wire.log_push(bad, packing=None).collect()
    assert wire.log_push(bad, packing=None, on_error="skip").count() == 0
    lines = spark.createDataFrame([("not a line",)], "value string")
    with pytest.raises(Exception, match="can't read the line"):
        decoders.influx_lines(lines).collect()
    assert decoders.influx_lines(spark.createDataFrame([("# note",), ("  ",)], "value string")).count() == 0


def test_otlp_values_of_all_kinds(spark):
    attrs = [{"key": "s", "value": {"stringValue": "x"}}, {"key": "n", "value": {"doubleValue": 2}}, {"key": "l", "value": {"arrayValue": {"values": [{"intValue": "1"}]}}}, {"key": "s", "value": {"stringValue": "y"}}]
    body = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"observedTimeUnixNano": "5", "body": {"kvlistValue": {"values": []}}, "attributes": attrs}]}]}]})
    row = decoders.otlp_logs(spark.createDataFrame([(body,)], "body string")).first()
    assert row.timestamp_ns == 5 and row.labels["s"] == "y" and row.labels["n"] == "2" and json.loads(row.labels["l"]) == {"values": [{"intValue": "1"}]} and json.loads(row.string) == {"values": []}


def test_readers_by_path():
    assert adapters.reader("/loki/api/v1/push", "application/json") is decoders.log_push
    assert adapters.reader("/loki/api/v1/push", "application/x-protobuf") is wire.log_push
    with pytest.raises(QueryError):
        adapters.reader("/nowhere")


def test_store_prunes_and_expires(spark, tmp_path):
    own = store.Store(spark, str(tmp_path))
    assert own.entries().all().count() == 0
    day = 86_400 * 10**9
    rows = [(k * day, {"a": str(k % 2)}, f"line {k}", 0.0) for k in range(6)]
    entries = spark.createDataFrame(rows, "timestamp_ns long, labels map<string,string>, string string, value double")
    own.write_entries(entries)
    own.write_entries(entries.where("timestamp_ns < 0"))
    found = logs.query(own.entries(), '{a="1"}', logs.Options(day, 4 * day))
    assert sorted(r.string for r in found.collect()) == ["line 1", "line 3"]
    plan = _plan(found)
    assert "PartitionFilters" in plan and "day" in plan and "GreaterThanOrEqual(timestamp_ns," in plan
    assert own.table("time_series").count() == 6
    own.write_entries(entries)
    assert own.table("time_series").count() == 6 and own.table("samples").count() == 12
    gone = own.expire(date(1970, 1, 9), days=5, tables=("samples",))
    assert len(gone) == 4 and sorted({r.string for r in own.entries().all().collect()}) == ["line 4", "line 5"]


def test_patterns_keep_what_differs_apart():
    texts = [("user ann logged in from <_>", 9), ("user bob logged in from <_>", 5), ("cache is full, dropping it now", 3), ("user eve logged out from <_>", 1)]
    found = patterns.clusters(texts)
    assert found[0] == found[1] == "user <_> logged in from <_>" and found[2] == texts[2][0]
    assert found[3] in ("user <_> logged <_> from <_>", texts[3][0]) or found[3] == found[0]


def test_rule_groups(spark):
    group = rules.group_of({"name": "g", "interval": "30s", "rules": [{"alert": "up", "expr": "x > 1", "for": "1m"}]})
    assert rules.due(group, None, 100_000)[0] <= 100_000 and len(rules.due(group, 0, 100_000)) == 3
    assert rules.due(group, rules.due(group, None, 100_000)[0], 100_000) == []
    with pytest.raises(QueryError):
        rules.group_of({"name": "g", "rules": [{"expr": "x"}]})
    points = spark.createDataFrame([({"__name__": "x", "a": "b"}, t, 2.0) for t in (0, 60_000)], "labels map<string,string>, ts_ms long, val double")
    seen = []

    def notify(rule, found):
        kept = found.collect()
        seen.append([(r.labels, r.state, r.since_ms) for r in kept])
        return spark.createDataFrame(kept, found.schema)

    manager = rules.Manager(None, lambda: points, lambda _: None, notify)
    manager.put(group)
    manager.put(rules.group_of({"name": "bad", "rules": [{"record": "r", "expr": "rate(x[1m])"}]}))
    manager.points = lambda: points
    for at in (0, 60_000):
        manager.evaluate(group, at)
    assert seen == [[({"alertname": "up", "a": "b"}, "pending", 0)], [({"alertname": "up", "a": "b"}, "firing", 0)]]
    assert manager.health["", "g", 0].state == "ok"
    manager.points = lambda: 1 / 0
    manager.evaluate(group, 120_000)
    assert manager.health["", "g", 0].state == "err" and manager.remove("", "g") and not manager.health


def test_streaming_rollup_and_tail(spark, tmp_path):
    """The stream's rollup has the rows and columns of the batch one; a tail gives what matches."""
    source, out = str(tmp_path / "in"), []
    rows = [(k * 5 * 10**9, {"a": str(k % 2)}, f"x{k}", float(k)) for k in range(40)]
    entries = spark.createDataFrame(rows, "timestamp_ns long, labels map<string,string>, string string, value double")
    entries.where("timestamp_ns < 150000000000").write.parquet(source)
    stream = lambda: spark.readStream.schema(entries.schema).parquet(source)
    running = rollup.stream_rollup(stream(), "10 seconds").writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c1")).start()
    running.processAllAvailable()
    entries.where("timestamp_ns >= 150000000000").write.mode("append").parquet(source)
    running.processAllAvailable()
    running.stop()
    key = lambda r: (r.timestamp_ns, r.labels["a"])
    want = {key(r): r for r in rollup.rollup(entries).collect()}
    assert len(out) >= 20 and all(r.asDict() == {c: want[key(r)][c] for c in r.asDict()} for r in out)
    made = spark.createDataFrame(out)
    assert rollup.merged(made).count() == len(out)
    lines = []
    running = rollup.tail(stream(), '{a="1"} |= "x3"', lambda df, _: lines.extend(r.string for r in df.collect()), str(tmp_path / "c2"), "0 seconds")
    running.processAllAvailable()
    running.stop()
    assert sorted(lines) == ["x3", *(f"x{k}" for k in range(31, 40, 2))]


def test_hooks(spark):
    entries = spark.createDataFrame([(1, {"a": "b"}, "x", 0.0)], "timestamp_ns long, labels map<string,string>, string string, value double")
    plugins.register_planner("log_query", "mine", lambda df, text, options: df.limit(0) if "never" in text else None)
    try:
        assert logs.query(entries, '{never="x"}').count() == 0 and logs.query(entries, '{a="b"}').count() == 1
    finally:
        plugins.unregister("log_query", "mine")
    with pytest.raises(QueryError):
        plugins.register_planner("nothing", "x", print)


def test_small_helpers(spark):
    assert catalog.moment_ns("1700000000") == catalog.moment_ns(1700000000000) == catalog.moment_ns("2023-11-14T22:13:20Z") == 1700000000 * 10**9
    assert catalog.moment_ns("1.5") == 1_500_000_000 and catalog.auto_step_ns(0, 10**13) == 2 * 10**9
    assert catalog.selectors_of('sum(rate(a{b="c"}[5m])) / d') == ['{__name__="a", b="c"}', '{__name__="d"}']
    assert metrics.suits_rollup("rate(x[1m])", 0, 15_000) and not metrics.suits_rollup("rate(x[20s])", 0, 15_000) and not metrics.suits_rollup("deriv(x[1m])", 0, 15_000)
    assert promql.parse("a @ end()").at_ms == "end" and traceql.parse("{.a} &<< {.b}").spans.op == "&<<"
    text = "".join(responses.body("vector", spark.createDataFrame([("{}", '{"metric":{}}')], "labels string, json string")))
    assert json.loads(text)["data"]["result"] == [{"metric": {}}]
    assert isinstance(model.events_entries(spark.read.parquet(f"{DATA}/events.parquet")), model.Timed)


def test_profiles_merge_and_differ(spark):
    rows = [("p:c:n", "s", k, {"a": "b"}, ["r", x], v) for k, (x, v) in enumerate([("x", 3), ("y", 5), ("x", 1)])]
    df = spark.createDataFrame(rows, "type_id string, service_name string, timestamp_ns long, labels map<string,string>, stack array<string>, value long")
    body = profiles.merged_profile(df, '{service_name="s"}')
    back = wire.pprof(spark.createDataFrame([(bytearray(body),)], "body binary"), "p").collect()
    assert sorted((r.type_id[:5], tuple(r.stack), r.value) for r in back) == [("p:c:n", ("r", "x"), 4), ("p:c:n", ("r", "y"), 5)]
    drawn = profiles.render_diff(df, '{service_name="s"}', '{service_name="none"}')
    assert drawn["left_ticks"] == 9 and drawn["right_ticks"] == 0 and len(drawn["levels"]) == 3
    assert profiles.render(df, '{service_name="s"}', 10**9)["timeline"]["samples"] == [[0, 9.0]]


def test_cycles_of_parents_end(spark):
    rows = [("t", a, b, "n", "s", 1, 1, {"k": a}) for a, b in (("1", "3"), ("2", "1"), ("3", "2"), ("4", "3"))]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, name string, service_name string, timestamp_ns long, duration_ns long, attrs map<string,string>")
    assert {s.span_id for r in traces.search(spans, '{.k="1"} >> {.k=~"."}').collect() for s in r.spans} == {"1", "2", "3", "4"}
    assert {s.span_id for r in traces.search(spans, '{.k="4"} << {.k=~"."}').collect() for s in r.spans} == {"1", "2", "3"}
    assert not math.isnan(1.0) and F is not None
