"""Parsers, operators on small frames, and registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from obsidra.operators import catalog, logs, metrics, profiles
from obsidra.plans import logql, promql, registry, traceql
from obsidra.plans.lexing import QueryError, duration_ns

DATA = "/root/testdata/sf0.001"

LOG_QUERIES = [
    '{a="b", c=~"d.*"} |= "x" != "y" |~ `z+` !~ "w"', '{a="b"} | json | x >= 4 and (y="4" or z == 2)', '{a="b"} | json k="a.b[0]", l="c" | drop x, y="z"',
    '{a="b"} | logfmt | keep x | label_format p=q, r="s" | line_format "{{.p}} {{divide .r 2}}"', '{a="b"} | regexp "^(?<e>[0-9]+)$"',
    'sum by (a) (rate({a="b"} |~ "2[0-9]$" [1s])) > 4', 'first_over_time({a="b"} | regexp "(?<e>[0-9]+)" | unwrap e [1s]) by (a)', 'count_over_time({a="b"} [1m] offset 1m)',
    'topk(3, sum(sum_over_time({a="b"} | json | unwrap v [10s]) by (a, b)) by (a))', 'rate({a="b"}[1m]) / rate({a="c"}[1m]) * 100', 'rate({a="b"} [5m] |= "x")',
]


@pytest.mark.parametrize("text", LOG_QUERIES)
def test_log_queries_parse(text):
    assert logql.parse(text) is not None


@pytest.mark.parametrize("text", ["{a=}", '{a="b"} |', "rate({a=\"b\"})", 'sum_over_time({a="b"}[1m])', '_macro({a="b"})', '{a="b"} extra'])
def test_bad_log_queries_are_refused(text):
    with pytest.raises(QueryError):
        logql.parse(text)


def test_promql_precedence():
    tree = promql.parse("1 + 2 * 3 ^ 2")
    assert tree.op == "+" and tree.right.op == "*" and tree.right.right.op == "^"
    assert promql.parse("a or b and c").op == "or"
    assert promql.parse("sum by (x) (rate(a[5m] offset 1m)) / on(x) group_left(y) b").matching.include == ("y",)


def test_traceql_parses():
    tree = traceql.parse('{.a =~ "x" && .f > 10} && {duration > 5ms} | count() > 2')
    assert tree.spans.op == "&&" and tree.stages[0].value == 2
    assert duration_ns("1h30m") == 5400 * 10**9


def _entries(spark, rows):
    return spark.createDataFrame(rows, "timestamp_ns long, labels map<string,string>, string string, value double")


def test_json_labels(spark):
    df = _entries(spark, [(1, {"a": "b"}, '{"x": 1, "y": {"z-z": "q"}, "n": null, "l": [1], "e": ""}', 0.0), (2, {"a": "b"}, "not json", 0.0)])
    found = {r.timestamp_ns: r.labels for r in logs.query(df, '{a="b"} | json').collect()}
    assert found[1] == {"a": "b", "x": "1", "y_z_z": "q"}
    assert found[2]["__error__"] == "JSONParserErr"


def test_keep_and_drop(spark):
    df = _entries(spark, [(1, {"a": "b", "c": "d", "__error__": "E"}, "", 0.0)])
    assert logs.query(df, '{a="b"} | keep c').first().labels == {"c": "d", "__error__": "E"}
    assert logs.query(df, '{a="b"} | drop c, a="x"').first().labels == {"a": "b", "__error__": "E"}


TEMPLATES = {
    "{{.a}}-{{_entry}}": "Bb-line", "{{ .a | ToLower }}": "bb", "{{ divide .n 2 }}": "3.5", "{{ add .n 1 | mul 2 }}": "16", "{{ trunc 1 .a }}{{ trunc -1 .a }}": "Bb",
    '{{ replace "b" "c" .a }}': "Bc", '{{ contains "b" .a }}': "true", '{{ regexReplaceAll "[A-Z]" .a "x" }}': "xb", "{{ .missing }}": "", '{{ trimSuffix "b" .a }}': "B",
    "{{ max 3 .n 5 }}": "7", '{{ substr 0 1 .a }}': "B", '{{ indent 2 .a }}': "  Bb", '{{ or .missing "d" }}': "d", '{{ (add 1 2) }}': "3",
}


def test_templates(spark):
    df = _entries(spark, [(1, {"a": "Bb", "n": "7"}, "line", 0.0)])
    from obsidra.functions.templates import compiled

    columns = [compiled(t, F.col("labels"), F.col("string"), F.lit("")).alias(f"c{k}") for k, t in enumerate(TEMPLATES)]
    assert list(df.select(*columns).first()) == list(TEMPLATES.values())


def test_zero_samples_go_and_empty_input(spark):
    df = _entries(spark, [(1, {"a": "b"}, "0", 0.0)])
    assert logs.query(df, 'sum_over_time({a="b"} | unwrap _entry [1m])').count() == 0
    assert logs.query(df.limit(0), 'rate({a="b"}[1m])').count() == 0


def test_range_split_is_consistent(spark):
    df = _entries(spark, [(k * 10**9, {"a": str(k % 3)}, "x" * k, 1.0) for k in range(100)])
    rate = {(str(r.labels), r.bucket_ns): r.value * 60 for r in logs.query(df, 'rate({a=~".+"}[1m])').collect()}
    count = {(str(r.labels), r.bucket_ns): r.value for r in logs.query(df, 'count_over_time({a=~".+"}[1m])').collect()}
    assert rate.keys() == count.keys() and all(math.isclose(rate[k], count[k]) for k in rate)


def test_catalog_lists_are_whole(spark):
    users = F.lpad(F.col("id").cast("string"), 5, "0")
    df = spark.range(10_050).select(F.col("id").alias("timestamp_ns"), F.create_map(F.lit("a"), F.lit("b"), F.lit("user"), users).alias("labels"), F.lit("").alias("string"), F.lit(0.0).alias("value"))
    assert catalog.label_values(df, "user", '{a="b"}').count() == 10_050
    assert catalog.series(df, ['{a="b"}', '{user="00007"}']).count() == 10_050
    assert sorted(r.value for r in catalog.label_values(df, "user", '{a="b"}', limit=2).collect()) == ["00000", "00001"]
    assert sorted(r.labels["user"] for r in catalog.series(df, ['{a="b"}'], limit=2).collect()) == ["00000", "00001"]


def test_histogram_quantile_and_division(spark):
    rows = [({"le": b, "j": "x"}, 1000, v) for b, v in (("1", 2.0), ("2", 6.0), ("+Inf", 8.0))]
    points = spark.createDataFrame(rows, "labels map<string,string>, ts_ms long, val double")
    assert metrics.query(points, 'histogram_quantile(0.5, {j="x"})', 1000).first().val == pytest.approx(1.5)
    assert metrics.query(points, '{le="1"} / 0', 1000).first().val == math.inf
    assert metrics.query(points, "1 + 2 * 3", 1000).first().val == 7


def test_flamegraph_and_dot(spark):
    rows = [("p:c:n", "s", 1, {"a": "b"}, ["r", "x"], 3), ("p:c:n", "s", 1, {"a": "b"}, ["r", "y"], 5), ("p:c:n", "s", 1, {"a": "b"}, ["r"], 1)]
    df = spark.createDataFrame(rows, "type_id string, service_name string, timestamp_ns long, labels map<string,string>, stack array<string>, value long")
    tree = profiles.merged_tree(df, '{service_name="s"}')
    graph = profiles.flamegraph(tree)
    assert graph["total"] == 9 and graph["max_self"] == 5 and graph["levels"][1] == [0, 9, 1, graph["names"].index("r")]
    assert "n0 -> " in profiles.dot(tree)


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["log_json", "log_regexp", "lra_rate", "lra_absent", "unwrap_quantile", "agg_stddev_by", "topk", "bin_div", "sliding", "step_expand", "cat_volume",
                                  "prom_increase", "prom_group_left", "prom_subquery", "trace_and", "trace_desc", "span_quantile", "span_compare", "prof_diff", "rollup_15s", "rollup_rate"])
def test_query_gives_the_rows_of_its_sql(spark, views, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([_norm(r[c]) for c in columns] for r in df.collect()), key=repr)
    found = views.sql(registry.SQL[name])
    names = list(found.columns)
    assert sorted(names) == columns
    assert got == sorted(([_norm(t[names.index(c)]) for c in columns] for t in found.fetchall()), key=repr)


def test_compare_of_all_attributes_gives_the_rows_of_its_sql(spark, views):
    got = sorted(tuple(r[c] for c in ("key", "val", "selection", "baseline")) for r in registry.QUERIES["span_compare_all"](spark, DATA).collect())
    assert [k for k, *_ in got].count("partkey") == 3
    assert got == sorted(views.sql(f"SELECT key, val, selection, baseline FROM ({registry.SQL['span_compare_all']})").fetchall())
