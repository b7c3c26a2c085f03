"""Registered queries over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsidra.operators import catalog, logs, metrics, profiles, traces
from obsidra.plans import model
from obsidra.streaming import rollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000
START, END, STEP = 1704153600000, 1704585600000, 6 * HOUR  # 2024-01-02 to 2024-01-07, by six hours
EVENTS = "WITH e AS (SELECT epoch_us(ts) * 1000 AS ts_ns, event_type, CAST(user_id AS VARCHAR) AS user_id, props AS string, value, event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.events_entries(table(spark, sf_dir, "events"))


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def spread(df: DataFrame, names: tuple[str, ...], *rest: Column | str) -> DataFrame:
    return df.select(*[F.col("labels")[n].alias(n) for n in names], *rest)


def log(name: str, text: str, where: str, more: dict[str, str] | None = None, line: str = "string", options: logs.Options | None = None, tail: str = "") -> None:
    more = more or {}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spread(logs.query(entries(spark, sf_dir), text, options), ("event_type", "user_id", *more), F.col("timestamp_ns").alias("ts_ns"), "string", "value")

    extra = "".join(f", {sql} AS {n}" for n, sql in more.items())
    add(name, run, f"{EVENTS} SELECT * REPLACE ({line} AS string) FROM (SELECT event_type, user_id, ts_ns, string, value{extra} FROM e WHERE {where} {tail})")


def metric(name: str, text: str, sql: str, names: tuple[str, ...] = ("event_type",), options: logs.Options | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = logs.query(entries(spark, sf_dir), text, options)
        return spread(found, names, F.expr("bucket_ns div 1000000").alias("bucket_ms"), F.round("value", 6).alias("value"))

    add(name, run, f"{EVENTS} {sql}")


def bucketed(agg: str, hours: int, names: str = "event_type", where: str = "true", having: str = "") -> str:
    """Aggregates of events per bucket, as rows of names, bucket_ms, value."""
    size = hours * HOUR
    return f"SELECT {names}, (ts_ns // 1000000) // {size} * {size} AS bucket_ms, round(CAST({agg} AS DOUBLE), 6) AS value FROM e WHERE {where} GROUP BY ALL HAVING {agg} <> 0 {having}"


def _logs() -> None:
    any_ = '{event_type=~".+"}'
    log("log_select_eq", '{event_type="error"}', "event_type = 'error'")
    log("log_select_neq", '{event_type!="error"}', "event_type <> 'error'")
    log("log_select_re", '{event_type=~"error|purchase"}', "event_type IN ('error', 'purchase')")
    log("log_select_nre", '{event_type!~"^(error|purchase)$", user_id="7"}', "event_type NOT IN ('error', 'purchase') AND user_id = '7'")
    log("log_select_absent", '{event_type="error", nothing=""}', "event_type = 'error'")
    log("log_line_contains", any_ + ' |= "7"', "contains(string, '7')")
    log("log_line_not", any_ + ' != "7"', "NOT contains(string, '7')")
    log("log_line_re", any_ + ' |~ "[5-7]}$"', "regexp_matches(string, '[5-7]}$')")
    log("log_line_nre", any_ + ' !~ "[5-7]}$"', "NOT regexp_matches(string, '[5-7]}$')")
    log("log_line_pattern", any_ + ' |> `<_>: 1<_>`', "string LIKE '%: 1%'")
    log("log_line_bool", any_ + ' |= ("1" or "2") and "3"', "(contains(string, '1') OR contains(string, '2')) AND contains(string, '3')")
    log("log_label_num", any_ + " | json | k > 50", "k > 50", {"k": "CAST(CAST(k AS BIGINT) AS VARCHAR)"})
    log("log_label_bool", any_ + ' | json | k > 50 and k < 80 or event_type="error"', "k > 50 AND k < 80 OR event_type = 'error'", {"k": "CAST(CAST(k AS BIGINT) AS VARCHAR)"})
    log("log_json", any_ + " | json", "true", {"k": "CAST(CAST(k AS BIGINT) AS VARCHAR)"})
    log("log_json_path", '{event_type="error"} | json kk="k"', "event_type = 'error'", {"kk": "CAST(CAST(k AS BIGINT) AS VARCHAR)"})
    log("log_regexp", any_ + ' | regexp "(?P<first>[0-9])[0-9]*"', "true", {"first": "regexp_extract(string, '([0-9])[0-9]*', 1)"})
    log("log_logfmt", any_ + ' | line_format "a=1 b=\\"x y\\" c={{.event_type}}" | logfmt', "true", {"a": "'1'", "b": "'x y'", "c": "event_type"}, line="'a=1 b=\"x y\" c=' || event_type")
    log("log_drop", any_ + ' | drop user_id, event_type="error"', "true")
    SQL["log_drop"] = f"{EVENTS} SELECT CASE WHEN event_type <> 'error' THEN event_type END AS event_type, CAST(NULL AS VARCHAR) AS user_id, ts_ns, string, value FROM e"
    log("log_keep", any_ + ' | keep user_id', "true")
    SQL["log_keep"] = f"{EVENTS} SELECT CAST(NULL AS VARCHAR) AS event_type, user_id, ts_ns, string, value FROM e"
    log("log_label_format", any_ + ' | label_format kind=event_type, fixed="x"', "true", {"kind": "event_type", "fixed": "'x'"})
    log("log_line_format", any_ + ' | line_format "{{.event_type | ToUpper}}-{{.user_id}} {{_entry}}"', "true", line="upper(event_type) || '-' || user_id || ' ' || string")
    log("log_error_filter", any_ + ' | json | __error__=""', "true", {"k": "CAST(CAST(k AS BIGINT) AS VARCHAR)"})
    log("log_limit_desc", any_, "true", options=logs.Options(limit=50), tail="ORDER BY ts_ns DESC LIMIT 50")
    log("log_limit_asc", any_, "true", options=logs.Options(limit=50, forward=True), tail="ORDER BY ts_ns LIMIT 50")
    log("log_time_bounds", any_, f"ts_ns >= {START}000000 AND ts_ns < {END}000000", options=logs.Options(START * 10**6, END * 10**6))


def _metrics() -> None:
    any_, both = '{event_type=~".+"}', ("event_type", "user_id")
    stream = "event_type, user_id"
    metric("lra_rate", f"rate({any_}[6h])", bucketed("count(*) / 21600.0", 6, stream), both)
    metric("lra_count", f"count_over_time({any_}[6h])", bucketed("count(*)", 6, stream), both)
    metric("lra_bytes_rate", f"bytes_rate({any_}[6h])", bucketed("sum(strlen(string)) / 21600.0", 6, stream), both)
    metric("lra_bytes", f"bytes_over_time({any_}[6h])", bucketed("sum(strlen(string))", 6, stream), both)
    window = logs.Options(START * 10**6, END * 10**6)
    metric("lra_absent", f'absent_over_time({{event_type="error"}}[6h])', f""", t AS (SELECT DISTINCT event_type, user_id, (ts_ns // 1000000) // {6 * HOUR} * {6 * HOUR} AS b FROM e WHERE event_type = 'error' AND ts_ns >= {START}000000 AND ts_ns < {END}000000)
      SELECT s.event_type, s.user_id, g.b AS bucket_ms, CAST(1 AS DOUBLE) AS value FROM (SELECT DISTINCT event_type, user_id FROM t) s, (SELECT unnest(generate_series({START}, {END - 1}, {6 * HOUR})) AS b) g
      WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.event_type = s.event_type AND t.user_id = s.user_id AND t.b = g.b)""", both, window)
    for fn, agg in {"sum": "sum(k)", "avg": "avg(k)", "min": "min(k)", "max": "max(k)", "first": "arg_min(k, ts_ns)", "last": "arg_max(k, ts_ns)", "stddev": "stddev_pop(k)", "stdvar": "var_pop(k)"}.items():
        metric(f"unwrap_{fn}", f"{fn}_over_time({any_} | json | unwrap k [12h]) by (event_type)", bucketed(agg, 12))
    metric("unwrap_rate", f"rate({any_} | json | unwrap k [12h]) by (event_type)", bucketed("sum(k) / 43200.0", 12))
    metric("unwrap_quantile", f"quantile_over_time(0.9, {any_} | json | unwrap k [1d]) by (event_type)", bucketed("quantile_cont(k, 0.9)", 24))
    inner = f"SELECT event_type, user_id, (ts_ns // 1000000) // {12 * HOUR} * {12 * HOUR} AS bucket_ms, CAST(count(*) AS DOUBLE) AS v FROM e GROUP BY ALL"
    for fn, agg in {"sum": "sum(v)", "min": "min(v)", "max": "max(v)", "avg": "avg(v)", "count": "count(v)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
        metric(f"agg_{fn}_by", f"{fn} by (event_type) (count_over_time({any_}[12h]))", f"SELECT event_type, bucket_ms, round(CAST({agg} AS DOUBLE), 6) AS value FROM ({inner}) GROUP BY ALL HAVING {agg} <> 0")
    metric("agg_sum_without", f"sum without (user_id) (count_over_time({any_}[12h]))", bucketed("count(*)", 12))
    metric("agg_sum_all", f"sum(count_over_time({any_}[12h]))", bucketed("count(*)", 12, "CAST(NULL AS VARCHAR) AS event_type"))
    metric("agg_filtered", 'sum by (event_type) (rate({event_type=~"error|purchase"} |= "k" [1h]))', bucketed("count(*) / 3600.0", 1, where="event_type IN ('error', 'purchase') AND contains(string, 'k')"))
    for op, sign in {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "==", "ne": "!="}.items():
        sql = {"==": "=", "!=": "<>"}.get(sign, sign)
        metric(f"cmp_{op}", f"sum by (event_type) (count_over_time({any_}[6h])) {sign} 17", bucketed("count(*)", 6, having=f"AND count(*) {sql} 17"))
    for fn, way in {"topk": "DESC", "bottomk": "ASC"}.items():
        metric(fn, f"{fn}(2, sum by (event_type) (sum_over_time({any_} | json | unwrap k [1d])))", f""" SELECT event_type, bucket_ms, value FROM (SELECT *, row_number() OVER (PARTITION BY bucket_ms ORDER BY value {way}, event_type) AS p FROM ({bucketed("sum(k)", 24)})) WHERE p <= 2""")
    count, total = f"sum by (event_type) (count_over_time({any_}[12h]))", f"sum by (event_type) (sum_over_time({any_} | json | unwrap k [12h]))"
    for op, sign in {"add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%"}.items():
        metric(f"bin_{op}", f"{total} {sign} {count}", bucketed(f"(sum(k) {sign} CAST(count(*) AS DOUBLE))", 12))
    metric("bin_scalar", f"{count} * 2 + 1", bucketed("(count(*) * 2.0 + 1)", 12))
    metric("bin_cmp", f"{count} > {total} / 50", bucketed("count(*)", 12, having="AND count(*) > sum(k) / 50"))
    metric("offset", f"sum by (event_type) (count_over_time({any_}[6h] offset 6h))", f"SELECT event_type, bucket_ms + {6 * HOUR} AS bucket_ms, value FROM ({bucketed('count(*)', 6)})")
    metric("sliding", f"sum by (event_type) (count_over_time({any_}[6h]))", f"SELECT event_type, g.t AS bucket_ms, CAST(count(*) AS DOUBLE) AS value FROM e, (SELECT unnest(generate_series({1704067200000 - 6 * HOUR}, {1704067200000 + 40 * 24 * HOUR}, {2 * HOUR})) AS t) g WHERE ts_ns <= g.t * 1000000 AND ts_ns > (g.t - {6 * HOUR}) * 1000000 GROUP BY ALL", options=logs.Options(step_ns=2 * HOUR * 10**6, sliding=True))

    def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = logs.Options(START * 10**6, END * 10**6, 2 * HOUR * 10**6)
        found = logs.stepped(logs.query(entries(spark, sf_dir), f"sum by (event_type) (count_over_time({any_}[6h]))", options), 6 * HOUR * 10**6, options)
        return spread(found, ("event_type",), F.expr("bucket_ns div 1000000").alias("bucket_ms"), "value")

    add("step_expand", expanded, f"{EVENTS} SELECT event_type, bucket_ms + o AS bucket_ms, value FROM ({bucketed('count(*)', 6, where=f'ts_ns >= {START}000000 AND ts_ns < {END}000000')}), (SELECT unnest([0, {2 * HOUR}, {4 * HOUR}]) AS o)")

    def fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = logs.Options(step_ns=6 * HOUR * 10**6)
        found = logs.stepped(logs.query(entries(spark, sf_dir), f"sum by (event_type) (count_over_time({any_}[1h]))", options), HOUR * 10**6, options)
        return spread(found, ("event_type",), F.expr("bucket_ns div 1000000").alias("bucket_ms"), "value")

    add("step_fix", fixed, f"{EVENTS} SELECT event_type, bucket_ms // {6 * HOUR} * {6 * HOUR} AS bucket_ms, arg_min(value, bucket_ms) AS value FROM ({bucketed('count(*)', 1)}) AS b GROUP BY event_type, b.bucket_ms // {6 * HOUR} * {6 * HOUR}")
    at = END * 10**6
    add("instant", lambda s, d: spread(logs.instant(entries(s, d), f"sum by (event_type) (count_over_time({any_}[1h]))", at, 12 * HOUR * 10**6), ("event_type",), "value"),
        f"{EVENTS} SELECT event_type, arg_max(value, bucket_ms) AS value FROM ({bucketed('count(*)', 1, where=f'ts_ns >= {at - 12 * HOUR * 10**6} AND ts_ns < {at}')}) GROUP BY event_type")
    add("vector_constant", lambda s, d: logs.query(entries(s, d), "vector(3)").select("value"), "SELECT CAST(3 AS DOUBLE) AS value")


def _catalog() -> None:
    any_ = '{event_type=~".+"}'
    add("cat_labels", lambda s, d: catalog.label_names(entries(s, d), any_), "SELECT unnest(['event_type', 'user_id']) AS name")
    add("cat_values", lambda s, d: catalog.label_values(entries(s, d), "user_id", '{event_type="error"}'), "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type = 'error'")
    add("cat_series", lambda s, d: spread(catalog.series(entries(s, d), ['{event_type="error"}', '{user_id="7"}']), ("event_type", "user_id")), "SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type = 'error' OR user_id = 7")
    add("cat_detected_labels", lambda s, d: catalog.detected_labels(entries(s, d)), "SELECT 'event_type' AS label, count(DISTINCT event_type) AS cardinality FROM events UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events")
    add("cat_detected_fields", lambda s, d: catalog.detected_fields(entries(s, d)), f"{EVENTS} SELECT 'k' AS field, count(DISTINCT k) AS cardinality, 'number' AS type FROM e")
    add("cat_stats", lambda s, d: catalog.index_stats(entries(s, d), '{event_type="error"}'), f"{EVENTS} SELECT count(DISTINCT user_id) AS streams, count(*) AS entries, CAST(sum(strlen(string)) AS BIGINT) AS bytes FROM e WHERE event_type = 'error'")
    add("cat_volume", lambda s, d: spread(catalog.volume(entries(s, d), any_, ("event_type",)), ("event_type",), "bytes"), f"{EVENTS} SELECT event_type, CAST(sum(strlen(string)) AS BIGINT) AS bytes FROM e GROUP BY ALL")


POINTS = "WITH p AS (SELECT event_type, epoch_ms(ts) AS ts_ms, value AS val, lag(value) OVER w AS prev, lag(epoch_ms(ts)) OVER w AS prev_ts FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts))"
GRID = f"(SELECT unnest(generate_series({START}, {END}, {STEP})) AS t) g"


def prom(name: str, text: str, sql: str, names: tuple[str, ...] = ("event_type",), counters: bool = False, lookback: int = metrics.LOOKBACK_MS) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events")
        points = model.events_counters(events) if counters else model.events_points(events)
        return spread(metrics.query_range(points, text, START, END, STEP, lookback_ms=lookback), names, "ts_ms", F.round("val", 6).alias("val"))

    add(name, run, f"{POINTS} {sql}")


def over(agg: str, range_ms: int = 12 * HOUR, names: str = "event_type") -> str:
    return f"SELECT {names}, t AS ts_ms, round(CAST({agg} AS DOUBLE), 6) AS val FROM p, {GRID} WHERE ts_ms > t - {range_ms} AND ts_ms <= t GROUP BY {names}, t"


def _prom() -> None:
    for fn, agg in {"sum": "sum(val)", "count": "count(val)", "min": "min(val)", "max": "max(val)", "avg": "avg(val)", "last": "arg_max(val, ts_ms)", "first": "arg_min(val, ts_ms)", "present": "1", "stddev": "stddev_pop(val)", "stdvar": "var_pop(val)", "mad": "mad(val)"}.items():
        prom(f"prom_{fn}_over_time", f"{fn}_over_time(event_value[12h])", over(agg))
    prom("prom_quantile_over_time", "quantile_over_time(0.75, event_value[12h])", over("quantile_cont(val, 0.75)"))
    r = 12 * HOUR
    parts = f"""SELECT event_type, t, arg_min(val, ts_ms) AS first, arg_max(val, ts_ms) AS last, count(*) AS n, arg_min(coalesce(prev, 0), ts_ms) AS prev,
      arg_min(coalesce(prev_ts, 0), ts_ms) > t - {r} - 300000 AS early, sum(CASE WHEN prev_ts > t - {r} AND prev > val THEN prev ELSE 0 END) AS lost,
      count(CASE WHEN prev_ts > t - {r} AND prev > val THEN 1 END) AS resets, count(CASE WHEN prev_ts > t - {r} AND prev <> val THEN 1 END) AS changes
      FROM p, {GRID} WHERE ts_ms > t - {r} AND ts_ms <= t GROUP BY event_type, t"""
    rise = "last - CASE WHEN early THEN prev ELSE first END"
    grown = f"{rise} + lost + CASE WHEN early AND prev > first THEN prev ELSE 0 END"
    for fn, value in {"rate": f"({grown}) / 43200.0", "increase": grown, "delta": rise}.items():
        prom(f"prom_{fn}", f"{fn}(event_value[12h])", f"SELECT event_type, t AS ts_ms, round({value}, 6) AS val FROM ({parts}) WHERE early OR n >= 2")
    for fn in ("resets", "changes"):
        prom(f"prom_{fn}", f"{fn}(event_value[12h])", f"SELECT event_type, t AS ts_ms, CAST({fn} AS DOUBLE) AS val FROM ({parts})")
    last = f"SELECT event_type, t AS ts_ms, arg_max(val, p.ts_ms) AS val FROM p, {GRID} WHERE p.ts_ms > t - {HOUR} AND p.ts_ms <= t GROUP BY event_type, t"
    prom("prom_instant", "event_value", last, lookback=HOUR)
    prom("prom_offset", "event_value offset 1h", last.replace("p.ts_ms >", f"p.ts_ms + {HOUR} >").replace("p.ts_ms <=", f"p.ts_ms + {HOUR} <="), lookback=HOUR)
    prom("prom_at", f"event_value @ {END // 1000}", f"SELECT event_type, t AS ts_ms, v AS val FROM (SELECT event_type, arg_max(val, ts_ms) AS v FROM p WHERE ts_ms > {END - HOUR} AND ts_ms <= {END} GROUP BY event_type), {GRID}", lookback=HOUR)
    base = over("sum(val)")
    for fn, agg in {"sum": "sum(val)", "avg": "avg(val)", "min": "min(val)", "max": "max(val)", "count": "count(val)", "group": "1", "stddev": "stddev_pop(val)", "stdvar": "var_pop(val)"}.items():
        prom(f"prom_agg_{fn}", f"{fn}(sum_over_time(event_value[12h]))", f"SELECT CAST(NULL AS VARCHAR) AS event_type, ts_ms, round(CAST({agg} AS DOUBLE), 6) AS val FROM ({base.replace('round(CAST(sum(val) AS DOUBLE), 6)', 'sum(val)')}) GROUP BY ts_ms")
    prom("prom_agg_by", "sum by (event_type) (sum_over_time(event_value[12h]))", base)
    prom("prom_topk", "topk(2, sum_over_time(event_value[12h]))", f"SELECT event_type, ts_ms, val FROM (SELECT *, row_number() OVER (PARTITION BY ts_ms ORDER BY val DESC, event_type) AS k FROM ({base})) WHERE k <= 2")
    prom("prom_bottomk", "bottomk(2, sum_over_time(event_value[12h]))", f"SELECT event_type, ts_ms, val FROM (SELECT *, row_number() OVER (PARTITION BY ts_ms ORDER BY val, event_type) AS k FROM ({base})) WHERE k <= 2")
    prom("prom_quantile", "quantile(0.5, sum_over_time(event_value[12h]))", f"SELECT CAST(NULL AS VARCHAR) AS event_type, ts_ms, quantile_cont(val, 0.5) AS val FROM ({base}) GROUP BY ts_ms")
    prom("prom_count_values", 'count_values("v", count_over_time(event_value[12h]))', f"SELECT CAST(CAST(val AS BIGINT) AS VARCHAR) AS v, ts_ms, CAST(count(*) AS DOUBLE) AS val FROM ({over('count(val)')}) AS b GROUP BY b.val, ts_ms", ("v",))
    prom("prom_bin_on", "sum_over_time(event_value[12h]) / on(event_type) count_over_time(event_value[12h])", over("avg(val)"))
    prom("prom_bin_ignoring", "sum_over_time(event_value[12h]) - ignoring(other) count_over_time(event_value[12h])", over("sum(val) - count(val)"))
    prom("prom_group_left", "sum_over_time(event_value[12h]) / ignoring(event_type) group_left sum(sum_over_time(event_value[12h]))", f"SELECT event_type, ts_ms, round(v / sum(v) OVER (PARTITION BY ts_ms), 6) AS val FROM (SELECT event_type, ts_ms, val AS v FROM ({base.replace('round(CAST(sum(val) AS DOUBLE), 6)', 'sum(val)')}))")
    prom("prom_and", "sum_over_time(event_value[12h]) and (count_over_time(event_value[12h]) > 30)", over("sum(val)") + " HAVING count(val) > 30")
    prom("prom_unless", "sum_over_time(event_value[12h]) unless (count_over_time(event_value[12h]) > 30)", over("sum(val)") + " HAVING count(val) <= 30")
    prom("prom_or", "(sum_over_time(event_value[12h]) > 1000) or count_over_time(event_value[12h])", over("CASE WHEN sum(val) > 1000 THEN sum(val) ELSE count(val) END"))
    prom("prom_bool", "sum_over_time(event_value[12h]) > bool 1000", over("CASE WHEN sum(val) > 1000 THEN 1 ELSE 0 END"))
    prom("prom_filter", "sum_over_time(event_value[12h]) > 1000", over("sum(val)") + " HAVING sum(val) > 1000")
    prom("prom_fn_math", "sqrt(abs(-sum_over_time(event_value[12h])))", over("sqrt(abs(-sum(val)))"))
    prom("prom_fn_clamp", "clamp(sum_over_time(event_value[12h]), 100, 1000)", over("greatest(100, least(1000, sum(val)))"))
    prom("prom_fn_round", "round(sum_over_time(event_value[12h]), 10)", over("floor(sum(val) / 10 + 0.5) * 10"))
    prom("prom_fn_time", "time()", f"SELECT CAST(NULL AS VARCHAR) AS event_type, t AS ts_ms, t / 1000.0 AS val FROM {GRID}")
    prom("prom_fn_hour", "hour()", f"SELECT CAST(NULL AS VARCHAR) AS event_type, t AS ts_ms, CAST(t // {HOUR} % 24 AS DOUBLE) AS val FROM {GRID}")
    prom("prom_fn_label_replace", 'label_replace(count_over_time(event_value[12h]), "short", "$1", "event_type", "(..).*")', over("count(val)").replace("SELECT event_type", "SELECT event_type, left(event_type, 2) AS short", 1), ("event_type", "short"))
    prom("prom_fn_label_join", 'label_join(count_over_time(event_value[12h]), "j", "-", "event_type", "event_type")', over("count(val)").replace("SELECT event_type", "SELECT event_type, event_type || '-' || event_type AS j", 1), ("event_type", "j"))
    prom("prom_fn_absent", 'absent(event_value{event_type="never"})', f"SELECT 'never' AS event_type, t AS ts_ms, CAST(1 AS DOUBLE) AS val FROM {GRID}")
    prom("prom_scalar", "scalar(sum(sum_over_time(event_value[12h]))) * 2", over("sum(val) * 2", names="CAST(NULL AS VARCHAR)").replace("SELECT CAST(NULL AS VARCHAR)", "SELECT CAST(NULL AS VARCHAR) AS event_type", 1))
    prom("prom_deriv", "deriv(event_value[12h])", over("regr_slope(val, (ts_ms - t) / 1000.0)"))
    prom("prom_subquery", "max_over_time(sum_over_time(event_value[6h])[1d:6h])", f"SELECT event_type, g.t AS ts_ms, round(max(v), 6) AS val FROM (SELECT event_type, s, sum(val) AS v FROM p, (SELECT unnest(generate_series({START - 24 * HOUR}, {END}, {6 * HOUR})) AS s) WHERE ts_ms > s - {6 * HOUR} AND ts_ms <= s GROUP BY event_type, s), {GRID} WHERE s > g.t - {24 * HOUR} AND s <= g.t GROUP BY event_type, g.t")
    prom("prom_counter_rate", "sum(increase(events_total[12h]))", f"""SELECT CAST(NULL AS VARCHAR) AS event_type, t AS ts_ms, CAST(sum(last - CASE WHEN early THEN prev ELSE first END) AS DOUBLE) AS val FROM (
      SELECT event_type, t, min(c) AS first, max(c) AS last, min(c) - 1 AS prev, count(*) AS n, arg_min(coalesce(prev_ts, 0), ts_ms) > t - {r} - 300000 AS early
      FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts_ms) AS c FROM p), {GRID} WHERE ts_ms > t - {r} AND ts_ms <= t GROUP BY event_type, t) WHERE early OR n >= 2 GROUP BY t""", counters=True)


SPANS = """WITH s AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, '0' AS span_id, '' AS parent_id, o_orderstatus AS name, o_orderpriority AS service_name, epoch_us(o_orderdate) * 1000 AS ts, 1000000000 AS dur,
    NULL AS returnflag, CAST(NULL AS DOUBLE) AS quantity, o_totalprice AS price FROM orders
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS VARCHAR), '0', l_linestatus, 'lines',
    epoch_us(l_shipdate) * 1000, CAST(l_quantity * 1000000000 AS BIGINT), l_returnflag, l_quantity, NULL FROM lineitem)"""
SUMMARY = "t AS (SELECT trace_id, arg_min(service_name, (ts, span_id)) AS root_service, arg_min(name, (ts, span_id)) AS root_name, min(ts) AS start_ns, (max(ts + dur) - min(ts)) // 1000000 AS duration_ms FROM s GROUP BY trace_id)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.order_spans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def search(name: str, text: str, matched: str, **options: object) -> None:
    columns = ("trace_id", "root_service", "root_name", "start_ns", "duration_ms", "matched")
    add(name, lambda s, d: traces.search(spans(s, d), text, **options).select(*columns), f"{SPANS}, {SUMMARY}, m AS ({matched}) SELECT t.*, least(n, 100) AS matched FROM t JOIN m USING (trace_id)")


def where(test: str, having: str = "") -> str:
    return f"SELECT trace_id, count(*) AS n FROM s WHERE {test} GROUP BY trace_id {having}"


def _traces() -> None:
    search("trace_search_str", '{.returnflag = "R"}', where("returnflag = 'R'"))
    search("trace_search_num", "{.quantity > 45}", where("quantity > 45"))
    search("trace_search_re", '{resource.service.name =~ "^1-.*"}', where("regexp_matches(service_name, '^1-.*')"))
    search("trace_search_dur", "{duration > 49s}", where("dur > 49000000000"))
    search("trace_search_root", '{nestedSetParent < 0 && name = "F"}', where("parent_id = '' AND name = 'F'"))
    search("trace_search_bool", '{(.quantity > 45 || .quantity < 3) && .returnflag != "R"}', where("(quantity > 45 OR quantity < 3) AND returnflag <> 'R'"))
    search("trace_and", '{.quantity > 48} && {name = "F" && .price > 100}', where("(quantity > 48 OR name = 'F' AND price > 100) AND trace_id IN (SELECT trace_id FROM s WHERE quantity > 48) AND trace_id IN (SELECT trace_id FROM s WHERE name = 'F' AND price > 100)"))
    search("trace_and_same_span", '{.quantity > 48} && {.returnflag = "A"}', where("quantity > 48 AND returnflag = 'A'"), same_span=True)
    search("trace_or", '{.quantity > 49} || {.price > 400000}', where("quantity > 49 OR price > 400000"))
    for fn, agg in {"count": ("count()", "count(*)", "3"), "sum": ("sum(.quantity)", "sum(quantity)", "150"), "avg": ("avg(.quantity)", "avg(quantity)", "40"), "min": ("min(duration)", "min(dur)", "30s"), "max": ("max(.quantity)", "max(quantity)", "48")}.items():
        bound = "30000000000" if agg[2].endswith("s") else agg[2]
        search(f"trace_{fn}", f"{{.quantity > 0}} | {agg[0]} > {agg[2]}", where("quantity > 0", f"HAVING {agg[1]} > {bound}"))
    roots = "SELECT trace_id FROM s WHERE parent_id = '' AND name = 'F'"
    search("trace_child", '{name = "F" && nestedSetParent < 0} > {.quantity > 45}', where(f"quantity > 45 AND trace_id IN ({roots})"))
    search("trace_desc", '{name = "F" && nestedSetParent < 0} >> {.quantity > 45}', where(f"quantity > 45 AND trace_id IN ({roots})"))
    search("trace_parent", '{.quantity > 45} < {name = "F" && nestedSetParent < 0}', where("parent_id = '' AND name = 'F' AND trace_id IN (SELECT trace_id FROM s WHERE quantity > 45)"))
    search("trace_not_child", '{name = "F" && nestedSetParent < 0} !> {.quantity > 45}', where(f"quantity > 45 AND trace_id NOT IN ({roots})"))
    search("trace_sibling", '{.quantity > 49} ~ {.quantity < 2}', where("quantity < 2 AND trace_id IN (SELECT trace_id FROM s WHERE quantity > 49)"))
    add("trace_summary", lambda s, d: traces.summaries(spans(s, d)), f"{SPANS}, {SUMMARY} SELECT * FROM t")
    add("trace_by_id", lambda s, d: traces.by_id(spans(s, d), "7").select("span_id", "name", "timestamp_ns", "duration_ns"), f"{SPANS} SELECT span_id, name, ts AS timestamp_ns, dur AS duration_ns FROM s WHERE trace_id = '7'")
    add("tags", lambda s, d: traces.tags(spans(s, d), "{.quantity > 10}"), "SELECT unnest(['returnflag', 'quantity', 'partkey']) AS tag")
    add("tag_values", lambda s, d: traces.tag_values(spans(s, d), "returnflag", "{.quantity > 10}"), "SELECT DISTINCT l_returnflag AS value FROM lineitem WHERE l_quantity > 10")
    add("tag_search", lambda s, d: traces.tag_search(spans(s, d), {"returnflag": "~[AR]", "quantity": "45.0"}, 10**9).select("trace_id", "span_id"), f"{SPANS} SELECT trace_id, span_id FROM s WHERE returnflag IN ('A', 'R') AND quantity = 45")
    day, low, high = 86400 * 10**9, 694224000 * 10**9, 1136073600 * 10**9
    month = 30 * day

    def span_metric(name: str, text: str, sql: str, columns: tuple[str, ...] = ("returnflag",), step: int | None = month) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = traces.metrics(spans(spark, sf_dir), text, low, high, step)
            return found.select(*columns, *(["ts_ns"] if step else []), F.round("value", 6).alias("value"))

        add(name, run, f"{SPANS} {sql}")

    def stepped(agg: str, extra: str = "returnflag", test: str = "quantity > 10") -> str:
        return f"SELECT {extra}, ts // {month} * {month} AS ts_ns, round(CAST({agg} AS DOUBLE), 6) AS value FROM s WHERE {test} AND ts >= {low} AND ts < {high} GROUP BY ALL"

    for fn, (call, agg) in {"rate": ("rate()", f"count(*) / {month / 10**9}"), "count": ("count_over_time()", "count(*)"), "avg": ("avg_over_time(duration)", "avg(dur / 1e9)"), "min": ("min_over_time(duration)", "min(dur / 1e9)"), "max": ("max_over_time(duration)", "max(dur / 1e9)"), "sum": ("sum_over_time(.quantity)", "sum(quantity)"), "quantile": ("quantile_over_time(duration, 0.9)", "quantile_cont(dur / 1e9, 0.9)")}.items():
        span_metric(f"span_{fn}", f"{{.quantity > 10}} | {call} by (.returnflag)", stepped(agg))
    span_metric("span_histogram", "{.quantity > 10} | histogram_over_time(duration)", stepped("count(*)", "CAST(pow(2, ceil(log2(dur))) AS BIGINT) AS bucket"), ("bucket",))
    span_metric("span_by", "{.quantity > 10} | count_over_time() by (.returnflag, name)", stepped("count(*)", "returnflag, name"), ("returnflag", "name"))
    span_metric("span_instant", "{.quantity > 10} | count_over_time() by (.returnflag)", f"SELECT returnflag, CAST(count(*) AS DOUBLE) AS value FROM s WHERE quantity > 10 AND ts >= {low} AND ts < {high} GROUP BY ALL", step=None)
    add("span_exemplar", lambda s, d: traces.exemplars(spans(s, d), "{.quantity > 10} | rate() by (.returnflag)", low, high, month).select("returnflag", "ts_ns", "trace_id", "span_id"),
        f"{SPANS} SELECT returnflag, ts // {month} * {month} AS ts_ns, arg_min(trace_id, (ts, trace_id, span_id)) AS trace_id, arg_min(span_id, (ts, trace_id, span_id)) AS span_id FROM s WHERE quantity > 10 AND ts >= {low} AND ts < {high} GROUP BY ALL")
    pairs = "SELECT quantity > 25 AS c, 'returnflag' AS key, returnflag AS val FROM s WHERE quantity > 0 UNION ALL SELECT quantity > 25, 'quantity', CAST(quantity AS VARCHAR) FROM s WHERE quantity > 0"
    add("span_compare", lambda s, d: traces.compare(spans(s, d), "{.quantity > 0} | compare({.quantity > 25}, 3)").where("key <> 'partkey'"),
        f"{SPANS} SELECT key, val, selection, baseline FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY selection + baseline DESC, val) AS p FROM (SELECT key, val, count(*) FILTER (c) AS selection, count(*) FILTER (NOT c) AS baseline FROM ({pairs}) GROUP BY ALL)) WHERE p <= 3")
    partkeys = "SELECT l_quantity > 25, 'partkey', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity > 0"
    add("span_compare_all", lambda s, d: traces.compare(spans(s, d), "{.quantity > 0} | compare({.quantity > 25}, 3)"),
        f"{SPANS} SELECT key, val, selection, baseline FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY selection + baseline DESC, val) AS p FROM (SELECT key, val, count(*) FILTER (c) AS selection, count(*) FILTER (NOT c) AS baseline FROM ({pairs} UNION ALL {partkeys}) GROUP BY ALL)) WHERE p <= 3")


def part_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile rows: part type, brand and first name word as a stack, the quantity sold as value."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.select(
        F.lit("process_cpu:cpu:nanoseconds:cpu:nanoseconds").alias("type_id"), F.col("l_returnflag").alias("service_name"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("timestamp_ns"),
        F.create_map(F.lit("status"), F.col("l_linestatus"), F.lit("mode"), F.col("p_type")).alias("labels"), F.array("p_type", "p_brand", F.split("p_name", " ")[0]).alias("stack"), F.col("l_quantity").cast("long").alias("value"),
    )


PROFILES = "WITH r AS (SELECT l_returnflag AS service, l_linestatus AS status, p_type AS a, p_type || ';' || p_brand AS b, p_type || ';' || p_brand || ';' || split_part(p_name, ' ', 1) AS c, CAST(l_quantity AS BIGINT) AS v, epoch_us(l_shipdate) * 1000 AS ts FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _tree(test: str) -> str:
    return f"SELECT path, depth, CAST(sum(self) AS BIGINT) AS self, CAST(sum(v) AS BIGINT) AS total FROM (SELECT a AS path, 1 AS depth, 0 AS self, v FROM r WHERE {test} UNION ALL SELECT b, 2, 0, v FROM r WHERE {test} UNION ALL SELECT c, 3, v, v FROM r WHERE {test}) GROUP BY ALL"


def _profiles() -> None:
    cpu = '{__name__="process_cpu"'
    add("prof_types", lambda s, d: profiles.types(part_profiles(s, d)), "SELECT 'process_cpu:cpu:nanoseconds:cpu:nanoseconds' AS type_id")
    add("prof_labels", lambda s, d: profiles.label_names(part_profiles(s, d)), "SELECT unnest(['status', 'mode']) AS name")
    add("prof_values", lambda s, d: profiles.label_values(part_profiles(s, d), "status"), "SELECT DISTINCT l_linestatus AS value FROM lineitem")
    add("prof_series", lambda s, d: spread(profiles.series(part_profiles(s, d), cpu + ', service_name="R"}'), ("status", "mode"), "service_name"), "SELECT DISTINCT l_linestatus AS status, p_type AS mode, l_returnflag AS service_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'")
    step = 30 * 86400 * 10**9
    for kind, agg in {"sum": "sum(v)", "avg": "avg(v)"}.items():
        add(f"prof_select_{kind}", lambda s, d, kind=kind: spread(profiles.select_series(part_profiles(s, d), cpu + "}", step, ("status",), kind == "avg"), ("status",), "ts_ns", F.round("value", 6).alias("value")), f"{PROFILES} SELECT status, ts // {step} * {step} AS ts_ns, round(CAST({agg} AS DOUBLE), 6) AS value FROM r GROUP BY ALL")
    add("prof_merge_tree", lambda s, d: profiles.merged_tree(part_profiles(s, d), cpu + ', service_name="R"}'), PROFILES + " " + _tree("service = 'R'"))
    a, b = _tree("service = 'R'"), _tree("service = 'A'")
    add("prof_diff", lambda s, d: profiles.diff_tree(part_profiles(s, d), cpu + ', service_name="R"}', cpu + ', service_name="A"}'), f"{PROFILES} SELECT coalesce(x.path, y.path) AS path, coalesce(x.self, 0) AS left_self, coalesce(x.total, 0) AS left_total, coalesce(y.self, 0) AS right_self, coalesce(y.total, 0) AS right_total FROM ({a}) x FULL JOIN ({b}) y ON x.path = y.path")


def _rollup() -> None:
    any_ = '{event_type=~".+"}'
    add("rollup_15s", lambda s, d: spread(rollup.rollup(entries(s, d)), ("event_type", "user_id"), "timestamp_ns", "last", "last_ts", "max", "min", "count", F.round("sum", 6).alias("sum"), "bytes"),
        f"{EVENTS} SELECT event_type, user_id, ts_ns // 15000000000 * 15000000000 AS timestamp_ns, arg_max(value, (ts_ns, string)) AS last, max(ts_ns) AS last_ts, max(value) AS max, min(value) AS min, count(*) AS count, round(sum(value), 6) AS sum, CAST(sum(strlen(string)) AS DOUBLE) AS bytes FROM e GROUP BY ALL")
    text = f"sum by (event_type) (rate({any_}[6h]))"
    add("rollup_rate", lambda s, d: spread(rollup.shortcut(rollup.rollup(entries(s, d)), text), ("event_type",), F.expr("bucket_ns div 1000000").alias("bucket_ms"), F.round("value", 6).alias("value")), f"{EVENTS} {bucketed('count(*) / 21600.0', 6)}")
    add("rule_record", lambda s, d: spread(rollup.record(entries(s, d), "events:rate", text, {"team": "a"}), ("__name__", "team", "event_type"), "ts_ms", F.round("val", 6).alias("val")),
        f"{EVENTS} SELECT 'events:rate' AS __name__, 'a' AS team, event_type, bucket_ms AS ts_ms, value AS val FROM ({bucketed('count(*) / 21600.0', 6)})")


for _section in (_logs, _metrics, _catalog, _prom, _traces, _profiles, _rollup):
    _section()
