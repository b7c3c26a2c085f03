"""Readers of ingest formats, as column pipelines: each gives entries (timestamp_ns, labels, string, value) or spans.

Of labels with one name, whatever they were called before they were made plain, the last counts. Protobuf bodies are in
``wire``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidra.functions.labels import last_wins, number, pair, sanitized

# Labels that name a service; of those that are there, the last.
SERVICE_LABELS = (
    "service", "app", "application", "app_name", "name", "app_kubernetes_io_name", "container", "container_name", "k8s_container_name", "component",
    "workload", "job", "k8s_job_name",
)
# Span attributes that name a service, in the order they are tried.
SPAN_SERVICE = ("peer.service", "service.name", "faas.name", "k8s.deployment.name", "process.executable.name")
MOST_BYTES = 100
TEXT = "map<string,string>"
ENTRY_COLUMNS = ("timestamp_ns", "labels", "string", "value")
SPAN_COLUMNS = ("trace_id", "span_id", "parent_id", "name", "service_name", "timestamp_ns", "duration_ns", "attrs")


def _none(kind: str) -> Column:
    return F.expr(f"cast({'map' if kind.startswith('map') else 'array'}() as {kind})")


def map_of(keys: Column, values: Column) -> Column:
    """A map of two equally long arrays; of equal keys the last counts."""
    return last_wins(F.transform(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda p: pair(p["key"], p["value"])))


def over(base: Column, more: Column) -> Column:
    """``base`` with the entries of ``more``, which win."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more)


def tidy(labels: Column) -> Column:
    """Label names made plain, long values cut, and service_name filled in."""
    cut = lambda v: F.when(F.octet_length(v) > MOST_BYTES, F.concat(F.substring(v, 1, MOST_BYTES), F.lit("..."))).otherwise(v)
    pairs = F.transform(F.map_entries(F.coalesce(labels, _none(TEXT))), lambda e: pair(sanitized(e["key"]), cut(e["value"])))
    plain = last_wins(pairs)
    named = F.coalesce(F.try_element_at(F.filter(pairs, lambda e: e["key"].isin(*SERVICE_LABELS)), F.lit(-1))["value"], F.lit("unknown"))
    return F.when(F.map_contains_key(plain, "service_name") | (named == ""), plain).otherwise(F.map_concat(plain, F.create_map(F.lit("service_name"), named)))


def service_of(attributes: Column) -> Column:
    """The service that attributes name, or "unknown"."""
    return F.coalesce(*[attributes[n] for n in SPAN_SERVICE], F.lit("unknown"))


def lines_of(raw: DataFrame) -> DataFrame:
    """The lines of bodies that hold several, with all other columns."""
    return raw.withColumn("body", F.explode(F.split("body", "\r?\n"))).where("trim(body) <> ''")


def _entries(df: DataFrame, stamp: Column | str, labels: Column, line: Column | str, value: Column | None = None) -> DataFrame:
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(of(stamp).alias("timestamp_ns"), labels.alias("labels"), of(line).alias("string"), (F.lit(0.0) if value is None else value).alias("value"))


def log_push(raw: DataFrame) -> DataFrame:
    """Log push JSON in column ``body``, with values or with entries; a third element of a value is a number."""
    stream = "struct<stream:map<string,string>,labels:string,values:array<array<string>>,entries:array<struct<ts:string,line:string,value:double>>>"
    one = raw.select(F.explode(F.from_json("body", f"streams array<{stream}>")["streams"]).alias("s"))
    pattern = r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'
    keys, values = (F.regexp_extract_all("s.labels", F.lit(pattern), F.lit(k)) for k in (1, 2))
    plain = F.transform(values, lambda v: F.regexp_replace(v, r'\\(["\\])', "$1"))
    labels = tidy(F.coalesce(F.col("s.stream"), map_of(keys, plain)))
    stamp = F.coalesce(F.col("v.ts").try_cast("long"), F.unix_micros(F.col("v.ts").try_cast("timestamp")) * 1000)
    from_values = F.transform("s.values", lambda v: F.struct(v[0].alias("ts"), v[1].alias("line"), number(F.get(v, F.lit(2))).alias("value")))
    rows = one.withColumn("labels", labels).withColumn("v", F.explode(F.coalesce(from_values, F.col("s.entries"))))
    return _entries(rows, stamp, F.col("labels"), "v.line", F.coalesce("v.value", F.lit(0.0)))


_ESCAPED = r"(?:[^\\,= ]|\\.)+"


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([,= \\])", "$1")


def influx_lines(raw: DataFrame, precision_ns: int = 1) -> DataFrame:
    """Line protocol in column ``value``: a message field makes a log line, the other fields written behind it; otherwise
    each numeric field is a metric. A line without a time takes column ``received_ns``, or the time at which it is read;
    lines that can't be read raise, but for blank ones and comments."""
    received = F.col("received_ns") if "received_ns" in raw.columns else F.unix_micros(F.current_timestamp()) * 1000
    text = F.trim(F.col("value"))
    raw = raw.select(text.alias("value"), received.alias("received_ns")).where("value <> '' AND value NOT LIKE '#%'")
    value = r'"(?:[^"\\]|\\.)*"|[^\s,"]+'
    shape = rf"^({_ESCAPED.replace('=', '')})((?:,{_ESCAPED}={_ESCAPED})*) +({_ESCAPED}=(?:{value})(?:,{_ESCAPED}=(?:{value}))*)(?: +(-?\d+))?$"
    part = lambda k: F.regexp_extract("value", shape, k)
    bad = F.raise_error(F.concat(F.lit("can't read the line "), F.col("value"))).cast("boolean")
    raw = raw.where(F.when(part(1) != "", F.lit(True)).otherwise(bad))
    measurement = _unescaped(part(1))
    pairs = lambda k, one: map_of(F.transform(F.regexp_extract_all(part(k), F.lit(one), F.lit(1)), _unescaped), F.regexp_extract_all(part(k), F.lit(one), F.lit(2)))
    tags = F.transform_values(pairs(2, rf"({_ESCAPED})=({_ESCAPED})"), lambda _, v: _unescaped(v))
    stamp = F.coalesce(part(4).try_cast("long") * precision_ns, F.col("received_ns"))
    df = raw.select(measurement.alias("measurement"), tags.alias("tags"), pairs(3, rf"({_ESCAPED})=({value})").alias("fields"), stamp.alias("timestamp_ns"))
    df = df.withColumn("labels", over(F.create_map(F.lit("measurement"), F.col("measurement")), F.col("tags")))
    bare = lambda v: F.regexp_replace(F.regexp_replace(v, '^"|"$', ""), r'\\(["\\])', "$1")
    shown = lambda v: F.when(v.rlike(r'[\s="]') | (v == ""), F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(v)
    rest = F.transform(F.filter(F.map_entries("fields"), lambda e: e["key"] != "message"), lambda e: F.concat(e["key"], F.lit("="), shown(bare(e["value"]))))
    message = F.concat(F.lit("message="), shown(bare(F.col("fields")["message"])))
    logs = _entries(df.where(F.map_contains_key("fields", "message")), "timestamp_ns", tidy(F.col("labels")), F.array_join(F.concat(F.array(message), F.array_sort(rest)), " "))
    points = df.where(~F.map_contains_key("fields", "message")).select("timestamp_ns", "labels", F.explode("fields").alias("field", "text"))
    figure = F.coalesce(number(F.regexp_replace("text", "[iu]$", "")), F.when(F.lower("text").isin("t", "true"), 1.0).when(F.lower("text").isin("f", "false"), 0.0))
    points = points.withColumn("figure", figure).where(F.col("figure").isNotNull())
    labels = tidy(over(F.col("labels"), F.create_map(F.lit("__name__"), F.col("field"))))
    return logs.unionByName(_entries(points, "timestamp_ns", labels, F.lit(""), F.col("figure")))


def datadog_logs(raw: DataFrame) -> DataFrame:
    """Datadog log JSON (an array) in column ``body``; tags k:v become labels. Needs column ``received_ns``."""
    item = F.explode(F.from_json("body", "array<struct<ddsource:string,ddtags:string,hostname:string,message:string,service:string>>")).alias("x")
    df = raw.select("received_ns", item)
    tag, source = F.lit(r"([^,:\s]+):([^,]*)"), F.coalesce("x.ddtags", F.lit(""))
    tags = map_of(F.regexp_extract_all(source, tag, F.lit(1)), F.regexp_extract_all(source, tag, F.lit(2)))
    own = F.map_filter(F.create_map(F.lit("ddsource"), F.col("x.ddsource"), F.lit("hostname"), F.col("x.hostname"), F.lit("service"), F.col("x.service")), lambda _, v: v.isNotNull())
    return _entries(df, "received_ns", tidy(over(tags, own)), "x.message")


def datadog_metrics(raw: DataFrame) -> DataFrame:
    """Datadog series JSON in column ``body``: points in seconds."""
    series = "series array<struct<metric:string,points:array<struct<timestamp:long,value:double>>,resources:array<struct<name:string,type:string>>>>"
    df = raw.select(F.explode(F.from_json("body", series)["series"]).alias("s"))
    none = _none("array<struct<name:string,type:string>>")
    resources = last_wins(F.transform(F.coalesce("s.resources", none), lambda r: pair(F.concat(F.lit("resource_"), r["type"]), r["name"])))
    labels = tidy(over(F.create_map(F.lit("__name__"), F.col("s.metric")), resources))
    rows = df.select(labels.alias("labels"), F.explode("s.points").alias("p"))
    return _entries(rows, F.col("p.timestamp") * 10**9, F.col("labels"), F.lit(""), F.col("p.value"))


def cloudflare_logs(raw: DataFrame, source: str = "") -> DataFrame:
    """Worker and audit log lines, one JSON object each, in column ``body`` (bodies of several lines: ``lines_of``). Their
    time is EventTimestampMs or, in nanoseconds, When; else column ``received_ns``."""
    names = ("ScriptName", "Outcome", "EventType", "ActionResult", "ActionType", "ActorType", "ResourceType")
    shape = ", ".join([*(f"{n} string" for n in names), "EventTimestampMs long", "When long"])
    df = raw.withColumn("x", F.from_json("body", shape))
    pairs = [F.lit("ddsource"), F.lit(source)] + [c for n in names for c in (F.lit(n), F.col(f"x.{n}"))]
    labels = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))
    stamp = F.coalesce(F.nullif(F.col("x.EventTimestampMs") * 10**6, F.lit(0)), F.nullif(F.col("x.When"), F.lit(0)), F.col("received_ns"))
    return _entries(df, stamp, tidy(labels), "body")


def elastic_documents(raw: DataFrame, index: str) -> DataFrame:
    """Documents in column ``body``, each a log line. Needs columns ``id`` and ``received_ns``."""
    labels = F.create_map(F.lit("type"), F.lit("elastic"), F.lit("_index"), F.lit(index), F.lit("_id"), F.col("id").cast("string"))
    return _entries(raw, "received_ns", tidy(F.map_filter(labels, lambda _, v: v.isNotNull())), "body")


def elastic_bulk(raw: DataFrame, index: str = "") -> DataFrame:
    """Bulk bodies in column ``body``: lines of actions, each followed by its document; an index or create action's text
    fields are the document's labels, documents of other actions are left out. Needs column ``received_ns``."""
    kinds = ("index", "create", "delete", "update")
    lines = F.filter(F.split("body", "\r?\n"), lambda x: F.trim(x) != "")
    action = lambda x: F.from_json(x, ", ".join(f"`{k}` map<string,string>" for k in kinds))
    is_action = lambda a: F.coalesce(*[a[k] for k in kinds]).isNotNull()
    # A document belongs to the action before it; a delete has none.
    pairs = F.transform(lines, lambda x, i: F.struct(x.alias("line"), action(x).alias("own"), action(F.get(lines, i - 1)).alias("before")))
    rows = raw.select("received_ns", F.explode(pairs).alias("p")).select("received_ns", "p.*")
    made = F.coalesce(F.col("before.index"), F.col("before.create"))
    rows = rows.where(~is_action(F.col("own")) & made.isNotNull())
    fixed = F.create_map(*[F.lit(x) for pair in [("type", "elastic"), *([("_index", index)] if index else [])] for x in pair])
    return _entries(rows, "received_ns", tidy(over(F.map_filter(made, lambda _, v: v.isNotNull()), fixed)), "line")


_SCALAR = "stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string,arrayValue:string,kvlistValue:string"
_VALUE = f"struct<{_SCALAR}>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"


def _value(v: Column) -> Column:
    """An attribute's value as text; lists and maps as the JSON they came as."""
    return F.coalesce(
        v["stringValue"], v["intValue"], F.regexp_replace(v["doubleValue"].cast("string"), r"\.0$", ""), v["boolValue"].cast("string"), v["bytesValue"], v["arrayValue"], v["kvlistValue"]
    )


def _attributes(items: Column) -> Column:
    """OTLP attributes to a map of text."""
    pairs = F.transform(F.coalesce(items, _none(_ATTRS)), lambda a: pair(a["key"], _value(a["value"])))
    return last_wins(F.filter(pairs, lambda p: p["value"].isNotNull()))


def _records(raw: DataFrame, kind: str, record: str) -> DataFrame:
    """(base, scope, x): resource and scope attributes and each record of OTLP JSON in column ``body``."""
    scopes, rows = f"scope{kind}", {"Logs": "logRecords", "Spans": "spans"}[kind]
    shape = f"resource{kind} array<struct<resource:struct<attributes:{_ATTRS}>,{scopes}:array<struct<scope:struct<name:string,attributes:{_ATTRS}>,{rows}:array<{record}>>>>>"
    df = raw.select(F.explode(F.from_json("body", shape)[f"resource{kind}"]).alias("r"))
    df = df.select(_attributes(F.col("r.resource.attributes")).alias("base"), F.explode(f"r.{scopes}").alias("s"))
    return df.select("base", _attributes(F.col("s.scope.attributes")).alias("scope"), F.explode(f"s.{rows}").alias("x"))


def otlp_logs(raw: DataFrame) -> DataFrame:
    """OTLP log JSON in column ``body``; resource, scope and record attributes are labels, later ones winning."""
    record = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityText:string,traceId:string,spanId:string,body:{_VALUE},attributes:{_ATTRS}>"
    df = _records(raw, "Logs", record)
    more = F.map_filter(F.create_map(F.lit("level"), F.col("x.severityText"), F.lit("trace_id"), F.col("x.traceId"), F.lit("span_id"), F.col("x.spanId")), lambda _, v: v.isNotNull() & (v != ""))
    labels = tidy(over(over(over(F.col("base"), F.col("scope")), _attributes(F.col("x.attributes"))), more))
    stamp = F.coalesce(F.nullif(F.col("x.timeUnixNano").try_cast("long"), F.lit(0)), F.col("x.observedTimeUnixNano").try_cast("long"))
    return _entries(df, stamp, labels, F.coalesce(_value(F.col("x.body")), F.lit("")))


def otlp_traces(raw: DataFrame) -> DataFrame:
    """OTLP span JSON in column ``body`` to spans."""
    span = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},status:struct<code:string>>"
    df = _records(raw, "Spans", span)
    own = F.map_filter(F.create_map(F.lit("name"), F.col("x.name"), F.lit("kind"), F.col("x.kind"), F.lit("status"), F.col("x.status.code")), lambda _, v: v.isNotNull())
    attrs = over(over(F.col("base"), _attributes(F.col("x.attributes"))), own)
    start, end = F.col("x.startTimeUnixNano").try_cast("long"), F.col("x.endTimeUnixNano").try_cast("long")
    return df.select(
        F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"), F.lower(F.coalesce("x.parentSpanId", F.lit(""))).alias("parent_id"), F.col("x.name").alias("name"),
        service_of(attrs).alias("service_name"), start.alias("timestamp_ns"), (end - start).alias("duration_ns"), attrs.alias("attrs"),
    )


def zipkin(raw: DataFrame) -> DataFrame:
    """Zipkin v2 JSON in column ``body`` to spans: an array, or an object (NDJSON: ``lines_of``); microseconds, padded ids."""
    ends = "struct<serviceName:string,ipv4:string,ipv6:string,port:int>"
    shape = f"array<struct<traceId:string,id:string,parentId:string,name:string,kind:string,timestamp:string,duration:string,localEndpoint:{ends},remoteEndpoint:{ends},tags:map<string,string>>>"
    body = F.when(F.col("body").rlike(r"^\s*\{"), F.concat(F.lit("["), F.col("body"), F.lit("]"))).otherwise(F.col("body"))
    df = raw.select(F.explode(F.from_json(body, shape)).alias("x"))
    named = {"name": "x.name", "kind": "x.kind", "service.name": "x.localEndpoint.serviceName", "remoteService.name": "x.remoteEndpoint.serviceName"}
    for side in ("local", "remote"):
        named |= {f"{side}Endpoint.{part}": f"x.{side}Endpoint.{part}" for part in ("ipv4", "ipv6", "port")}
    own = F.map_filter(F.create_map(*[c for k, v in named.items() for c in (F.lit(k), F.col(v).cast("string"))]), lambda _, v: v.isNotNull())
    attrs = over(F.coalesce(F.col("x.tags"), _none(TEXT)), own)
    failed = F.when(F.map_contains_key(attrs, "error"), over(attrs, F.create_map(F.lit("status"), F.lit("STATUS_CODE_ERROR")))).otherwise(attrs)
    pad = lambda c, n: F.lower(F.lpad(c, n, "0"))
    ns = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0)) * 1000
    return df.select(
        pad(F.col("x.traceId"), 32).alias("trace_id"), pad(F.col("x.id"), 16).alias("span_id"), F.coalesce(pad(F.col("x.parentId"), 16), F.lit("")).alias("parent_id"), F.col("x.name").alias("name"),
        F.coalesce("x.localEndpoint.serviceName", F.lit("unknown")).alias("service_name"), ns("x.timestamp").alias("timestamp_ns"), ns("x.duration").alias("duration_ns"), failed.alias("attrs"),
    )
