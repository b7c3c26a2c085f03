"""Which reader a body goes to: by path and content type, as an ingest endpoint would choose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from obsidra.plans.lexing import QueryError
from obsidra.sources import decoders, wire

# Ingest paths and content types (a prefix of them; "" for any), each with its reader.
READERS: tuple[tuple[str, str, Callable[[DataFrame], DataFrame]], ...] = (
    ("/loki/api/v1/push", "application/x-protobuf", wire.log_push),
    ("/loki/api/v1/push", "", decoders.log_push),
    ("/api/v1/prom/remote/write", "", wire.remote_write),
    ("/api/v1/write", "", wire.remote_write),
    ("/influx/api/v2/write", "", lambda raw: decoders.influx_lines(decoders.lines_of(raw).withColumnRenamed("body", "value"))),
    ("/api/v2/logs", "", decoders.datadog_logs),
    ("/api/v2/series", "", decoders.datadog_metrics),
    ("/cf/v1/insert", "", lambda raw: decoders.cloudflare_logs(decoders.lines_of(raw))),
    ("/_bulk", "", decoders.elastic_bulk),
    ("/v1/logs", "application/json", decoders.otlp_logs),
    ("/v1/logs", "", wire.otlp_logs),
    ("/v1/traces", "application/json", decoders.otlp_traces),
    ("/v1/traces", "", wire.otlp_traces),
    ("/v1development/profiles", "", wire.otlp_profiles),
    ("/api/v2/spans", "application/x-ndjson", lambda raw: decoders.zipkin(decoders.lines_of(raw))),
    ("/api/v2/spans", "", decoders.zipkin),
    ("/ingest", "", wire.pprof),
)


def reader(path: str, content_type: str = "") -> Callable[[DataFrame], DataFrame]:
    """The reader of bodies (column ``body``) that come to a path."""
    for ends, kind, found in READERS:
        if path.rstrip("/").endswith(ends) and content_type.startswith(kind):
            return found
    raise QueryError(f"no reader for {path} {content_type}")
