"""Protobuf bodies: log push, remote write, OTLP logs, traces and profiles, pprof; read by Arrow batches.

A body is a message in the public wire format. ``fields`` walks one message; the readers below pick the fields they need
by number and give rows. Bodies may be packed with raw snappy or gzip. A body that can't be read raises, unless
``on_error`` is "skip".
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidra.sources.decoders import ENTRY_COLUMNS, SPAN_COLUMNS, service_of, tidy

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def varint(raw: memoryview | bytes, at: int) -> tuple[int, int]:
    """The number at ``at``, and where the next field begins."""
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a number of over 64 bits")


def fields(raw: memoryview | bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of each field: an int, eight or four bytes, or a view of a nested field."""
    raw, at = memoryview(raw), 0
    while at < len(raw):
        tag, at = varint(raw, at)
        kind = tag & 7
        if kind == VARINT:
            value, at = varint(raw, at)
        elif kind == BYTES:
            size, at = varint(raw, at)
            value, at = raw[at : at + size], at + size
        elif kind in (FIXED64, FIXED32):
            size = 8 if kind == FIXED64 else 4
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        if at > len(raw):
            raise ValueError("a field goes beyond its message")
        yield tag >> 3, kind, value


def grouped(raw: memoryview | bytes) -> dict[int, list]:
    """All fields by number, in order."""
    out: dict[int, list] = {}
    for number, _, value in fields(raw):
        out.setdefault(number, []).append(value)
    return out


def text(value: object) -> str:
    return bytes(value).decode("utf-8", "replace")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def double(value: object) -> float:
    return struct.unpack("<d", value)[0]


def fixed(value: object) -> int:
    return int.from_bytes(value, "little")


def numbers(values: list) -> list[int]:
    """A repeated number, packed or not."""
    out: list[int] = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
        else:
            at = 0
            while at < len(v):
                x, at = varint(v, at)
                out.append(x)
    return out


def message(*pairs: tuple[int, object]) -> bytes:
    """A message of (number, value) fields: an int, a float, text, bytes; the inverse of ``fields``."""

    def number(x: int) -> bytes:
        out, x = bytearray(), x & ((1 << 64) - 1)
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes(out) + bytes([x])

    out = b""
    for n, v in pairs:
        if isinstance(v, bool | int):
            out += number(n << 3 | VARINT) + number(int(v))
        elif isinstance(v, float):
            out += number(n << 3 | FIXED64) + struct.pack("<d", v)
        else:
            raw = v.encode() if isinstance(v, str) else bytes(v)
            out += number(n << 3 | BYTES) + number(len(raw)) + raw
    return out


def unpacked(body: bytes, packing: str | None) -> bytes:
    """``packing``: None, "snappy" (raw blocks), "gzip", or "auto", which tells gzip by its first bytes."""
    if packing == "snappy":
        size, _ = varint(body, 0)
        return pa.decompress(body, decompressed_size=size, codec="snappy", asbytes=True)
    if packing == "gzip" or packing == "auto" and body[:2] == b"\x1f\x8b":
        return gzip.decompress(body)
    return body


def _read(raw: DataFrame, schema: str, rows: Callable[[bytes], Iterator[tuple]], packing: str | None, on_error: str) -> DataFrame:
    """``rows`` of each body in column ``body``. Bodies are as large as a request; a task holds one batch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                if not body.is_valid:
                    continue
                try:
                    found = list(rows(unpacked(body.as_py(), packing)))
                except (ValueError, IndexError, struct.error, OSError):
                    if on_error == "skip":
                        continue
                    raise
                for at in range(0, len(found), 10_000):
                    columns = list(zip(*found[at : at + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    shape = raw.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)
    names, kinds = arrow.names, arrow.types
    return raw.select("body").mapInArrow(run, shape)


_ENTRIES = "timestamp_ns long, labels map<string,string>, string string, value double"


def _label_text(source: str) -> dict[str, str]:
    """Labels written as {a="b", c="d"}."""
    from obsidra.plans.lexing import Cursor
    from obsidra.plans.logql import matchers

    return {m.name: m.value for m in matchers(Cursor(source))}


def log_push(raw: DataFrame, packing: str | None = "snappy", on_error: str = "raise") -> DataFrame:
    """Log push bodies: streams with labels as text, each with entries; structured metadata joins the labels."""

    def rows(body: bytes) -> Iterator[tuple]:
        for stream in grouped(body).get(1, []):
            own = grouped(stream)
            labels = _label_text(text(own[1][0])) if 1 in own else {}
            for entry in own.get(2, []):
                e = grouped(entry)
                stamp = grouped(e[1][0]) if 1 in e else {}
                more = {text(p[1][0]): text(p[2][0]) for p in map(grouped, e.get(3, [])) if 1 in p and 2 in p}
                ns = signed(stamp.get(1, [0])[0]) * 10**9 + signed(stamp.get(2, [0])[0])
                yield ns, list((labels | more).items()), text(e[2][0]) if 2 in e else "", 0.0

    return _read(raw, _ENTRIES, rows, packing, on_error).withColumn("labels", tidy(F.col("labels"))).select(*ENTRY_COLUMNS)


def remote_write(raw: DataFrame, packing: str | None = "snappy", on_error: str = "raise") -> DataFrame:
    """Remote write bodies: a row per series and sample, milliseconds made nanoseconds."""

    def rows(body: bytes) -> Iterator[tuple]:
        for series in grouped(body).get(1, []):
            own = grouped(series)
            labels = {text(p[1][0]): text(p.get(2, [b""])[0]) for p in map(grouped, own.get(1, [])) if 1 in p}
            for sample in own.get(2, []):
                s = grouped(sample)
                yield signed(s.get(2, [0])[0]) * 10**6, list(labels.items()), "", double(s[1][0]) if 1 in s else 0.0

    return _read(raw, _ENTRIES, rows, packing, on_error).select(*ENTRY_COLUMNS)


#: Kinds of metrics by their number in remote write.
METRIC_KINDS = ("unknown", "counter", "gauge", "histogram", "gaugehistogram", "summary", "info", "stateset")


def remote_metadata(raw: DataFrame, packing: str | None = "snappy", on_error: str = "raise") -> DataFrame:
    """(metric, type, help, unit) of the metadata in remote write bodies."""

    def rows(body: bytes) -> Iterator[tuple]:
        for m in map(grouped, grouped(body).get(3, [])):
            kind = m.get(1, [0])[0]
            own = [text(m[k][0]) if k in m else "" for k in (2, 4, 5)]
            yield own[0], METRIC_KINDS[kind] if kind < len(METRIC_KINDS) else "unknown", own[1], own[2]

    return _read(raw, "metric string, type string, help string, unit string", rows, packing, on_error)


def _any(value: object) -> object:
    """An attribute's value as plain Python."""
    for number, _, v in fields(value):
        if number == 1:
            return text(v)
        if number == 2:
            return bool(v)
        if number == 3:
            return signed(v)
        if number == 4:
            return double(v)
        if number == 5:
            return [_any(x) for x in grouped(v).get(1, [])]
        if number == 6:
            return _attributes(grouped(v).get(1, []))
        if number == 7:
            return bytes(v).hex()
    return None


def _attributes(items: list) -> dict[str, object]:
    out = {}
    for p in map(grouped, items):
        out[text(p[1][0]) if 1 in p else ""] = _any(p[2][0]) if 2 in p else None
    return out


def _shown(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, separators=(",", ":")) if isinstance(value, bool | list | dict) else str(value)


def _flat(attributes: dict[str, object]) -> dict[str, str]:
    return {k: s for k, v in attributes.items() if (s := _shown(v)) is not None}


def _scopes(body: bytes) -> Iterator[tuple[dict, dict, list]]:
    """(resource attributes, scope attributes, records) of an OTLP request."""
    for r in map(grouped, grouped(body).get(1, [])):
        resource = _attributes(grouped(r[1][0]).get(1, [])) if 1 in r else {}
        for s in map(grouped, r.get(2, [])):
            scope = grouped(s[1][0]) if 1 in s else {}
            yield resource, _attributes(scope.get(3, [])), s.get(2, [])


def otlp_logs(raw: DataFrame, packing: str | None = "auto", on_error: str = "raise") -> DataFrame:
    """OTLP log bodies; resource, scope and record attributes are labels, later ones winning."""

    def rows(body: bytes) -> Iterator[tuple]:
        for resource, scope, records in _scopes(body):
            for r in map(grouped, records):
                labels = _flat(resource) | _flat(scope) | _flat(_attributes(r.get(6, [])))
                for name, number in (("level", 3), ("trace_id", 9), ("span_id", 10)):
                    if number in r and len(r[number][0]):
                        labels[name] = text(r[number][0]) if number == 3 else bytes(r[number][0]).hex()
                stamp = fixed(r[1][0]) if 1 in r else 0
                line = _shown(_any(r[5][0])) if 5 in r else ""
                yield stamp or (fixed(r[11][0]) if 11 in r else 0), list(labels.items()), line or "", 0.0

    return _read(raw, _ENTRIES, rows, packing, on_error).withColumn("labels", tidy(F.col("labels"))).select(*ENTRY_COLUMNS)


#: Span kinds and status codes by their number.
SPAN_KINDS = ("SPAN_KIND_UNSPECIFIED", "SPAN_KIND_INTERNAL", "SPAN_KIND_SERVER", "SPAN_KIND_CLIENT", "SPAN_KIND_PRODUCER", "SPAN_KIND_CONSUMER")
STATUS = ("STATUS_CODE_UNSET", "STATUS_CODE_OK", "STATUS_CODE_ERROR")


def otlp_traces(raw: DataFrame, packing: str | None = "auto", on_error: str = "raise") -> DataFrame:
    """OTLP span bodies to spans."""

    def rows(body: bytes) -> Iterator[tuple]:
        for resource, _, records in _scopes(body):
            base = _flat(resource)
            for s in map(grouped, records):
                name = text(s[5][0]) if 5 in s else ""
                attrs = base | _flat(_attributes(s.get(9, []))) | {"name": name}
                if 6 in s and s[6][0] < len(SPAN_KINDS):
                    attrs["kind"] = SPAN_KINDS[s[6][0]]
                status = grouped(s[15][0]) if 15 in s else {}
                if 3 in status and status[3][0] < len(STATUS):
                    attrs["status"] = STATUS[status[3][0]]
                ids = [bytes(s[k][0]).hex() if k in s else "" for k in (1, 2, 4)]
                start, end = (fixed(s[k][0]) if k in s else 0 for k in (7, 8))
                yield *ids, name, start, end - start, list(attrs.items())

    shape = "trace_id string, span_id string, parent_id string, name string, timestamp_ns long, duration_ns long, attrs map<string,string>"
    found = _read(raw, shape, rows, packing, on_error)
    return found.withColumn("service_name", service_of(F.col("attrs"))).select(*SPAN_COLUMNS)


_PROFILE = "type_id string, timestamp_ns long, duration_ns long, labels map<string,string>, stack array<string>, value long"


def _strings(items: list) -> list[str]:
    return [text(s) for s in items]


def pprof(raw: DataFrame, name: str = "process_cpu", labels: dict[str, str] | None = None, packing: str | None = "auto", on_error: str = "raise") -> DataFrame:
    """pprof bodies to profile rows: one per sample and sample type, with the stack from the root."""
    more = labels or {}

    def rows(body: bytes) -> Iterator[tuple]:
        p = grouped(body)
        table = _strings(p.get(6, [b""]))
        functions = {f[1][0]: table[f.get(2, [0])[0]] for f in map(grouped, p.get(5, [])) if 1 in f}
        places: dict[int, list[str]] = {}
        for place in map(grouped, p.get(4, [])):
            lines = [functions.get(line.get(1, [0])[0], "") for line in map(grouped, place.get(4, []))]
            places[place.get(1, [0])[0]] = lines or [f"0x{place.get(3, [0])[0]:x}"]
        kinds = [(table[t.get(1, [0])[0]], table[t.get(2, [0])[0]]) for t in map(grouped, p.get(1, []))]
        period = grouped(p[11][0]) if 11 in p else {}
        tail = ":".join(table[period.get(k, [0])[0]] for k in (1, 2))
        stamp, spent = (signed(p[k][0]) if k in p else 0 for k in (9, 10))
        for s in map(grouped, p.get(2, [])):
            # Within a place the innermost call comes first, and so do places within a sample.
            stack = [f for place in numbers(s.get(1, [])) for f in places.get(place, [])][::-1]
            own = {table[x[1][0]]: table[x[2][0]] for x in map(grouped, s.get(3, [])) if 1 in x and 2 in x}
            for (kind, unit), value in zip(kinds, numbers(s.get(2, [])), strict=False):
                yield f"{name}:{kind}:{unit}:{tail}", stamp, spent, list((more | own).items()), stack, signed(value)

    return _with_service(_read(raw, _PROFILE, rows, packing, on_error))


def otlp_profiles(raw: DataFrame, packing: str | None = "auto", on_error: str = "raise") -> DataFrame:
    """OTLP profile bodies, whose strings, functions, places and stacks are in one dictionary, to profile rows."""

    def rows(body: bytes) -> Iterator[tuple]:
        whole = grouped(body)
        d = grouped(whole[2][0]) if 2 in whole else {}
        table = _strings(d.get(5, [])) or [""]
        functions = [table[f.get(1, [0])[0]] for f in map(grouped, d.get(3, []))]
        places = []
        for place in map(grouped, d.get(2, [])):
            lines = [functions[line.get(1, [0])[0]] for line in map(grouped, place.get(3, []))]
            places.append(lines or [f"0x{place.get(2, [0])[0]:x}"])
        stacks = [[f for k in numbers(s.get(1, [])) for f in places[k]][::-1] for s in map(grouped, d.get(7, []))]
        for resource, _, profiles in _scopes(body):
            labels = list(_flat(resource).items())
            for p in map(grouped, profiles):
                kind, period = (grouped(p[k][0]) if k in p else {} for k in (1, 5))
                own, of = (":".join(table[x.get(k, [0])[0]] for k in (1, 2)) for x in (kind, period))
                stamp, spent = (fixed(p[3][0]) if 3 in p else 0), (p[4][0] if 4 in p else 0)
                for s in map(grouped, p.get(2, [])):
                    # Without values, each moment of the sample counts as one.
                    values = numbers(s.get(2, [])) or [len(b"".join(bytes(x) for x in s.get(5, []))) // 8]
                    stack = stacks[s.get(1, [0])[0]] if stacks else []
                    yield f"{kind and table[kind.get(1, [0])[0]]}:{own}:{of}", stamp, spent, labels, stack, sum(map(signed, values))

    return _with_service(_read(raw, _PROFILE, rows, packing, on_error))


def _with_service(rows: DataFrame) -> DataFrame:
    return rows.withColumn("service_name", service_of(F.col("labels"))).select("type_id", "service_name", "timestamp_ns", "duration_ns", "labels", "stack", "value")
