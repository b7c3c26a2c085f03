"""Line templates compiled to Columns: text with {{ ... }} actions over labels and built-in functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsidra.functions.labels import number
from obsidra.plans.lexing import QueryError

_PART = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.S)
_WORD = re.compile(r'\s*("(?:\\.|[^"\\])*"|`[^`]*`|\(|\)|\||[^\s()|]+)')


def _long(x: Column) -> Column:
    return F.coalesce(number(x).cast("long"), F.lit(0))


def _double(x: Column) -> Column:
    return F.coalesce(number(x), F.lit(0.0))


def _text(x: Column) -> Column:
    return x.cast("string")


def _plain(x: Column) -> Column:
    """A double as text without a trailing .0."""
    return F.regexp_replace(_text(x), r"\.0$", "")


def _fold(op: Callable[[Column, Column], Column], cast: Callable[[Column], Column], show: Callable[[Column], Column] = _text) -> Callable[..., Column]:
    def run(*args: Column) -> Column:
        out = cast(args[0])
        for x in args[1:]:
            out = op(out, cast(x))
        return show(out)

    return run


def _replace(s: Column, old: Column, new: Column, n: Column) -> Column:
    """The first ``n`` places where ``old`` stands, all of them if n is negative: the text is cut there once more than n
    times and put together again."""
    parts = F.split(s, _quote(old), -1)
    some = F.least(n, F.size(parts) - 1).cast("int")
    head = F.call_function("array_join", F.slice(parts, F.lit(1), some + 1), new)
    tail = F.transform(F.slice(parts, some + 2, F.greatest(F.size(parts) - some - 1, F.lit(0))), lambda x: F.concat(old, x))
    return F.when((n < 0) | (old == ""), F.replace(s, old, new)).otherwise(F.concat(head, F.array_join(tail, "")))


def _quote(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))


def _substr(a: Column, b: Column, s: Column) -> Column:
    start, end = F.greatest(_long(a), F.lit(0)).cast("int"), _long(b).cast("int")
    return F.when(end < 0, F.substring(s, start + 1, F.length(s))).otherwise(F.substring(s, start + 1, F.greatest(end - start, F.lit(0))))


def _trunc(n: Column, s: Column) -> Column:
    k = _long(n).cast("int")
    return F.when(k >= 0, F.substring(s, F.lit(1), k)).otherwise(F.when(F.length(s) > -k, F.right(s, -k)).otherwise(s))


def _strip(chars: Column, s: Column, left: bool = True, right: bool = True) -> Column:
    out = s
    if left:
        out = F.ltrim(out, chars)
    return F.rtrim(out, chars) if right else out


_TRUE = lambda x: (x != "") & (x != "false") & (x != "0")

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "ToLower": F.lower, "lower": F.lower, "ToUpper": F.upper, "upper": F.upper, "title": F.initcap,
    "Replace": lambda s, old, new, n: _replace(s, old, new, _long(n)),
    "replace": lambda old, new, s: F.replace(s, old, new),
    "Trim": lambda s, c: _strip(c, s), "TrimLeft": lambda s, c: _strip(c, s, right=False), "TrimRight": lambda s, c: _strip(c, s, left=False), "trimAll": _strip,
    "TrimSpace": lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""), "trim": lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""),
    "TrimPrefix": lambda s, p: F.regexp_replace(s, F.concat(F.lit("^"), _quote(p)), F.lit("")), "trimPrefix": lambda p, s: F.regexp_replace(s, F.concat(F.lit("^"), _quote(p)), F.lit("")),
    "TrimSuffix": lambda s, p: F.regexp_replace(s, F.concat(_quote(p), F.lit("$")), F.lit("")), "trimSuffix": lambda p, s: F.regexp_replace(s, F.concat(_quote(p), F.lit("$")), F.lit("")),
    "regexReplaceAll": lambda r, s, new: F.regexp_replace(s, r, new), "regexReplaceAllLiteral": lambda r, s, new: F.regexp_replace(s, r, F.regexp_replace(new, r"([\\$])", r"\\$1")),
    "trunc": _trunc, "substr": _substr, "repeat": lambda n, s: F.repeat(s, _long(n).cast("int")),
    "contains": lambda a, s: _text(s.contains(a)), "hasPrefix": lambda a, s: _text(s.startswith(a)), "hasSuffix": lambda a, s: _text(s.endswith(a)),
    "indent": lambda n, s: F.regexp_replace(s, F.lit("(?m)^"), F.repeat(F.lit(" "), _long(n).cast("int"))),
    "nindent": lambda n, s: F.concat(F.lit("\n"), F.regexp_replace(s, F.lit("(?m)^"), F.repeat(F.lit(" "), _long(n).cast("int")))),
    "add": _fold(lambda a, b: a + b, _long), "sub": _fold(lambda a, b: a - b, _long), "mul": _fold(lambda a, b: a * b, _long),
    "div": _fold(lambda a, b: F.when(b != 0, F.try_divide(a, b).cast("long")), _long), "divide": _fold(lambda a, b: F.try_divide(a, b), _double, _plain),
    "mod": _fold(lambda a, b: F.when(b != 0, F.try_mod(a, b)), _long), "max": _fold(F.greatest, _long), "min": _fold(F.least, _long),
    "addf": _fold(lambda a, b: a + b, _double, _plain), "subf": _fold(lambda a, b: a - b, _double, _plain), "mulf": _fold(lambda a, b: a * b, _double, _plain),
    "divf": _fold(lambda a, b: F.try_divide(a, b), _double, _plain), "maxf": _fold(F.greatest, _double, _plain), "minf": _fold(F.least, _double, _plain),
    "ceil": lambda x: _text(F.ceil(_double(x))), "floor": lambda x: _text(F.floor(_double(x))),
    "round": lambda x, n=None: _plain(F.round(_double(x), 0 if n is None else _long(n).cast("int"))),
    "int": lambda x: _text(_long(x)), "float64": lambda x: _plain(_double(x)), "len": lambda s: _text(F.octet_length(s)),
    "eq": lambda a, b: _text(a == b), "ne": lambda a, b: _text(a != b), "not": lambda a: _text(~_TRUE(a)),
    "and": lambda *a: _pick(a, lambda x: ~_TRUE(x)), "or": lambda *a: _pick(a, _TRUE),
    "now": lambda: _text(F.current_timestamp()), "unixEpoch": lambda t: _text(F.unix_timestamp(t.try_cast("timestamp"))),
    "toDate": lambda layout, s: _text(F.try_to_timestamp(s, F.lit(layout))), "toDateInZone": lambda layout, zone, s: _text(F.to_utc_timestamp(F.try_to_timestamp(s, F.lit(layout)), zone)),
    "duration": lambda s: _text(_seconds(s)), "duration_seconds": lambda s: _text(_seconds(s)), "fromJson": lambda s: F.coalesce(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")[0], F.lit("")),
}

DATED = ("date", "toDate", "toDateInZone")  # their first argument is a layout

# Parts of the reference date in layouts, and what they stand for.
LAYOUT = {"Z07:00": "XXX", ".000": ".SSS", "2006": "yyyy", "01": "MM", "02": "dd", "15": "HH", "04": "mm", "05": "ss", "Jan": "MMM", "January": "MMMM", "Mon": "EEE", "MST": "z"}


def _pattern(layout: str) -> str:
    """A layout written with the reference date as a date pattern; letters that are no part of it stand for themselves."""
    parts = re.split("(" + "|".join(sorted(LAYOUT, key=len, reverse=True)) + ")", layout)
    return "".join(LAYOUT[x] if x in LAYOUT else re.sub("[A-Za-z]+", lambda m: f"'{m[0]}'", x) for x in parts)


def _date(layout: str, moment: Column) -> Column:
    return F.date_format(moment, _pattern(layout))


def _seconds(s: Column) -> Column:
    part = lambda unit, scale: F.coalesce(number(F.regexp_extract(s, rf"([0-9.]+){unit}(?![a-z])", 1)), F.lit(0.0)) * scale
    return part("h", 3600.0) + part("m", 60.0) + part("s", 1.0) + part("ms", 1e-3) + part("us", 1e-6) + part("ns", 1e-9)


def _pick(args: tuple[Column, ...], test: Callable[[Column], Column]) -> Column:
    out = args[-1]
    for x in reversed(args[:-1]):
        out = F.when(test(x), x).otherwise(out)
    return out


def _operand(word: str, labels: Column, line: Column, stamp: Column) -> Column:
    if word[0] in "\"`":
        return F.lit(word[1:-1].replace('\\"', '"').replace("\\n", "\n") if word[0] == '"' else word[1:-1])
    if re.fullmatch(r"-?\d+(\.\d+)?", word) or word in ("true", "false"):
        return F.lit(word)
    if word in ("_entry", "._entry", "__line__"):
        return line
    if word == "__timestamp__":
        return stamp
    return F.coalesce(labels[word.removeprefix(".")], F.lit(""))


def compiled(template: str, labels: Column, line: Column, stamp: Column) -> Column:
    """The template's text for each row; an unknown label is empty."""
    parts: list[Column] = []
    at = 0
    for m in _PART.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        words = [w for w in _WORD.findall(m[1])]
        value, rest = _pipeline(words, labels, line, stamp)
        if rest:
            raise QueryError(f"can't read the template action {m[1]!r}")
        parts.append(F.coalesce(value, F.lit("")))
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def _pipeline(words: list[str], labels: Column, line: Column, stamp: Column) -> tuple[Column, list[str]]:
    value, words = _command(words, None, labels, line, stamp)
    while words and words[0] == "|":
        value, words = _command(words[1:], value, labels, line, stamp)
    return value, words


def _command(words: list[str], piped: Column | None, labels: Column, line: Column, stamp: Column) -> tuple[Column, list[str]]:
    if not words:
        raise QueryError("empty template action")
    head, rest = words[0], words[1:]
    name = head if head in FUNCTIONS or head == "date" else None
    args: list[Column] = []
    layout = None
    if name is None:
        rest = words
    while rest and rest[0] not in ("|", ")"):
        if rest[0] == "(":
            value, rest = _pipeline(rest[1:], labels, line, stamp)
            if rest[:1] != [")"]:
                raise QueryError("missing ) in the template")
            rest = rest[1:]
        else:
            if name in DATED and layout is None:
                layout, rest = rest[0][1:-1], rest[1:]
                continue
            value, rest = _operand(rest[0], labels, line, stamp), rest[1:]
        args.append(value)
        if name is None:
            break
    if piped is not None:
        args.append(piped)
    if name == "date":
        return _date(layout or "2006-01-02", args[-1].try_cast("timestamp")), rest
    if name in DATED:
        args = [_pattern(layout or "2006-01-02"), *args]
    return (FUNCTIONS[name](*args) if name else args[0]), rest


