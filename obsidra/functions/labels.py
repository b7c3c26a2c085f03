"""Column builders on label maps: matchers, parsers and reshaping."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsidra.plans.lexing import QueryError

ERROR, DETAILS = "__error__", "__error_details__"


def java_regex(pattern: str) -> str:
    """RE2 to Java: named groups; the rest of the shared syntax is alike."""
    return re.sub(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", lambda m: "(?<" + m[1].replace("_", "U") + ">", pattern)


def is_literal(pattern: str) -> bool:
    return re.fullmatch(r"[^\\.+*?()\[\]{}|^$]*", pattern) is not None


def matched(labels: Column, name: str, op: str, value: str, *, anchored: bool = False, absent_matches: bool = False) -> Column | None:
    """A stream matcher; None for one that all streams match. Negative ones need the label to exist unless
    ``absent_matches``."""
    have = labels[name]
    if value == "" and op in ("=", "=~"):
        return have.isNull() | (have == "")
    if op == "=~" and value in (".*", "^.*$"):
        return None
    pattern = f"^(?:{java_regex(value)})$" if anchored else java_regex(value)
    test = {"=": have == value, "!=": have != value, "=~": have.rlike(pattern), "!~": ~have.rlike(pattern)}[op]
    if absent_matches and op in ("!=", "!~"):
        return have.isNull() | test
    return test


def line_test(line: Column, op: str, tree: object) -> Column:
    if isinstance(tree, tuple):
        both, left, right = tree
        a, b = line_test(line, op, left), line_test(line, op, right)
        return a & b if both == "and" else a | b
    if op in ("|=", "!="):
        found = line.contains(tree)
    elif op in ("|~", "!~"):
        found = line.contains(tree) if is_literal(tree) else line.rlike(java_regex(tree))
    else:
        parts = [re.sub(r"([%_\\])", r"\\\1", p) for p in re.split(r"(?<!\\)<_>", tree)]
        found = line.like("%".join(p.replace("\\\\<_>", "<_>") for p in parts))
    return ~found if op[0] == "!" else found


def number(text: Column) -> Column:
    return text.try_cast("double")


def label_test(labels: Column, name: str, op: str, value: object) -> Column:
    have = F.coalesce(labels[name], F.lit(""))
    if isinstance(value, str):
        if op in ("=", "=="):
            return have == value
        if op == "!=":
            return have != value
        if op in ("=~", "!~"):
            found = have.rlike(java_regex(value))
            return ~found if op == "!~" else found
        raise QueryError(f"{op} needs a number")
    x = number(have)
    tests = {"=": x == value, "==": x == value, "!=": x != value, ">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value}
    if op not in tests:
        raise QueryError(f"{op} needs a string")
    return F.coalesce(tests[op], F.lit(False))


def updated(labels: Column, more: Column) -> Column:
    """``labels`` with the entries of ``more``, which win."""
    return F.map_concat(F.map_filter(labels, lambda k, _: ~F.map_contains_key(more, k)), more)


def sanitized(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def json_path(path: str) -> str:
    """A path such as a.b[0]["c d"] for get_json_object."""
    out = "$"
    for dot, index, quoted in re.findall(r"\.?([A-Za-z_][A-Za-z0-9_]*)|\[(\d+)\]|\[\"([^\"]*)\"\]", path):
        out += f".{dot}" if dot else f"[{index}]" if index else f"['{quoted}']"
    return out


def pair(key: Column, value: Column) -> Column:
    """A (key, value) struct; names given by aliases get lost in nested lambdas."""
    return F.named_struct(F.lit("key"), key, F.lit("value"), value)


def last_wins(pairs: Column) -> Column:
    """A map of (key, value) structs; of those with one key the last counts."""
    later = lambda e, i: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(pairs, lambda e, i: ~later(e, i)))


_JSON_TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+'
_JSON_STATE = "struct<path:array<string>,key:string,last:string,want:boolean,skip:int,out:array<struct<key:string,value:string>>>"


def _json_pairs(line: Column) -> Column:
    """(key, value) of all scalars of a JSON object at any depth, by one pass over its tokens. State: the keys of the
    objects at hand, the key before a colon, the last string, whether a value comes next, how many arrays deep."""
    start = F.expr(f"cast(named_struct('path', array(), 'key', '', 'last', '', 'want', false, 'skip', 0, 'out', array()) as {_JSON_STATE})")
    tokens = F.regexp_extract_all(line, F.lit(_JSON_TOKEN), F.lit(0))

    def next_(s: Column, t: Column) -> Column:
        opens, closes, inside = t.isin("{", "["), t.isin("}", "]"), s["skip"] > 0
        name = F.array_join(F.filter(F.concat(s["path"], F.array(s["key"])), lambda k: k != ""), "_")
        bare = sanitized(F.regexp_replace(s["last"], '^"|"$', ""))
        scalar = ~opens & ~closes & ~t.isin(":", ",")
        kept = ~inside & scalar & s["want"] & ~t.isin("null", '""')
        own = F.array(F.struct(name.alias("key"), t.alias("value")))
        return F.struct(
            F.when(inside, s["path"]).when(t == "{", F.concat(s["path"], F.array(s["key"]))).when(t == "}", F.slice(s["path"], 1, F.greatest(F.size(s["path"]) - 1, F.lit(0)))).otherwise(s["path"]).alias("path"),
            F.when(inside, s["key"]).when(t == ":", bare).when(opens | closes, F.lit("")).otherwise(s["key"]).alias("key"),
            F.when(~inside & scalar, t).otherwise(s["last"]).alias("last"),
            F.when(inside, F.lit(False)).otherwise(t == ":").alias("want"),
            (s["skip"] + F.when(opens & (inside | (t == "[")), 1).when(closes & inside, -1).otherwise(0)).alias("skip"),
            F.when(kept, F.concat(s["out"], own)).otherwise(s["out"]).alias("out"),
        ).cast(_JSON_STATE)

    found = F.aggregate(tokens, start, next_)["out"]
    text = lambda v: F.when(v.startswith('"'), F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>")[0]).otherwise(v)
    return F.transform(found, lambda e: F.struct(e["key"].alias("key"), F.coalesce(text(e["value"]), F.lit("")).alias("value")))


def json_labels(line: Column) -> Column:
    """All scalars of a JSON object as labels, nested keys joined by an underscore; of equal keys the last counts."""
    parsed = F.from_json(line, "map<string,string>")
    good = line.rlike(r"^\s*\{") & parsed.isNotNull()
    failed = F.create_map(F.lit(ERROR), F.lit("JSONParserErr"), F.lit(DETAILS), F.lit("the line is not a JSON object"))
    # Most lines are flat objects with plain keys: one map does for them, and the tokens are only walked for others.
    keys = F.map_keys(parsed)
    flat = _flat(line) & (F.size(F.array_distinct(keys)) == F.size(keys))
    own = F.map_filter(parsed, lambda _, v: v.isNotNull() & (v != "") & ~v.rlike(r"^[\[{]"))
    return F.when(F.coalesce(flat, F.lit(False)), own).when(F.coalesce(good, F.lit(False)), last_wins(_json_pairs(line))).otherwise(failed)


def json_some(line: Column, names: tuple[str, ...]) -> Column:
    """json_labels() cut down to ``names``, by one parse of just these fields. A name with an underscore may also stand
    for a nested or an odd key: then that holds for flat lines with plain keys, and others are read whole."""
    parsed = F.from_json(line, ", ".join(f"`{n}` string" for n in names))
    made = F.create_map(*[x for n in names for x in (F.lit(n), parsed[n])])
    own = F.map_filter(made, lambda _, v: v.isNotNull() & (v != "") & ~v.rlike(r"^[\[{]"))
    if not any("_" in n for n in names):
        return own
    whole = F.map_filter(json_labels(line), lambda k, _: k.isin(*names))
    return F.when(F.coalesce(_flat(line), F.lit(False)), own).otherwise(whole)


def _flat(line: Column) -> Column:
    return line.rlike(r"^\s*\{[^{]*$") & ~line.rlike(r'"[^"]*[^a-zA-Z0-9_"][^"]*"\s*:')


def json_labels_at(line: Column, fields: tuple[tuple[str, str], ...]) -> Column:
    return F.create_map(*[x for name, path in fields for x in (F.lit(name), F.coalesce(F.get_json_object(line, json_path(path)), F.lit("")))])


LOGFMT = r'([A-Za-z0-9_.\-/]+)=("(?:[^"\\]|\\.)*"|[^\s"]*)'


def logfmt_labels(line: Column, fields: tuple[tuple[str, str], ...] = ()) -> Column:
    keys = F.transform(F.regexp_extract_all(line, F.lit(LOGFMT), F.lit(1)), sanitized)
    values = F.transform(F.regexp_extract_all(line, F.lit(LOGFMT), F.lit(2)), lambda v: F.regexp_replace(F.regexp_replace(v, '^"|"$', ""), r'\\(["\\])', "$1"))
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    pairs = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
    last = last_wins(pairs)
    if not fields:
        return last
    return F.map_filter(F.create_map(*[x for name, key in fields for x in (F.lit(name), last[key])]), lambda _, v: v.isNotNull())


def regexp_labels(line: Column, pattern: str) -> Column:
    names = [m[1] for m in re.finditer(r"(?<!\\)\((?:\?P?<([A-Za-z_][A-Za-z0-9_]*)>|(?!\?))", pattern)]
    java = java_regex(pattern)
    items = [x for k, n in enumerate(names, 1) if n for x in (F.lit(n), F.element_at(F.regexp_extract_all(line, F.lit(java), F.lit(k)), -1))]
    if not items:
        return F.expr("cast(map() as map<string,string>)")
    some = F.size(F.regexp_extract_all(line, F.lit(java), F.lit(0))) > 0
    found = F.when(some, F.map_filter(F.create_map(*items), lambda _, v: v.isNotNull() & (v != "")))
    return F.coalesce(found, F.expr("cast(map() as map<string,string>)"))


def dropped(labels: Column, items: tuple[tuple[str, str | None], ...]) -> Column:
    def stays(k: Column, v: Column) -> Column:
        gone = F.lit(False)
        for name, value in items:
            gone = gone | ((k == name) if value is None else (k == name) & (v == value))
        return ~gone

    return F.map_filter(labels, stays)


def kept(labels: Column, items: tuple[tuple[str, str | None], ...]) -> Column:
    def stays(k: Column, v: Column) -> Column:
        ok = k.isin(ERROR, DETAILS)
        for name, value in items:
            ok = ok | ((k == name) if value is None else (k == name) & (v == value))
        return ok

    return F.map_filter(labels, stays)
