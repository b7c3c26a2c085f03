"""Hooks: planners of one's own, tried before the built-in ones, and sources by the name of what they hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from obsidra.plans.lexing import QueryError

#: What can be replaced. A planner takes (source, query text, options) and gives a DataFrame, or None to pass. A table
#: hook takes the store and gives a source in place of the table's own.
PLANNERS = ("log_query", "metric_query", "trace_query")
SOURCES = ("samples", "series", "rollup", "spans", "span_attributes", "profiles")
_planners: dict[str, dict[str, Callable]] = {kind: {} for kind in PLANNERS}
_sources: dict[str, Callable] = {}


def register_planner(kind: str, name: str, planner: Callable[..., DataFrame | None]) -> None:
    if kind not in _planners:
        raise QueryError(f"no planner kind {kind}; there are {', '.join(PLANNERS)}")
    _planners[kind][name] = planner


def register_source(kind: str, source: Callable) -> None:
    if kind not in SOURCES:
        raise QueryError(f"no source kind {kind}; there are {', '.join(SOURCES)}")
    _sources[kind] = source


def unregister(kind: str, name: str | None = None) -> None:
    if name is None:
        _sources.pop(kind, None)
    else:
        _planners[kind].pop(name, None)


def planned(kind: str, *args: object) -> DataFrame | None:
    """The first result of the registered planners, in the order of their registration."""
    for planner in _planners[kind].values():
        if (found := planner(*args)) is not None:
            return found
    return None


def source(kind: str, own: Callable, *args: object) -> object:
    """The registered source of this kind, else what ``own`` gives."""
    return _sources.get(kind, own)(*args)
