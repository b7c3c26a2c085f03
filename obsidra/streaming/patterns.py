"""Log patterns: lines become token lists, in which what varies is a placeholder; like lists of one stream join.

Tokens that look like ids, addresses, times or numbers are placeholders at once, which turns most lines of one statement
into one text; those are counted in the engine, by stream and step. Only distinct texts go on to be clustered: within a
stream and number of tokens, a text joins the pattern that it agrees with best, if at least ``similarity`` of its tokens
are the same, and the pattern gets a placeholder where they differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidra.plans.model import Timed, fingerprint, frame_of

PLACEHOLDER = "<_>"
SIMILARITY = 0.7
STEP_S = 10
#: What is replaced, in this order.
VARIABLE = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # unique ids
    r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?",  # times
    r"(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?",  # addresses
    r"0x[0-9a-fA-F]+",
    r"(?<![A-Za-z_])[0-9a-f]{16,}(?![A-Za-z_])",
    r"(?<![A-Za-z0-9_])[+-]?\d+(?:\.\d+)?(?:ns|us|ms|s|m|h|kB|MB|GB|%)?(?![A-Za-z0-9_])",  # numbers with units
)


def masked(line: Column) -> Column:
    """The line with placeholders for what looks variable, and single blanks."""
    out = F.regexp_replace(F.trim(line), r"\s+", " ")
    for pattern in VARIABLE:
        out = F.regexp_replace(out, pattern, PLACEHOLDER)
    return out


def counted(entries: DataFrame | Timed, step_s: int = STEP_S) -> DataFrame:
    """(fingerprint, text, timestamp_s, count): distinct masked lines per stream and step."""
    at = F.expr(f"timestamp_ns div {step_s * 10**9} * {step_s}").alias("timestamp_s")
    rows = frame_of(entries).select(fingerprint(F.col("labels")).alias("fingerprint"), masked(F.col("string")).alias("text"), at)
    return rows.groupBy("fingerprint", "text", "timestamp_s").agg(F.count(F.lit(1)).alias("count"))


def clusters(texts: list[tuple[str, int]], similarity: float = SIMILARITY) -> list[str]:
    """The pattern of each (masked text, lines), all with one number of tokens; frequent texts come first, so patterns
    don't depend on the order of input."""
    order = sorted(range(len(texts)), key=lambda k: (-texts[k][1], texts[k][0]))
    found: list[list[str]] = []
    by_token: dict[tuple[int, str], set[int]] = {}
    member = [0] * len(texts)
    for k in order:
        tokens = texts[k][0].split(" ")
        shared: dict[int, int] = {}
        for place, token in enumerate(tokens):
            for c in by_token.get((place, token), ()):
                shared[c] = shared.get(c, 0) + 1
        best = min(((-n, c) for c, n in shared.items() if n >= similarity * len(tokens)), default=None)
        if best is None:
            member[k] = len(found)
            found.append(tokens)
            for place, token in enumerate(tokens):
                by_token.setdefault((place, token), set()).add(member[k])
        else:
            member[k] = c = best[1]
            for place, token in enumerate(tokens):
                if found[c][place] != token and found[c][place] != PLACEHOLDER:
                    by_token[place, found[c][place]].discard(c)
                    found[c][place] = PLACEHOLDER
                    by_token.setdefault((place, PLACEHOLDER), set()).add(c)
    return [" ".join(found[c]) for c in member]


def mine(entries: DataFrame | Timed, similarity: float = SIMILARITY, step_s: int = STEP_S) -> DataFrame:
    """(fingerprint, pattern, timestamp_s, count) of all lines."""
    return _clustered(counted(entries, step_s), similarity)


def _clustered(rows: DataFrame, similarity: float) -> DataFrame:
    """Texts (fingerprint, text, timestamp_s, count) under their patterns. A task holds the distinct texts of one stream
    and number of tokens, not its lines."""
    tokens = F.size(F.split("text", " ")).alias("tokens")
    texts = rows.groupBy("fingerprint", tokens, "text").agg(F.sum("count").alias("n"))

    def run(t: pa.Table) -> pa.Table:
        names = t.column("text").to_pylist()
        return pa.table({"fingerprint": t.column("fingerprint"), "text": names, "pattern": clusters(list(zip(names, t.column("n").to_pylist(), strict=True)), similarity)})

    named = texts.groupBy("fingerprint", "tokens").applyInArrow(run, "fingerprint long, text string, pattern string")
    return rows.join(named, ["fingerprint", "text"]).groupBy("fingerprint", "pattern", "timestamp_s").agg(F.sum("count").alias("count"))


def query(patterns: DataFrame, fingerprints: DataFrame | None = None, from_s: int | None = None, to_s: int | None = None, step_s: int = 60, limit: int | None = None, least: int = 2) -> DataFrame:
    """(pattern, total, samples) of patterns with at least ``least`` lines; samples are (step, count) in order. With
    ``limit`` those with most lines."""
    found = patterns if fingerprints is None else patterns.join(fingerprints.select("fingerprint").distinct(), "fingerprint", "left_semi")
    if from_s is not None:
        found = found.where(F.col("timestamp_s") >= from_s)
    if to_s is not None:
        found = found.where(F.col("timestamp_s") <= to_s)
    stepped = found.groupBy("pattern", F.expr(f"timestamp_s div {step_s} * {step_s}").alias("at")).agg(F.sum("count").alias("count"))
    out = stepped.groupBy("pattern").agg(F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct("at", "count"))).alias("samples")).where(F.col("total") >= least)
    return out if limit is None else out.orderBy(F.desc("total"), "pattern").limit(limit)


def pattern_id(pattern: str) -> str:
    return hashlib.blake2b(pattern.encode(), digest_size=8).hexdigest()


def stream(entries: DataFrame, save: Callable[[DataFrame], None], checkpoint: str, similarity: float = SIMILARITY, trigger: str = "10 seconds"):  # noqa: ANN201
    """Starts mining of a stream: each micro-batch's patterns go to ``save``. Patterns of batches are put together with
    ``merged`` when they are read, so a batch that runs twice after a failure has to replace its first result."""

    def batch(rows: DataFrame, _: int) -> None:
        save(mine(rows, similarity))

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def merged(patterns: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Patterns of several batches clustered once more, so like ones of different batches are one."""
    return _clustered(patterns.withColumnRenamed("pattern", "text"), similarity)
