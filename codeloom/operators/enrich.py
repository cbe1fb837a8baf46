"""The meaning layer: summaries carried over, marked stale or computed anew."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import last_by_id

# Shown crux lines and attempts per file.
MAX_CRUX_LINES = 12
ATTEMPTS = 2

# A summarizer takes (path, source, nodes) and returns dicts with id, summary,
# crux_start and crux_end.  ``nodes`` are dicts: id, kind, signature, start_line, end_line.
Summarizer = Callable[[str, str, list[dict]], Iterable[dict]]


def carry_over(nodes: DataFrame, prior: DataFrame) -> DataFrame:
    """Set each node's summary state from the prior layer.

    Ready when the prior summary was ready for the same body, stale when an
    older summary exists, else pending.
    """
    was = last_by_id(prior.select("id", "body_hash", "summary_state", "summary", "crux", "ord")).select(
        "id", F.col("body_hash").alias("w_hash"), F.col("summary_state").alias("w_state"),
        F.col("summary").alias("w_summary"), F.col("crux").alias("w_crux"))
    same = (F.col("w_state") == "ready") & (F.col("w_hash") == F.col("body_hash"))
    has_old = F.coalesce(F.col("w_summary"), F.lit("")) != ""
    state = F.when(same, "ready").when(has_old, "stale").otherwise("pending")
    keep = same | has_old
    base = nodes.drop("summary_state", "summary", "crux").join(was, "id", "left")
    return base.select(
        *[c for c in nodes.columns if c not in ("summary_state", "summary", "crux")],
        state.alias("summary_state"),
        F.when(keep, F.col("w_summary")).alias("summary"),
        F.when(keep, F.col("w_crux")).alias("crux"),
    )


def state_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("summary_state").agg(F.count("*").alias("n"))


def build_crux(content: Column, start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """The excerpt [start, end] of ``content``, kept inside [lo, hi] and short."""
    first = F.greatest(lo, F.least(start, hi))
    last = F.least(F.greatest(first, F.least(end, hi)), first + (MAX_CRUX_LINES - 1))
    code = F.array_join(F.slice(F.split(content, "\n"), first, last - first + 1), "\n")
    crux = F.struct(code.alias("code"),
                    F.concat(F.lit("L"), first.cast("string"), F.lit("-L"), last.cast("string")).alias("span"))
    valid = (start >= 1) & (end >= start) & (F.trim(F.regexp_replace(code, r"\s", "")) != "")
    return F.when(valid, crux)


def _describe(batches: Iterator[pd.DataFrame], summarizer: Summarizer) -> Iterator[pd.DataFrame]:
    columns = ["path", "id", "summary", "crux_start", "crux_end", "error"]
    for batch in batches:
        rows = []
        for path, source, refs in zip(batch["path"], batch["content"], batch["refs"]):
            missing, got, error = {r["id"]: dict(r) for r in refs}, {}, None
            for _ in range(ATTEMPTS):
                if not missing:
                    break
                try:
                    answers = list(summarizer(path, source, list(missing.values())))
                except Exception as e:  # a failing file is reported, never fatal
                    error = str(e)
                    break
                for a in answers:
                    got.setdefault(a["id"], a)
                missing = {k: v for k, v in missing.items() if k not in got}
            rows += [(path, k, a.get("summary") or None, a.get("crux_start", 0), a.get("crux_end", 0), None)
                     for k, a in got.items()]
            if error:
                rows.append((path, None, None, 0, 0, error))
        yield pd.DataFrame(rows, columns=columns)


def enrich(
    nodes: DataFrame, prior: DataFrame, files: DataFrame | Callable[[DataFrame], DataFrame],
    summarizer: Summarizer | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Carry summaries over and, given a summarizer, compute the missing ones.

    One call covers the open nodes of one file; files are small and are spread
    over all tasks.  ``files`` is (path, content), or a function that reads it
    for given paths.  Returns the nodes and the errors (path, error).
    """
    carried = carry_over(nodes, prior)
    if summarizer is None:
        return carried, None
    if callable(files):
        files = files(carried.where(F.col("summary_state") != "ready").select("path"))
    ref = F.struct("id", "kind", "signature", "start_line", "end_line")
    work = (
        carried.where(F.col("summary_state") != "ready").groupBy("path")
        .agg(F.sort_array(F.collect_list(ref)).alias("refs"))
        .join(files.select("path", "content"), "path")
    )
    schema = "path string, id string, summary string, crux_start int, crux_end int, error string"
    said = work.select("path", "content", "refs").mapInPandas(lambda it: _describe(it, summarizer), schema)
    from ..session import materialize

    said = materialize(said)
    errors = said.where(F.col("error").isNotNull()).select("path", "error")
    answers = said.where(F.col("id").isNotNull()).select(
        "path", "id", F.col("summary").alias("new_summary"), "crux_start", "crux_end", F.lit(True).alias("told"))
    told = answers.join(files.select("path", "content"), "path").drop("path")
    joined = carried.join(told, "id", "left")
    crux = build_crux(F.col("content"), F.col("crux_start"), F.col("crux_end"), F.col("start_line"), F.col("end_line"))
    told_now = F.coalesce("told", F.lit(False))
    return joined.select(
        *[c for c in nodes.columns if c not in ("summary_state", "summary", "crux")],
        F.when(told_now, F.lit("ready")).otherwise(F.col("summary_state")).alias("summary_state"),
        F.when(told_now, F.col("new_summary")).otherwise(F.col("summary")).alias("summary"),
        F.when(told_now, crux).otherwise(F.col("crux")).alias("crux"),
    ), errors
