"""Estimates of what an answer saves against reading whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def savings_for(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Files and characters behind the distinct ``paths``; files of unknown size are skipped.

    One row; both values are null when no size is known.
    """
    sized = nodes.where((F.col("kind") == "file") & F.col("chars").isNotNull()).groupBy("path").agg(
        F.max_by("chars", "ord").alias("chars"))
    hit = sized.join(paths.select("path").distinct(), "path", "left_semi")
    return hit.agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).select(
        F.when(F.col("n") > 0, F.col("n")).alias("files"), F.col("chars").alias("baseline_chars"))


def pointer_paths(hits: DataFrame) -> DataFrame:
    """Paths that pointers name: ``path:Lx-Ly`` or a comma-separated list."""
    plain = F.regexp_extract("pointer", r"^(.*):L\d+-L\d+$", 1)
    listed = F.transform(F.split("pointer", ","), lambda p: F.trim(p))
    usable = F.filter(listed, lambda p: (p != "") & ~F.contains(p, F.lit(" ")))
    return hits.select(F.explode(F.when(plain != "", F.array(plain)).otherwise(usable)).alias("path")).distinct()


def saved_tokens(baseline_chars: Column, output_chars: Column) -> Column:
    """Tokens saved; null when the output is no smaller than the files."""
    base, out = X.to_tokens(baseline_chars), X.to_tokens(output_chars)
    return F.when(base > out, base - out)


def saved_percent(baseline_chars: Column, output_chars: Column) -> Column:
    base = X.to_tokens(baseline_chars)
    saved = saved_tokens(baseline_chars, output_chars)
    return F.floor(100.0 * saved / base + 0.5).cast("long")


def footer(hits: DataFrame, nodes: DataFrame, body: str, label: str) -> str:
    """A line below an answer on what it spared, from the columns above; empty when it spared nothing."""
    size = F.lit(len(body))
    whole = savings_for(nodes, pointer_paths(hits))
    row = whole.select(
        "files", saved_tokens(F.col("baseline_chars"), size).alias("spared"),
        saved_percent(F.col("baseline_chars"), size).alias("percent")).first()
    if row["spared"] is None:
        return ""
    return f"\n\n{label}: about {row['spared']:,} tokens less than {row['files']} whole files ({row['percent']}% spared)"
