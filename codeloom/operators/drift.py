"""Drift between a stored state and the present one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import last_by_id


def diff(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Full comparison of two snapshots: (key, before, now, status)."""
    a = before.select(key, F.col(value).alias("before"), F.lit(True).alias("had"))
    b = now.select(key, F.col(value).alias("now"), F.lit(True).alias("has"))
    status = (
        F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed")
        .when(F.col("before") != F.col("now"), "changed").otherwise("same")
    )
    return a.join(b, key, "full_outer").select(key, "before", "now", status.alias("status"))


def check_graph(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Nodes that were added, removed or changed, or whose summary is stale: (id, status)."""
    kept = last_by_id(stored.select("id", "body_hash", "summary_state", "ord"))
    fresh = last_by_id(current.select("id", "body_hash", "ord"))
    moved = diff(kept, fresh, "id", "body_hash").where(F.col("status") != "same").select("id", "status")
    stale = kept.where(F.col("summary_state") == "stale").select("id", F.lit("stale").alias("status"))
    return moved.unionByName(stale)


def graph_verdict(stored: DataFrame, current: DataFrame) -> DataFrame:
    """One row: counts per status, pending nodes and the verdict, which ignores them."""
    found = check_graph(stored, current)
    pivot = found.agg(*[
        F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s)
        for s in ("added", "removed", "changed", "stale")
    ])
    pending = last_by_id(stored.select("id", "summary_state", "ord")).where(F.col("summary_state") == "pending").count()
    return pivot.withColumn("pending", F.lit(pending)).withColumn(
        "ok", F.col("added") + F.col("removed") + F.col("changed") + F.col("stale") == 0)


def probe(prints: DataFrame, files: DataFrame, always_hash: bool = False) -> DataFrame:
    """Files that changed since the last build: (path, status).

    ``prints``: path, size, mtime, hash.  ``files``: path, size, mtime and
    content.  Size and time are compared first; the hash of a file is computed
    only for those that differ there.
    """
    p = prints.select("path", F.col("size").alias("p_size"), F.col("mtime").alias("p_mtime"),
                      F.col("hash").alias("p_hash"), F.lit(True).alias("had"))
    f = files.select("path", "size", "mtime", "content", F.lit(True).alias("has"))
    trusted = (
        (F.col("p_hash") != "") & (F.col("p_size") == F.col("size")) & (F.col("p_mtime") == F.col("mtime"))
        if not always_hash else F.lit(False)
    )
    status = (
        F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed")
        .when(trusted, "same")
        .when(F.sha2(F.col("content").cast("binary"), 256) != F.col("p_hash"), "changed").otherwise("same")
    )
    return p.join(f, "path", "full_outer").select("path", status.alias("status")).where(F.col("status") != "same")


def check_manifest(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded source files against the present ones: (path, status, before, now).

    Hashes are cut to eight characters, as reports show them.
    """
    kind = (
        F.when(F.col("status") == "changed", "content").when(F.col("status") == "removed", "removed")
        .otherwise("coverage")
    )
    short = {c: F.when(F.col("status") == "changed", F.substring(c, 1, 8)) for c in ("before", "now")}
    return diff(recorded, current, "path", "hash").where(F.col("status") != "same").select(
        "path", kind.alias("status"), short["before"].alias("before"), short["now"].alias("now"))


def check_roster(manifest: DataFrame, notes: DataFrame) -> DataFrame:
    """Concept notes on disk against the manifest's roster: (slug, status)."""
    status = (
        F.when(F.col("status") == "added", "not in manifest").when(F.col("status") == "removed", "note missing")
        .otherwise("digest differs")
    )
    return diff(manifest, notes, "slug", "sources_digest").where(F.col("status") != "same").select(
        "slug", status.alias("status"))


def freshness(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """How many recorded files are gone: (missing, total)."""
    here = current.select("path", F.lit(1).alias("here")).distinct()
    return recorded.join(here, "path", "left").agg(
        F.coalesce(F.sum(F.col("here").isNull().cast("long")), F.lit(0)).alias("missing"), F.count("*").alias("total"))
