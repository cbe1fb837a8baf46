"""Directory roll-up with hubs and hotspots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ranking import top_per_group
from ..session import broadcast_if_small, materialize
from .grep import in_degree

# Fixed values of the report.
MAX_DIRS = 16
HUBS_PER_DIR = 3
HOTSPOTS = 12
SPLIT_THRESHOLD = 0.6

# Split directories up to this number are compared in an expression; more are joined.
LITERAL_SPLITS = 32


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    is_file = F.col("kind") == "file"
    languages = F.array_sort(F.collect_set(F.when(is_file, X.language_of(F.col("path")))))
    counts = nodes.agg(
        F.sum(is_file.cast("long")).alias("files"),
        F.sum((~is_file).cast("long")).alias("symbols"),
        languages.alias("languages"),
    )
    return counts.withColumn("edges", F.lit(edges.count()))


def _relative(path: Column, scope: Column) -> Column:
    return (
        F.when(scope == "", path)
        .when(path == scope, F.lit(""))
        .otherwise(F.substring(path, F.length(scope) + 2, F.length(path)))
    )


def split_segments(placed: DataFrame) -> DataFrame:
    """The first path segment that holds most files of a scope, if one does."""
    files = placed.where(F.col("kind") == "file")
    counts = files.groupBy("scope", F.substring_index("rel", "/", 1).alias("segment")).agg(F.count("*").alias("n"))
    per_scope = counts.groupBy("scope").agg(
        F.sum("n").alias("total"), F.max(F.struct("n", "segment")).alias("big"))
    return per_scope.where(F.col("big.n") / F.col("total") > SPLIT_THRESHOLD).select(
        "scope", F.col("big.segment").alias("split"))


def grouped(nodes: DataFrame) -> DataFrame:
    """Place every node in its directory group.

    ``nodes`` carries ``scope``.  Groups are first path segments below the
    scope; the one segment with more than 60% of the files is split a level
    deeper.
    """
    placed = nodes.withColumn("rel", _relative(F.col("path"), F.col("scope")))
    splits = materialize(split_segments(placed))  # at most one row per scope
    first = F.substring_index("rel", "/", 1)
    few = splits.limit(LITERAL_SPLITS + 1).collect()
    if len(few) <= LITERAL_SPLITS:
        hit = F.lit(False)
        for r in few:
            hit = hit | ((F.col("scope") == r["scope"]) & (first == r["split"]))
        return placed.withColumn("dir", F.when(hit, F.substring_index("rel", "/", 2)).otherwise(first))
    return placed.join(broadcast_if_small(splits), "scope", "left").withColumn(
        "dir", F.when(first == F.col("split"), F.substring_index("rel", "/", 2)).otherwise(first)
    ).drop("split")


def dir_entries(placed: DataFrame) -> DataFrame:
    """Files, symbols and languages per directory group."""
    is_file = F.col("kind") == "file"
    full = F.when(F.col("scope") == "", F.col("dir")).when(F.col("dir") == "", F.col("scope")).otherwise(
        F.concat_ws("/", "scope", "dir"))
    return placed.groupBy("scope", "dir").agg(
        F.sum(is_file.cast("long")).alias("files"),
        F.sum((~is_file).cast("long")).alias("symbols"),
        F.array_sort(F.collect_set(F.when(is_file, X.language_of(F.col("path"))))).alias("languages"),
        F.max(is_file & (F.col("rel") == F.col("dir"))).alias("is_file"),
    ).withColumn("path", full)


def _hub_order(icu: bool) -> list[Column]:
    def text(c: str) -> Column:
        return F.collate(F.col(c), "UNICODE") if icu else F.col(c)

    return [F.col("in_degree").desc(), text("name"), text("path"), F.col("id")]


def hubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols something points at, with their in-degree."""
    symbols = nodes.where(F.col("kind") != "file")
    return symbols.join(in_degree(edges), "id")


def hotspots(nodes: DataFrame, edges: DataFrame, k: int = HOTSPOTS, icu: bool = False) -> DataFrame:
    return hubs(nodes, edges).orderBy(*_hub_order(icu)).limit(k)


def dir_hubs(placed: DataFrame, edges: DataFrame, k: int = HUBS_PER_DIR, icu: bool = False) -> DataFrame:
    return top_per_group(hubs(placed, edges), ["scope", "dir"], _hub_order(icu), k)


@dataclass
class RepoMap:
    totals: DataFrame
    dirs: DataFrame      # kept entries with their rank
    dropped: DataFrame   # entries beyond the cap, per scope
    hubs: DataFrame
    hotspots: DataFrame


def repo_map(
    nodes: DataFrame, edges: DataFrame, scopes: list[str] | None = None, max_dirs: int = MAX_DIRS,
    hubs_per_dir: int = HUBS_PER_DIR, n_hotspots: int = HOTSPOTS, icu: bool = True,
) -> RepoMap:
    """The whole report.  With several scopes only nodes of a listed scope are grouped."""
    from .scopes import with_scope

    if scopes and len(scopes) > 1:
        owned = with_scope(nodes, scopes)
        owned = owned if "" in scopes else owned.where(F.col("scope") != "")
    else:
        owned = nodes.withColumn("scope", F.lit(""))
    placed = grouped(owned)
    entries = materialize(dir_entries(placed))
    path = F.collate(F.col("path"), "UNICODE") if icu else F.col("path")
    kept = top_per_group(entries, ["scope"], [F.col("symbols").desc(), path], max_dirs)
    dropped = entries.groupBy("scope").agg(F.greatest(F.count("*") - max_dirs, F.lit(0)).alias("dropped"))
    kept = materialize(kept)
    inside = placed.join(broadcast_if_small(kept.select("scope", "dir")), ["scope", "dir"], "left_semi")
    return RepoMap(
        totals(nodes, edges), kept, dropped,
        dir_hubs(inside, edges, hubs_per_dir, icu), hotspots(nodes, edges, n_hotspots, icu),
    )
