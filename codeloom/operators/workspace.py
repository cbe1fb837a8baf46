"""One table of several repositories: who owns what, and what is covered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scopes import with_scope


@dataclass
class Split:
    nodes: DataFrame     # all columns and repo; '' owns what lies in no repository
    edges: DataFrame     # all columns and repo: links that stay inside, or lead to a name that is no node
    crossing: DataFrame  # all columns, repo and target_repo: links that a repository alone does not have


def split_graph(nodes: DataFrame, edges: DataFrame, repos: DataFrame) -> Split:
    """Cut a graph over several repositories into one graph each.

    ``repos`` has the folders (prefix).  A node belongs to the deepest folder
    around its path.  A link belongs to the repository of its source.
    """
    owned = with_scope(nodes, repos, out="repo")
    of = owned.select("id", "repo").dropDuplicates(["id"])
    placed = edges.join(of.select(F.col("id").alias("source"), "repo"), "source").join(
        of.select(F.col("id").alias("target"), F.col("repo").alias("target_repo")), "target", "left")
    inside = F.col("target_repo").isNull() | (F.col("target_repo") == F.col("repo"))
    return Split(owned, placed.where(inside).drop("target_repo"), placed.where(~inside))


def coverage(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every listed repository (repo) with its number of files and whether it has a graph at all."""
    files = nodes.groupBy("repo").agg(F.sum((F.col("kind") == "file").cast("long")).alias("files"))
    return known.select("repo").distinct().join(files, "repo", "left").select(
        "repo", F.col("files").isNotNull().alias("built"), F.coalesce("files", F.lit(0).cast("long")).alias("files"))


def coverage_note(total: int, missing: list[str]) -> str:
    if not missing:
        return ""
    return f"{total - len(missing)} of {total} repositories are built; not covered: {', '.join(missing)}"
