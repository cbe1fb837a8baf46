"""Questions over several repositories at once.

All repositories live in one table with a ``repo`` column; a federated
question is the plain plan with ``repo`` among its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_per_group
from ..session import materialize
from . import ask as A
from .fuse import Fusion, fuse_scopes, strong_enough
from .grep import group_hits, innermost_span, matching_lines
from .links import Links
from .repomap import HUBS_PER_DIR, MAX_DIRS, dir_entries, dir_hubs, grouped
from .walk import impact, one_hop, symbol_tier


def qualify(df: DataFrame, *columns: str) -> DataFrame:
    """Prefix ids and paths with their repository, so they never collide."""
    return df.withColumns({c: F.concat_ws("/", F.col("repo"), F.col(c)) for c in columns})


def over_fetch(limit: int) -> int:
    return max(4 * limit, 20)


def federate_ask(nodes: DataFrame, edges: DataFrame | None, query: str, limit: int = 8, only: str | None = None) -> Fusion:
    """Rank each repository on its own, gate by match strength, fuse by rank.

    ``nodes`` and ``edges`` carry qualified ids.  A repository enters with its
    best candidates only, as each repository answers with a page of hits.
    With ``only`` the caller has chosen the repository and no gate applies.
    """
    docs = nodes.withColumn("scope", F.col("repo"))
    if only is not None:
        docs = docs.where(F.col("repo") == only)
    own = materialize(_per_repo(docs, edges, query))
    page = materialize(top_per_group(own, ["scope"], [F.col("score").desc(), F.col("id")], over_fetch(limit)))  # in the order of the fusion
    head = page.where(F.col("rank") == 1)
    joins = F.lit(True) if only is not None else strong_enough(F.col("coverage_strong"), F.col("coverage"))
    passing = head.where(joins).select("scope")
    weak = head.where(~joins).select("scope", F.col("id").alias("best_id"))
    fused = fuse_scopes(page.join(passing, "scope", "left_semi"), limit, disjoint=True)
    labels = page.select("id", *A.LABELS)
    return Fusion(fused.ranked.join(labels, "id"), fused.federated, weak.unionByName(fused.also_matched))


def _per_repo(docs: DataFrame, edges: DataFrame | None, query: str) -> DataFrame:
    from . import lexical
    from .pagerank import personalized_pagerank

    labelled = A.with_labels(docs)
    scored = lexical.score_corpus(labelled, query, A.LABELS, ["scope"])
    scored.hits = materialize(scored.hits)
    pr = None
    if edges is not None:
        seeds = scored.hits.select("id", F.col("lex").alias("weight"))
        pr = personalized_pagerank(labelled.select("id", "scope"), edges, seeds, ["scope"])
    return A.blend(scored, pr, ["scope"])


def federate_grep(
    nodes: DataFrame, edges: DataFrame, files: DataFrame, pattern: str, max_hits: int | None = None, **flags
) -> tuple[DataFrame, DataFrame]:
    """Grouped hits over all repositories and the counts; a page, if asked for, is per repository.

    Paths are qualified; ``files`` carries ``repo``.
    """
    found = materialize(
        matching_lines(files, pattern, **flags).join(files.select("path", "repo"), "path"))
    if max_hits is None:
        max_hits = (1 << 31) - 1
    counts = found.groupBy("repo").agg(F.count("*").alias("n")).select(
        "repo", F.least("n", F.lit(max_hits)).alias("total_hits"),
        F.greatest(F.col("n") - max_hits, F.lit(0)).alias("dropped"))
    listed = materialize(top_per_group(found, ["repo"], [F.col("path"), F.col("line")], max_hits).drop("rank"))
    symbols = nodes.where(F.col("kind") != "file").join(listed.select("path").distinct(), "path", "left_semi")
    hits = innermost_span(listed, symbols.select("id", "path", "start_line", "end_line", "ord"))
    return group_hits(hits, edges), counts


def federate_map(nodes: DataFrame, edges: DataFrame, max_dirs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Directory entries and hubs per repository; the row budget is split evenly."""
    placed = grouped(nodes.withColumn("scope", F.col("repo")))
    entries = materialize(dir_entries(placed))
    repos = entries.select("scope").distinct().count()
    budget = MAX_DIRS if max_dirs is None else max(1, max_dirs // max(repos, 1))
    kept = materialize(top_per_group(entries, ["scope"], [F.col("symbols").desc(), F.col("path")], budget))
    inside = placed.join(kept.select("scope", "dir"), ["scope", "dir"], "left_semi")
    return kept, dir_hubs(inside, edges, HUBS_PER_DIR)


def federate_check(stored: DataFrame, current: DataFrame, known: DataFrame) -> DataFrame:
    """Drift counts per repository (repo, built, added, removed, changed, stale, ok).

    A repository that was never built is listed but never fails the check.
    """
    from .drift import check_graph

    repo_of = stored.select("id", "repo").unionByName(current.select("id", "repo")).distinct()
    built = stored.select("repo").distinct().withColumn("built", F.lit(True))
    found = check_graph(stored, current).join(repo_of, "id")
    counts = found.groupBy("repo").agg(*[
        F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("added", "removed", "changed", "stale")])
    rows = known.join(built, "repo", "left").join(counts, "repo", "left")
    rows = rows.select("repo", F.coalesce("built", F.lit(False)).alias("built"),
                       *[F.coalesce(s, F.lit(0)).alias(s) for s in ("added", "removed", "changed", "stale")])
    drift = F.col("added") + F.col("removed") + F.col("changed") + F.col("stale")
    return rows.withColumn("ok", ~F.col("built") | (drift == 0))


def federate_callers(
    nodes: DataFrame, edges: DataFrame, symbol: str, direction: str = "in", depth: int | None = 1, within: str | None = None,
    links: Links | None = None,
) -> DataFrame:
    """Walks from a symbol in every repository that has it.

    The symbol tier is chosen per repository: a weak match in one does not
    depend on what another holds.  Each match is walked on its own; rows say
    which ``symbol`` they belong to, and its ``repo``.
    """
    tiered = nodes.withColumn("tier", symbol_tier(symbol)).where(F.col("tier").isNotNull())
    best = tiered.groupBy("repo").agg(F.min("tier").alias("best"))
    found = tiered.join(best, "repo").where(F.col("tier") == F.col("best"))
    if within:
        found = found.where(F.contains(F.col("path"), F.lit(within)))
    found = materialize(found.select("id", "repo", F.col("id").alias("symbol")).distinct())
    if depth is not None and depth <= 1:
        hits = one_hop(nodes, edges, found, direction)
    else:
        hits = impact(edges, found.drop("repo"), depth, direction, links=links).join(
            nodes.select("id", "name", "kind", "path"), "id", "left")
    return hits.join(found.select("symbol", "repo"), "symbol")
