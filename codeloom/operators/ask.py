"""Ranked free-text questions over a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ranking import top_per_group
from ..session import broadcast_if_small, materialize
from . import lexical
from .fuse import fuse_scopes, strong_enough
from .links import Links
from .pagerank import personalized_pagerank

# Fixed values of the blend.
GRAPH_WEIGHT = 0.5
RESCUE_FLOOR = 0.15

# Distributed sums differ in their last bits from run to run.  Scores are cut
# to this many places so that equal scores stay equal and ranks repeatable.
SCORE_PLACES = 9

HIT_COLUMNS = ["kind", "title", "pointer", "snippet", "related", "scope", "score", "coverage", "coverage_strong"]


def with_labels(nodes: DataFrame) -> DataFrame:
    """Add what a hit shows: title, pointer and snippet."""
    cols = nodes.columns
    summary = F.col("summary") if "summary" in cols else F.lit(None).cast("string")
    signature = F.col("signature") if "signature" in cols else F.lit(None).cast("string")
    return nodes.withColumns({
        "title": F.concat_ws(" · ", "name", "kind"),
        "pointer": F.when(F.col("kind") == "file", F.col("path")).otherwise(
            X.pointer(F.col("path"), F.col("start_line"), F.col("end_line"))),
        "snippet": X.snippet(summary, signature),
    })


LABELS = ["title", "pointer", "snippet"]


def blend(scored: lexical.Scored, pr: DataFrame | None, by: list[str]) -> DataFrame:
    """Lexical score, scaled to its best, plus weighted centrality.

    Nodes without a word match join when the walk ranks them high enough.
    """
    hits = scored.hits
    if by:
        tops = broadcast_if_small(hits.groupBy(*by).agg(F.max("lex").alias("top")))
        hits, top = hits.join(tops, by), F.col("top")
    else:
        best = hits.agg(F.max("lex")).first()[0]
        top = F.lit(best)
    keep = ["id", *by, *LABELS]
    if pr is None:
        return hits.select(*keep, F.round(F.col("lex") / top, SCORE_PLACES).alias("score"), "coverage", "coverage_strong")
    ranks = pr.select("id", "pr")
    lexical_part = hits.join(ranks, "id", "left").select(
        *keep,
        F.round(F.col("lex") / top + GRAPH_WEIGHT * F.coalesce("pr", F.lit(0.0)), SCORE_PLACES).alias("score"),
        "coverage", "coverage_strong",
    )
    rescued = rescue(scored, ranks, by)
    return lexical_part.unionByName(rescued.select(*keep, "score", "coverage", "coverage_strong"))


def rescue(scored: lexical.Scored, ranks: DataFrame, by: list[str]) -> DataFrame:
    """Nodes no word matched that the walk finds central."""
    central = ranks.where(F.col("pr") >= RESCUE_FLOOR).join(scored.hits.select("id"), "id", "left_anti")
    rows = scored.matches.join(central, "id")
    covered = lexical.coverage_of(rows, scored.stats, by)
    return rows.select("id", *by, *LABELS, F.round(GRAPH_WEIGHT * F.col("pr"), SCORE_PLACES).alias("score")).join(
        covered.drop(*by), "id")


def _title_order(icu: bool) -> Column:
    title = F.collate(F.col("title"), "UNICODE") if icu else F.col("title")
    return title.asc()


def unique_hits(scored: lexical.Scored) -> lexical.Scored:
    """One hit per id: the last definition wins."""
    rest = [c for c in scored.hits.columns if c != "id"]
    hits = scored.hits.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("ord")).alias("r")).select(
        "id", *[F.col(f"r.{c}").alias(c) for c in rest])
    rest_m = [c for c in scored.matches.columns if c != "id"]
    matches = scored.matches.groupBy("id").agg(F.max_by(F.struct(*rest_m), F.col("ord")).alias("r")).select(
        "id", *[F.col(f"r.{c}").alias(c) for c in rest_m])
    return lexical.Scored(hits, matches, scored.stats)


@dataclass
class Ranking:
    hits: DataFrame                     # every candidate: id, scope, labels, score, coverage…
    federated: DataFrame | None = None  # scopes that took part
    also_matched: DataFrame | None = None
    matches: DataFrame | None = None    # compact row of every document


def rank_nodes(
    nodes: DataFrame,
    edges: DataFrame | None,
    query: str,
    prefix: str | None = None,
    concepts: lexical.ConceptStats | None = None,
    duplicate_ids: bool = False,
    index: lexical.TokenIndex | None = None,
    links: Links | None = None,
) -> Ranking:
    """Rank all nodes as one corpus.

    A prefix is part of the question: it bounds the corpus the statistics and
    the walk see, so it is applied before anything is counted, and the walk
    then cannot use the stored ``links`` of the whole graph.
    """
    docs = with_labels(nodes)
    if prefix:
        docs = docs.where(X.under_prefix(F.col("path"), prefix))
    keep = [*LABELS, *(["ord"] if duplicate_ids else [])]
    scored = lexical.score_corpus(docs, query, keep, concepts=concepts, index=index, whole=not prefix)
    if duplicate_ids:
        scored = unique_hits(scored)
    scored.hits = materialize(scored.hits)
    if scored.hits.isEmpty():
        none = scored.hits.withColumn("score", F.lit(0.0)).withColumn("scope", F.lit(""))
        return Ranking(none.select("id", "scope", *LABELS, "score", "coverage", "coverage_strong"), matches=scored.matches)
    pr = None
    if edges is not None:
        seeds = scored.hits.select("id", F.col("lex").alias("weight"))
        pr = personalized_pagerank(docs, edges, seeds, links=links if not prefix else None)
    return Ranking(blend(scored, pr, []).withColumn("scope", F.lit("")), matches=scored.matches)


def rank_scopes(
    nodes: DataFrame,
    edges: DataFrame | None,
    query: str,
    prefix: str | None = None,
    concepts: lexical.ConceptStats | None = None,
    limit: int | None = None,
    duplicate_ids: bool = False,
    index: lexical.TokenIndex | None = None,
    links: Links | None = None,
) -> Ranking:
    """Rank every scope on its own statistics, then fuse the orderings.

    ``nodes`` carries ``scope``.  A scope whose best hit is a weak match is
    left out and listed in ``also_matched``; only the others are walked.
    """
    docs = with_labels(nodes)
    if prefix:
        docs = docs.where(X.under_prefix(F.col("path"), prefix))
    by = ["scope"]
    keep = [*LABELS, *(["ord"] if duplicate_ids else [])]
    scored = lexical.score_corpus(docs, query, keep, by, concepts, index)
    if duplicate_ids:
        scored = unique_hits(scored)
    scored.hits = materialize(scored.hits)
    gate = scope_gate(scored.hits)
    passing = broadcast_if_small(gate.where("joins").select("scope"))
    weak = gate.where(~F.col("joins")).select("scope", "best_id")
    scored.hits = materialize(scored.hits.join(passing, "scope", "left_semi"))
    if scored.hits.isEmpty():
        none = scored.hits.withColumn("score", F.lit(0.0))
        return Ranking(none.select("id", "scope", *LABELS, "score", "coverage", "coverage_strong"), None, weak, scored.matches)
    pr = None
    if edges is not None:
        seeds = scored.hits.select("id", F.col("lex").alias("weight"))
        inside = docs.select("id", "scope").join(passing, "scope", "left_semi")
        # seeds lie in passing scopes, and stored links never leave a scope
        pr = personalized_pagerank(inside, edges, seeds, by, links=links if not prefix else None)
    blended = materialize(blend(scored, pr, by))
    fused = fuse_scopes(blended, limit, disjoint=True)
    labels = blended.select("id", *LABELS, "coverage", "coverage_strong")
    return Ranking(
        fused.ranked.join(labels, "id"), fused.federated.select("scope"),
        weak.unionByName(fused.also_matched), scored.matches,
    )


def scope_gate(hits: DataFrame) -> DataFrame:
    """Best raw hit per scope and whether it lets the scope join."""
    best = F.min(F.struct((-F.col("lex")).alias("neg"), F.col("id"), F.col("coverage"), F.col("coverage_strong")))
    return hits.groupBy("scope").agg(best.alias("b")).select(
        "scope", F.col("b.id").alias("best_id"),
        F.col("b.coverage").alias("coverage"), F.col("b.coverage_strong").alias("coverage_strong"),
        strong_enough(F.col("b.coverage_strong"), F.col("b.coverage")).alias("joins"),
    )


def top_hits(hits: DataFrame, limit: int, icu: bool = False) -> DataFrame:
    return hits.orderBy(F.col("score").desc(), _title_order(icu), F.col("id").asc()).limit(limit)


def ask(
    nodes: DataFrame,
    edges: DataFrame | None,
    query: str,
    limit: int = 8,
    scopes: list[str] | None = None,
    prefix: str | None = None,
    concepts: DataFrame | None = None,
    duplicate_ids: bool = True,
    index: lexical.TokenIndex | None = None,
    links: Links | None = None,
) -> tuple[DataFrame, Ranking]:
    """Top hits over nodes and concept notes, in the order a user sees.

    ``edges=None`` ranks by words alone.  ``links`` are the stored link tables of
    the graph, inside scopes where there are several.  ``concepts``: slug, name, sources
    (array), related (array), snippet, text.
    """
    from .scopes import with_scope

    prefix = prefix.rstrip("/") if prefix else None
    stats = None
    terms = X.query_terms(query)
    if concepts is not None and terms:
        if prefix:
            concepts = concepts.where(F.exists("sources", lambda p: X.under_prefix(p, prefix)))
        stats, matched = lexical.concept_matches(concepts, query)
    if scopes and len(scopes) > 1:
        ranking = rank_scopes(with_scope(nodes, scopes), edges, query, prefix, stats, limit, duplicate_ids, index, links)
    else:
        ranking = rank_nodes(nodes, edges, query, prefix, stats, duplicate_ids, index, links)
    symbols = ranking.hits.select(
        F.lit("symbol").alias("kind"), "title", "pointer", "snippet",
        F.lit(None).cast("array<string>").alias("related"), "scope", "score",
        "coverage", "coverage_strong", "id",
    )
    hits = symbols
    if stats is not None:
        hits = symbols.unionByName(_concept_hits(
            concepts, matched, stats, terms, ranking.matches, index if not prefix else None))
    return top_hits(hits, limit, icu=True).select(*HIT_COLUMNS), ranking


def _concept_hits(
    concepts: DataFrame, matched: DataFrame, stats: lexical.ConceptStats, terms: list[str], matches: DataFrame,
    index: lexical.TokenIndex | None = None,
) -> DataFrame:
    """Concept notes, weighed by the corpus as a whole and scaled to their best."""
    known = index is not None and index.frequencies is not None
    one = (index.stats(terms, stats) if known else lexical.corpus_stats(matches, terms, [], stats)).first()
    weights = F.array(*[F.lit(float(v)) for v in one["idf"]])
    scored = materialize(lexical.score_concepts(matched, weights))
    top = scored.agg(F.max("raw")).first()[0] or 1.0
    joined = scored.join(concepts.withColumnRenamed("slug", "id"), "id")
    return joined.select(
        F.lit("concept").alias("kind"),
        F.coalesce(F.nullif("name", F.lit("")), "id").alias("title"),
        F.coalesce(F.nullif(F.concat_ws(", ", "sources"), F.lit("")), "id").alias("pointer"),
        "snippet", "related", F.lit("").alias("scope"),
        (F.col("raw") / F.lit(top)).alias("score"), "coverage", "coverage_strong", "id",
    )


def scope_tops(hits: DataFrame, k: int) -> DataFrame:
    """Best ``k`` raw hits of every scope."""
    return top_per_group(hits, ["scope"], [F.col("lex").desc(), F.col("id").asc()], k)
