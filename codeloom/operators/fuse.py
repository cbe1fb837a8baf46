"""Reciprocal rank fusion across scopes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import distributed_rank, top_per_group
from ..session import broadcast_if_small, materialize

# Fixed values of the fusion.
RRF_K = 60
PARTICIPATION_RATIO = 0.25
STRONG_FLOOR = 0.1
HIGH_FLOOR = 0.5


def strong_enough(strong, coverage):
    """Whether a top hit is a real match rather than a stray word."""
    return (strong >= STRONG_FLOOR) | (coverage >= HIGH_FLOOR)


@dataclass
class Fusion:
    ranked: DataFrame        # id, scope, score
    federated: DataFrame     # scope, best_score, best_id
    also_matched: DataFrame  # scope, best_id


def scope_bests(docs: DataFrame) -> DataFrame:
    """Best document per scope; equal scores go to the smaller id."""
    best = F.min(F.struct((-F.col("score")).alias("neg"), F.col("id")))
    return docs.groupBy("scope").agg(best.alias("b")).select(
        "scope", (-F.col("b.neg")).alias("best_score"), F.col("b.id").alias("best_id"))


def fuse_scopes(docs: DataFrame, limit: int | None = None, disjoint: bool = False) -> Fusion:
    """Fuse scored documents (id, scope, score) of several scopes.

    A lone scope keeps its scores.  With ``disjoint`` ids (no id in two
    scopes) a fused score falls with the rank, so the first ``limit`` rows of
    each scope are all that can reach the first ``limit`` of the result; else
    every row is ranked, spread over the cluster.
    """
    docs = docs.select("id", "scope", "score").where(F.col("score") > 0)
    bests = materialize(scope_bests(docs))
    head = bests.agg(F.count("*").alias("n"), F.max("best_score").alias("top")).first()
    nothing = bests.limit(0).select("scope", "best_id")
    if head["n"] <= 1:
        return Fusion(docs, bests, nothing)
    gate = F.col("best_score") >= PARTICIPATION_RATIO * head["top"]
    federated = bests.where(gate)
    small = broadcast_if_small(federated.select("scope", "best_score"))
    listed = docs.join(small, "scope")
    order = [F.col("score").desc(), F.col("id").asc()]
    if limit is not None and disjoint:
        placed = top_per_group(listed, ["scope"], order, limit)
    else:
        placed = distributed_rank(listed, ["scope"], order)
    part = 1.0 / (RRF_K + F.col("rank"))
    owner = F.min(F.struct("rank", (-F.col("best_score")).alias("neg"), "scope"))
    summed = materialize(placed.groupBy("id").agg(owner.alias("o"), F.sum(part).alias("s")))
    top = summed.agg(F.max("s")).first()[0]
    ranked = summed.select("id", F.col("o.scope").alias("scope"), (F.col("s") / F.lit(top)).alias("score"))
    return Fusion(ranked, federated, bests.where(~gate).select("scope", "best_id"))
