"""Personalized PageRank as a loop of joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint_dir, drop_files, dropping_shuffles, materialize, store_table
from . import blocks as BL
from .adjacency import LINKS_PER_SALT, adjacency
from .links import Links, walk_links

# Fixed values of the ranking.
ALPHA = 0.25
ITERATIONS = 25

CHECKPOINT_EVERY = 5


def _teleport(q: Column, step: int, alpha: float) -> Column:
    """Share of the seed weights that returns to the seeds at ``step``.

    Nodes without links pass their whole mass back to the seeds.  They are
    fed by the seeds alone, so that mass follows a geometric series in
    ``q = (1 - alpha) * (seed weight on such nodes)`` and needs no pass over
    the data.
    """
    power = F.pow(q, F.lit(float(step + 1)))
    return alpha * (1 - power) / (1 - q) + power


def personalized_pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    by: list[str] | None = None,
    alpha: float = ALPHA,
    iterations: int = ITERATIONS,
    links_per_salt: int = LINKS_PER_SALT,
    links: Links | BL.Blocks | None = None,
) -> DataFrame:
    """Centrality of nodes around weighted ``seeds`` (id, weight).

    The graph is an undirected multigraph over the walk relations.  ``nodes``
    bounds the walk: pass a filtered table to walk a subgraph.  With ``by``
    every group is walked on its own.  With stored ``links`` of the same groups
    neither nodes nor edges are read.  Returns (id, by…, pr), the top node of
    each group at 1; nodes the walk never reaches are absent.
    """
    by = by or []
    if links is None:
        links = walk_links(nodes, edges, by, lambda shares: adjacency(shares, links_per_salt))
    elif links.by != by:
        raise ValueError(f"links are stored for groups {links.by}, not {by}")
    if isinstance(links, BL.Blocks):
        return _over_blocks(links, seeds, alpha, iterations)
    known, adj = links.numbers.where("is_node"), links.walk

    start = seeds.where(F.col("weight") > 0).groupBy("id").agg(F.sum("weight").alias("weight")).join(known, "id")
    start = materialize(start.select(F.col("n").alias("id"), *by, "weight").join(
        adj.salts.withColumnRenamed("src", "id"), "id", "left").withColumn("salts", F.coalesce("salts", F.lit(0))))
    sums = start.groupBy(*by).agg(
        F.sum("weight").alias("total"),
        F.coalesce(F.sum(F.when(F.col("salts") == 0, F.col("weight"))), F.lit(0.0)).alias("loose"),
    )
    if by:
        start = start.join(broadcast_if_small(sums), by)
    else:
        one = sums.first()  # two numbers
        if not one["total"]:
            return known.where(F.lit(False)).select("id", F.lit(0.0).alias("pr"))
        start = start.withColumns({"total": F.lit(one["total"]), "loose": F.lit(one["loose"])})
    start = materialize(start.select(
        "id",
        (F.col("weight") / F.col("total")).alias("w"),
        ((1 - alpha) * F.col("loose") / F.col("total")).alias("q"),
    ))

    rank = start.select("id", F.col("w").alias("r"))
    for step in range(iterations):
        moved = adj.expand(rank, everywhere=True).select(F.col("dst").alias("id"), ((1 - alpha) * F.col("r") * F.col("share")).alias("v"))
        home = start.select("id", (F.col("w") * _teleport(F.col("q"), step, alpha)).alias("v"))
        rank = moved.unionAll(home).groupBy("id").agg(F.sum("v").alias("r"))
        if (step + 1) % CHECKPOINT_EVERY == 0 or step == iterations - 1:
            rank = materialize(rank)

    named = rank.withColumnRenamed("id", "n").join(known, "n").select("id", *by, "r")
    if by:
        placed = materialize(named)
        top = broadcast_if_small(placed.groupBy(*by).agg(F.max("r").alias("top")))
        return placed.join(top, by).select("id", *by, (F.col("r") / F.col("top")).alias("pr"))
    top = rank.agg(F.max("r")).first()[0]
    return named.select("id", (F.col("r") / F.lit(top)).alias("pr"))


def _over_blocks(blocks: BL.Blocks, seeds: DataFrame, alpha: float, iterations: int) -> DataFrame:
    """The same walk with packed numbers; seeds without links are told apart before it."""
    by, spark = blocks.by, seeds.sparkSession
    start = seeds.where(F.col("weight") > 0).groupBy("id").agg(F.sum("weight").alias("weight"))
    start = start.withColumn("n", BL.id_hash(F.col("id"), blocks.seed)).join(blocks.ids, ["n", "id"])
    start = start.join(blocks.linked().withColumn("linked", F.lit(True)), "n", "left").select(
        "n", *by, "weight", F.coalesce("linked", F.lit(False)).alias("linked"))
    with dropping_shuffles(spark):
        start, _ = store_table(start)
    loose = F.coalesce(F.sum(F.when(~F.col("linked"), F.col("weight"))), F.lit(0.0))
    sums = start.groupBy(*by).agg(F.sum("weight").alias("total"), ((1 - alpha) * loose / F.sum("weight")).alias("q"))
    one = None
    if by:
        start = start.join(broadcast_if_small(sums), by)
    else:
        one = sums.first()  # two numbers
        if not one["total"]:
            return blocks.ids.where(F.lit(False)).select("id", F.lit(0.0).alias("pr"))
        start = start.withColumns({"total": F.lit(one["total"]), "q": F.lit(one["q"])})
    start = materialize(start.select("n", "linked", (F.col("weight") / F.col("total")).alias("w"), "q"))
    steps = f"{checkpoint_dir(spark)}/steps/{uuid.uuid4().hex}"
    rank = BL.ranks(blocks, start.where("linked").drop("linked"), alpha, iterations, one["q"] if one else None, steps)
    back = _teleport(F.col("q"), iterations - 1, alpha) if iterations else F.lit(1.0)
    with dropping_shuffles(spark):
        rank, _ = store_table(rank.unionAll(start.where("NOT linked").select("n", (F.col("w") * back).alias("r"))))
    drop_files(spark, steps)
    if by:
        placed = materialize(rank.join(blocks.ids, "n").select("id", *by, "r"))
        top = broadcast_if_small(placed.groupBy(*by).agg(F.max("r").alias("top")))
        return placed.join(top, by).select("id", *by, (F.col("r") / F.col("top")).alias("pr"))
    top = rank.agg(F.max("r")).first()[0]
    return rank.join(blocks.ids, "n").select("id", (F.col("r") / F.lit(top)).alias("pr"))
