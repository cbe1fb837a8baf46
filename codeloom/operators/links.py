"""The wiring of one graph version, prepared once; questions only read it.

Nodes are numbered, and the links of a number lie in buckets in three tables:
``walk`` has both directions between known nodes with the share of a node's rank
that each link carries, ``into`` and ``out`` have one direction each with the
smallest relation.  Ends of links that are no node are numbered as well.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import walk_edges
from ..session import materialize
from .adjacency import LINKS_PER_SALT, Adjacency, adjacency, read_bucketed, stored_adjacency

WAYS = ("walk", "into", "out")


@dataclass
class Links:
    numbers: DataFrame    # id, n, is_node, group columns
    by: list[str]         # ``walk`` stays inside a group of these
    walk: Adjacency | None = None
    into: Adjacency | None = None
    out: Adjacency | None = None


def numbered(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Distinct nodes with a number each, which a loop uses instead of the id.

    The numbers are stored, so every use of the table sees the same ones.
    """
    return materialize(nodes.select("id", *by).dropDuplicates(["id"]).withColumn("n", F.monotonically_increasing_id()))


def inner_edges(known: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Walk edges between known nodes, as numbers; with ``by``, only inside one group."""
    walk = walk_edges(edges).select("source", "target")
    left = known.select(F.col("id").alias("source"), F.col("n").alias("a"), *[F.col(c).alias(f"s_{c}") for c in by])
    right = known.select(F.col("id").alias("target"), F.col("n").alias("b"), *[F.col(c).alias(f"t_{c}") for c in by])
    joined = walk.join(left, "source").join(right, "target")
    for c in by:
        joined = joined.where(F.col(f"s_{c}") == F.col(f"t_{c}"))
    return joined.select("a", "b")


def _shares(inside: DataFrame) -> DataFrame:
    """(src, dst, share): both directions of ``inside`` (a, b), a multigraph."""
    # one pass over the edges gives both directions
    both = inside.select(F.explode(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("l")).select("l.src", "l.dst")
    links = materialize(both.groupBy("src", "dst").agg(F.count("*").alias("mult")))
    degree = links.groupBy("src").agg(F.sum("mult").alias("deg"))
    return materialize(links.join(degree, "src").select("src", "dst", (F.col("mult") / F.col("deg")).alias("share")))


def walk_links(nodes: DataFrame, edges: DataFrame, by: list[str], prepare) -> Links:
    """Links for a walk over some nodes only; ``prepare`` packs them."""
    known = numbered(nodes, by)
    return Links(known.withColumn("is_node", F.lit(True)), by, prepare(_shares(inner_edges(known, edges, by))))


def _pairs(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """(a, b, relation) of the walk edges as numbers, the smallest relation of each pair."""
    n = numbers.select("id", "n")
    pairs = walk_edges(edges).join(n.select(F.col("id").alias("source"), F.col("n").alias("a")), "source").join(
        n.select(F.col("id").alias("target"), F.col("n").alias("b")), "target")
    return materialize(pairs.groupBy("a", "b").agg(F.min("relation").alias("relation")))


def directed(edges: DataFrame, direction: str, prepare) -> Links:
    """Links of one direction of some edges, with all their ends numbered; ``prepare`` packs them."""
    walk = walk_edges(edges)
    ends = walk.select(F.col("source").alias("id")).union(walk.select("target")).distinct()
    numbers = materialize(ends.withColumn("n", F.monotonically_increasing_id()))
    src, dst = ("b", "a") if direction == "in" else ("a", "b")
    adj = prepare(_pairs(edges, numbers).select(F.col(src).alias("src"), F.col(dst).alias("dst"), "relation"))
    return Links(numbers, [], **{"into" if direction == "in" else "out": adj})


def number(nodes: DataFrame, edges: DataFrame, at: str, by: list[str] | None = None) -> Links:
    """Number the nodes of a graph and the ends of its walk edges, stored below ``at``."""
    by, spark = by or [], nodes.sparkSession
    ends = walk_edges(edges).select(F.explode(F.array("source", "target")).alias("id"))
    ids = nodes.select("id", *by, F.lit(True).alias("is_node")).unionByName(ends.withColumn("is_node", F.lit(False)), allowMissingColumns=True)
    named = ids.groupBy("id").agg(F.max("is_node").alias("is_node"), *[F.min(c).alias(c) for c in by])
    named.withColumn("n", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{at}/numbers")
    return Links(spark.read.parquet(f"{at}/numbers"), by)


def add(links: Links, way: str, edges: DataFrame, at: str, links_per_salt: int = LINKS_PER_SALT) -> Links:
    """Store one of the tables ``WAYS`` of a graph whose nodes are numbered."""
    spark = links.numbers.sparkSession
    if way == "walk":
        rows = _shares(inner_edges(links.numbers.where("is_node"), edges, links.by))
    else:
        src, dst = ("b", "a") if way == "into" else ("a", "b")
        rows = _pairs(edges, links.numbers).select(F.col(src).alias("src"), F.col(dst).alias("dst"), "relation")
    made = adjacency(rows, links_per_salt, at=f"{at}/{way}")
    made.salts.write.mode("overwrite").parquet(f"{at}/{way}_salts")
    made.salts = spark.read.parquet(f"{at}/{way}_salts")
    return replace(links, **{way: made})


def build(nodes: DataFrame, edges: DataFrame, at: str, by: list[str] | None = None, links_per_salt: int = LINKS_PER_SALT) -> Links:
    """Number the nodes of a graph and store its three link tables below ``at``."""
    links = number(nodes, edges, at, by)
    for way in WAYS:
        links = add(links, way, edges, at, links_per_salt)
    return links


def read(spark: SparkSession, at: str, buckets: dict[str, int], by: list[str] | None = None) -> Links:
    """The tables that earlier calls left below ``at``; ``buckets`` names them with their buckets."""
    payload = {"walk": "share", "into": "relation", "out": "relation"}
    made = {
        way: stored_adjacency(read_bucketed(spark, f"{at}/{way}", ["src"], n), ["dst", payload[way]], spark.read.parquet(f"{at}/{way}_salts"))
        for way, n in buckets.items()}
    return Links(spark.read.parquet(f"{at}/numbers"), by or [], **made)
