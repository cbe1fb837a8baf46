"""Render-ready graphs: normalized verbs, no dangling edges."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread_by

# Vague verbs and what they are shown as.
NORMALIZED = {"influences": "configures", "supports": "validates", "defines": "validates", "measures": "validates"}

# The family of each verb; any other verb is an association.
FAMILIES: dict[str, list[str]] = {
    "structure": ["part_of", "contains"],
    "dependency": ["uses", "depends_on", "calls", "imports", "produces", "configures", "validates"],
    "contract": ["extends", "implements"],
}
# Fixed value: verbs shown under the one chip "uses".
USES_CHIP = ["calls", "uses", "depends_on", "imports"]

GENERATED_START = "<!-- context:generated:start -->"
GENERATED_END = "<!-- context:generated:end -->"
SUMMARY_MAX = 500


def normalize_relation(relation: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain(*NORMALIZED.items())])
    return F.coalesce(F.try_element_at(table, relation), relation)


def extract_summary(body: Column) -> Column:
    """The summary section of a note's generated block, cut at 500 characters."""
    start, end = F.instr(body, GENERATED_START), F.instr(body, GENERATED_END)
    inner = F.substring(body, start + len(GENERATED_START), end - start - len(GENERATED_START))
    block = F.when((start > 0) & (end > start), inner).otherwise(body)
    head = F.substring_index(block, "## Related", 1)
    flat = F.regexp_replace(F.regexp_replace(head, r"(?m)^##\s+Summary\s*$", ""), r"^\s+|\s+$", "")
    cut = F.regexp_replace(F.substring(flat, 1, SUMMARY_MAX), r"\s+$", "")
    return F.when(F.length(flat) > SUMMARY_MAX, F.concat(cut, F.lit("…"))).otherwise(flat)


def real_edges(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges with both endpoints present; ``parts`` partitions bound what a task sorts."""
    ids = spread_by(nodes.select("id"), parts, "id")  # repeated ids change nothing here
    begun = spread_by(edges, parts, "source").join(ids.select(F.col("id").alias("source")), "source", "left_semi")
    return spread_by(begun, parts, "target").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def assemble(notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and counts of a concept graph.

    ``notes``: slug, name, type, body, sources, links, and ``broken`` for
    files that could not be parsed; those are counted and skipped.
    """
    good = notes.where(~F.col("broken"))
    nodes = good.select(
        F.col("slug").alias("id"), F.coalesce("name", "slug").alias("name"),
        F.coalesce("type", F.lit("concept")).alias("type"), extract_summary(F.col("body")).alias("summary"),
        F.transform("sources", lambda s: s["path"]).alias("sources"),
    )
    said = good.select(F.col("slug").alias("source"), F.explode("links").alias("l")).where(
        F.col("l.to").isNotNull()
    ).select("source", F.col("l.to").alias("target"),
             normalize_relation(F.coalesce("l.relation", F.lit("uses"))).alias("relation"),
             F.col("l.description").alias("description"))
    edges = real_edges(nodes, said)
    meta = notes.agg(
        F.sum((~F.col("broken")).cast("long")).alias("node_count"),
        F.sum(F.col("broken").cast("long")).alias("skipped_files"),
    ).withColumns({"edge_count": F.lit(edges.count()), "said": F.lit(said.count())})
    return nodes, edges, meta.withColumn("dropped_edges", F.col("said") - F.col("edge_count")).drop("said")


def family(relation: Column) -> Column:
    out = F.lit("association")
    for name, verbs in FAMILIES.items():
        out = F.when(relation.isin(*verbs), name).otherwise(out)
    return out


def chip(relation: Column) -> Column:
    """Filter chip of a verb: the structure verbs, the use verbs, or the verb itself."""
    return (
        F.when(family(relation) == "structure", "part of").when(relation.isin(*USES_CHIP), "uses")
        .otherwise(F.regexp_replace(relation, "_", " "))
    )


def chip_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(chip(F.col("relation")).alias("chip"), family(F.col("relation")).alias("family")).agg(
        F.count("*").alias("n"))
