"""Graphs read from tables: star schema, documents, conversations, pages.

Each function gives the DataFrames of one graph.  Node ids are unique here,
so ``ord`` only has to be a stable order.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as BL
from ..operators import links as LN
from ..session import checkpoint_dir, parts_for, spread_by


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly when a scan gives fewer tasks than there are cores, before heavy work per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _key(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(col).cast("string"))


def id_sort(id_: Column) -> Column:
    """What ``_key`` puts before the colon."""
    return F.substring_index(id_, ":", 1)


# --------------------------------------------------------------------------
# the star schema as a graph


def catalog_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to orders as nodes; geography and parts have directory-like paths."""
    t = lambda n: table(spark, sf_dir, n)
    region = t("region")
    nation = t("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    geo = nation.select(
        "n_nationkey", "n_name", F.concat_ws("/", F.lit("region"), "r_name", "n_name").alias("geo_path"))
    null_long = F.lit(None).cast("long")

    def shape(df, prefix, key, name, kind, path, chars):
        return df.select(
            _key(prefix, key).alias("id"), name.alias("name"), F.lit(kind).alias("kind"), path.alias("path"),
            chars.cast("long").alias("chars"), F.col(key).cast("long").alias("ord"))

    return (
        shape(region, "region", "r_regionkey", F.col("r_name"), "file",
              F.concat_ws("/", F.lit("region"), "r_name"), null_long)
        .unionAll(shape(geo, "nation", "n_nationkey", F.col("n_name"), "file", F.col("geo_path"), null_long))
        .unionAll(shape(t("customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")), "customer",
                        "c_custkey", F.col("c_name"), "struct", F.col("geo_path"), F.length("c_name")))
        .unionAll(shape(t("supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey")), "supplier",
                        "s_suppkey", F.col("s_name"), "method", F.col("geo_path"), F.length("s_name")))
        .unionAll(shape(t("part"), "part", "p_partkey", F.col("p_name"), "class",
                        F.concat_ws("/", F.lit("part"), "p_brand", "p_type"), F.col("p_size")))
        .unionAll(shape(t("orders"), "order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")),
                        "function", F.concat_ws("/", F.lit("order"), "o_orderpriority", "o_orderstatus"),
                        F.length("o_orderstatus")))
    ).withColumns({
        "start_line": F.lit(1), "end_line": F.greatest(F.coalesce(F.col("chars"), F.lit(1)), F.lit(1)).cast("int"),
    })


def catalog_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the edges of the catalog; the files tell the rows of its largest table."""
    return parts_for(spark, table(spark, sf_dir, "lineitem").count())


def catalog_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment of the geography plus who ordered what from whom."""
    t = lambda n: table(spark, sf_dir, n)

    def link(df, sp, sk, tp, tk, rel):
        return df.select(_key(sp, sk).alias("source"), _key(tp, tk).alias("target"), F.lit(rel).alias("relation"))

    lines = t("lineitem")
    # hardly a pair of order and part repeats, so these are dealt before they are compared
    ordered = spread_by(lines.select("l_orderkey", "l_partkey"), catalog_parts(spark, sf_dir), "l_orderkey", "l_partkey").distinct()
    return (
        link(t("nation"), "region", "n_regionkey", "nation", "n_nationkey", "contains")
        .unionAll(link(t("customer"), "nation", "c_nationkey", "customer", "c_custkey", "contains"))
        .unionAll(link(t("supplier"), "nation", "s_nationkey", "supplier", "s_suppkey", "contains"))
        .unionAll(link(t("orders"), "order", "o_orderkey", "customer", "o_custkey", "calls"))
        .unionAll(link(ordered, "order", "l_orderkey", "part", "l_partkey", "references"))
        .unionAll(link(lines.select("l_partkey", "l_suppkey").distinct(), "part", "l_partkey", "supplier", "l_suppkey", "imports"))
    )


def catalog(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(catalog_nodes(spark, sf_dir), catalog_edges(spark, sf_dir))


# --------------------------------------------------------------------------
# documents as files

# Section lines: blocks, and sections in the first half of each block.
BLOCK, SECTION = 20, 5


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per document; several lines make it a file, one line a function."""
    d = spread(table(spark, sf_dir, "documents"))
    text = F.col("text")
    return d.select(
        _key("doc", "doc_id").alias("id"),
        F.substring_index(text, "\n", 1).alias("name"),
        F.when(F.contains(text, F.lit("\n")), "file").otherwise("function").alias("kind"),
        F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"),
        F.lit(1).alias("start_line"), F.size(F.split(text, "\n")).alias("end_line"),
        F.length(text).cast("long").alias("chars"),
        text.alias("body_text"),
        "lang", "source",
        F.col("doc_id").alias("ord"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"),
                    F.col("text").alias("content"))


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested sections of every document: blocks of lines, smaller sections inside."""
    d = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"),
        F.size(F.split("text", "\n")).alias("n"))
    blocks = d.select("path", "n", F.explode(F.expr(f"sequence(0, (n - 1) div {BLOCK})")).alias("b"))
    start = F.col("b") * BLOCK + 1
    outer = blocks.select(
        F.concat(F.col("path"), F.lit("#B"), F.col("b").cast("string")).alias("id"), "path",
        start.cast("int").alias("start_line"), F.least(start + BLOCK - 1, F.col("n")).cast("int").alias("end_line"),
        (F.col("b") * 10).cast("long").alias("ord"))
    inner = blocks.select("path", "n", "b", F.explode(F.sequence(F.lit(0), F.lit(BLOCK // 2 // SECTION - 1))).alias("s"))
    first = start + F.col("s") * SECTION
    sections = inner.where(first <= F.col("n")).select(
        F.concat(F.col("path"), F.lit("#B"), F.col("b").cast("string"), F.lit(".S"), F.col("s").cast("string")).alias("id"),
        "path", first.cast("int").alias("start_line"),
        F.least(first + SECTION - 1, F.col("n")).cast("int").alias("end_line"),
        (F.col("b") * 10 + F.col("s") + 1).cast("long").alias("ord"))
    return outer.unionAll(sections)


def copy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exact copy of a document references the first one with that text.

    A star per text: the rows grow with the copies, however many there are.
    Texts are compared by hash, so only hashes travel.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"),
        F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"))
    first = d.groupBy("h").agg(F.min_by(F.struct("doc_id", "path"), "doc_id").alias("f"))
    return d.join(first, "h").where(F.col("doc_id") != F.col("f.doc_id")).select(
        _key("doc", "doc_id").alias("source"),
        F.concat(F.lit("doc:"), F.col("f.doc_id").cast("string")).alias("target"),
        F.lit("references").alias("relation"), "path", F.col("f.path").alias("target_path"))


def span_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies point at the first section of the document they repeat."""
    return copy_edges(spark, sf_dir).select(
        "source", F.concat(F.col("target_path"), F.lit("#B0.S0")).alias("target"), "relation")


# --------------------------------------------------------------------------
# conversations as call chains


def conversation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns as nodes; every turn references the one it answers."""
    c = table(spark, sf_dir, "conversations")
    tid = F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit("#"), F.col("role"), F.lit("."), F.col("turn").cast("string"))
    nodes = c.select(
        tid.alias("id"), F.concat(F.col("role"), F.col("turn").cast("string")).alias("name"),
        F.when(F.col("role") == "user", "function").otherwise("method").alias("kind"),
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"),
        (F.col("turn") + 1).cast("int").alias("start_line"), (F.col("turn") + 1).cast("int").alias("end_line"),
        F.col("text").alias("body_text"), F.length("text").cast("long").alias("chars"),
        "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    a = nodes.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("id").alias("source"))
    b = nodes.select("conv_id", "turn", F.col("id").alias("target"))
    edges = a.join(b, ["conv_id", "turn"]).select("source", "target", F.lit("references").alias("relation"))
    return Graph(nodes, edges)


# --------------------------------------------------------------------------
# stored link tables

_stored: dict[tuple, tuple[LN.Links, str]] = {}
_blocks: dict[tuple, BL.Blocks | None] = {}


def state_of(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """What tells one state of some tables from another: their files with size and time."""
    files = None
    for n in names:
        own = table(spark, sf_dir, n).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        files = own if files is None else files.union(own)
    one = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*files.columns).cast("decimal(20,0)")).alias("sum")).first()
    return one["n"], one["sum"]


_GRAPHS = {
    "catalog": (("region", "nation", "customer", "supplier", "part", "orders", "lineitem"), catalog, []),
    "conversations": (("conversations",), conversation_graph, []),
    "copies": (("documents",), lambda s, d: Graph(
        document_nodes(s, d).select("id", F.col("lang").alias("scope")), copy_edges(s, d)), ["scope"]),
}


def stored_ranks(spark: SparkSession, sf_dir: str, graph: str) -> BL.Blocks | LN.Links:
    """What PageRank reads of a graph, stored like ``stored_links``: links in blocks, or per source where a node has too many."""
    names, make, by = _GRAPHS[graph]
    key = (spark.sparkContext.applicationId, graph, state_of(spark, sf_dir, names))
    if key not in _blocks:
        g = make(spark, sf_dir)
        _blocks[key] = BL.build(g.nodes, g.edges, f"{checkpoint_dir(spark)}/links/{uuid.uuid4().hex}", by)
    return _blocks[key] or stored_links(spark, sf_dir, graph, "walk")


def stored_links(spark: SparkSession, sf_dir: str, graph: str, way: str) -> LN.Links:
    """The link table ``way`` of a graph, written once for each state of its tables and only read after that."""
    names, make, by = _GRAPHS[graph]
    key = (spark.sparkContext.applicationId, graph, state_of(spark, sf_dir, names))
    g = make(spark, sf_dir)
    if key not in _stored:
        at = f"{checkpoint_dir(spark)}/links/{uuid.uuid4().hex}"
        _stored[key] = LN.number(g.nodes, g.edges, at, by), at
    links, at = _stored[key]
    if getattr(links, way) is None:
        links = LN.add(links, way, g.edges, at)
        _stored[key] = links, at
    return links


# --------------------------------------------------------------------------
# web pages


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, as written."""
    p = table(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)
    return p.select(F.col("page_id"), F.col("url").alias("source"), F.posexplode(hrefs).alias("pos", "target"))
