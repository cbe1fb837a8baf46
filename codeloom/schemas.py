"""Table schemas of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed vocabularies of the data model.
KINDS = ["file", "class", "function", "method", "interface", "type", "enum", "struct"]
RELATIONS = ["contains", "calls", "imports", "references", "implements", "extends"]
WALK_RELATIONS = ["calls", "imports", "references", "implements", "extends"]

CRUX = T.StructType([T.StructField("code", T.StringType()), T.StructField("span", T.StringType())])

# ``ord`` is the extraction order; it decides first-wins and last-wins rules.
NODES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("signature", T.StringType()),
    T.StructField("exported", T.BooleanType()),
    T.StructField("origin", T.StringType()),
    T.StructField("body_hash", T.StringType()),
    T.StructField("chars", T.LongType()),
    T.StructField("body_text", T.StringType()),
    T.StructField("summary_state", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("crux", CRUX),
    T.StructField("ord", T.LongType()),
])

EDGES = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("target", T.StringType(), False),
    T.StructField("relation", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("ord", T.LongType()),
])

RAW_EDGES = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("relation", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("specifier", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("via_member", T.BooleanType()),
    T.StructField("recv_type", T.StringType()),
    T.StructField("ord", T.LongType()),
])

FILES = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("hash", T.StringType()),
])

SCOPES = T.StructType([
    T.StructField("prefix", T.StringType(), False),
    T.StructField("label", T.StringType()),
    T.StructField("markers", T.ArrayType(T.StringType())),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``; missing columns become null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def walk_edges(edges: DataFrame) -> DataFrame:
    """Edges the walks may follow: all but ``contains``."""
    return edges.where(F.col("relation").isin(*WALK_RELATIONS))


def last_by_id(nodes: DataFrame) -> DataFrame:
    """One row per id.  Duplicate ids are legal; the last definition wins."""
    rest = [c for c in nodes.columns if c != "id"]
    picked = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("ord")).alias("row"))
    return picked.select("id", *[F.col(f"row.{c}").alias(c) for c in rest])
