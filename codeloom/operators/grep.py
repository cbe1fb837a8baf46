"""Line search, attributed to the innermost enclosing definition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import walk_edges
from ..session import materialize

# Lines per bucket of the range join.
BUCKET = 64


def matching_lines(
    files: DataFrame, pattern: str, fixed: bool = False, ignore_case: bool = False, within: str | None = None
) -> DataFrame:
    """Lines of ``files`` (path, content) that match: (path, line, text)."""
    regex = ("(?i)" if ignore_case else "") + (X.literal_pattern(pattern) if fixed else pattern)
    if within:
        files = files.where(F.contains(F.col("path"), F.lit(within)))
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    return lines.where(F.col("text").rlike(regex)).select("path", (F.col("pos") + 1).alias("line"), "text")


def innermost_span(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Attach to each (path, line) the enclosing span that starts last.

    ``spans``: id, path, start_line, end_line, ord.  Both sides meet on
    (path, bucket of lines), so a point meets only the spans over its own
    bucket, and a long file spreads over many keys.  Points outside every span
    keep a null ``span_id``.
    """
    laid = spans.select(
        "id", "path", "start_line", "end_line", "ord",
        F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.col("end_line") / BUCKET))).alias("bucket"),
    )
    keyed = points.withColumn("bucket", F.floor(F.col("line") / BUCKET))
    met = keyed.join(laid, ["path", "bucket"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    inner = met.groupBy("path", "line").agg(
        F.max_by("id", F.struct("start_line", "ord")).alias("span_id"))
    return points.join(inner, ["path", "line"], "left")


def in_degree(edges: DataFrame) -> DataFrame:
    """Incoming walk edges per node, duplicates by relation counted."""
    return walk_edges(edges).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))


@dataclass
class GrepResult:
    hits: DataFrame    # path, line, text, span_id
    groups: DataFrame  # key, symbol id, path, in_degree, n_hits, first_line, hits
    total: int
    dropped: int


def grep(
    nodes: DataFrame,
    edges: DataFrame,
    files: DataFrame,
    pattern: str,
    fixed: bool = False,
    ignore_case: bool = False,
    within: str | None = None,
    max_hits: int | None = None,
) -> GrepResult:
    """Search whole files and group the hits by definition.

    All hits are listed, unless a page of the first ``max_hits`` in path and
    line order is asked for; the others are then counted.
    """
    found = materialize(matching_lines(files, pattern, fixed, ignore_case, within))
    total = found.count()
    listed = found if max_hits is None else materialize(found.orderBy("path", "line").limit(max_hits))
    symbols = nodes.where(F.col("kind") != "file")
    touched = symbols.join(listed.select("path").distinct(), "path", "left_semi")
    hits = innermost_span(listed, touched.select("id", "path", "start_line", "end_line", "ord"))
    kept = total if max_hits is None else min(total, max_hits)
    return GrepResult(hits, group_hits(hits, edges), kept, total - kept)


def group_hits(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits per definition (or per file outside any), most-used first."""
    keyed = hits.select(
        F.coalesce("span_id", F.concat(F.lit("file:"), F.col("path"))).alias("key"),
        "span_id", "path", "line", F.trim("text").alias("text"),
    )
    groups = keyed.groupBy("key", "span_id", "path").agg(
        F.count("*").alias("n_hits"),
        F.min("line").alias("first_line"),
        F.array_sort(F.collect_list(F.struct("line", "text"))).alias("hits"),
    )
    used = in_degree(edges.join(groups.select(F.col("span_id").alias("target")).distinct(), "target", "left_semi"))
    return groups.join(used.withColumnRenamed("id", "span_id"), "span_id", "left").select(
        "key", "span_id", "path", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), "n_hits", "first_line", "hits",
    )


def rank_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.col("in_degree").desc(), F.collate("path", "UNICODE"), "first_line")
