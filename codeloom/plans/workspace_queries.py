"""Several repositories in one table: split, coverage, search and check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import federation as FED
from ..operators import workspace as WS
from ..sources import tables as S
from . import sqltext as Q
from .build_queries import ENRICH, HITS, INNER, PATTERN, _layers
from .registry import query

# A folder of every second source, and of one language as a whole.
REPOS = """repos AS (SELECT DISTINCT lang || '/' || source AS prefix FROM documents WHERE source <= 'src3'
           UNION SELECT DISTINCT lang FROM documents WHERE lang = 'en')"""


def _repos(spark, sf):
    d = S.table(spark, sf, "documents")
    return d.where("source <= 'src3'").select(F.concat_ws("/", "lang", "source").alias("prefix")).union(
        d.where("lang = 'en'").select("lang")).distinct()


@query("split_workspace", f"""WITH {Q.DOCS}, {Q.COPIES}, {REPOS},
owner AS (SELECT id, kind, coalesce((SELECT arg_max(prefix, length(prefix)) FROM repos r
  WHERE docs.path = r.prefix OR starts_with(docs.path, r.prefix || '/')), '') AS repo FROM docs),
n AS (SELECT repo, count(*) AS nodes, count(*) FILTER (kind = 'file') AS files FROM owner GROUP BY repo),
l AS (SELECT s.repo, count(*) FILTER (s.repo = t.repo) AS inside, count(*) FILTER (s.repo <> t.repo) AS crossing
      FROM copies c JOIN owner s ON s.id = c.source JOIN owner t ON t.id = c.target GROUP BY s.repo)
SELECT n.repo, nodes, files, coalesce(inside, 0) AS inside, coalesce(crossing, 0) AS crossing FROM n LEFT JOIN l ON l.repo = n.repo""")
def split_workspace(spark, sf):
    """Nodes and links of each repository, and the links that lead from it into another."""
    found = WS.split_graph(S.document_nodes(spark, sf).select("id", "kind", "path"),
                           S.copy_edges(spark, sf).select("source", "target", "relation"), _repos(spark, sf))
    nodes = found.nodes.groupBy("repo").agg(
        F.count("*").alias("nodes"), F.sum((F.col("kind") == "file").cast("long")).alias("files"))
    inside = found.edges.groupBy("repo").agg(F.count("*").alias("inside"))
    crossing = found.crossing.groupBy("repo").agg(F.count("*").alias("crossing"))
    return nodes.join(inside, "repo", "left").join(crossing, "repo", "left").na.fill(0)


@query("workspace_coverage", f"""WITH {Q.DOCS},
known AS (SELECT DISTINCT lang || '/' || source AS repo FROM documents UNION SELECT DISTINCT url FROM pages),
have AS (SELECT lang || '/' || source AS repo, count(*) FILTER (kind = 'file') AS files FROM docs GROUP BY 1)
SELECT k.repo, h.repo IS NOT NULL AS built, coalesce(h.files, 0) AS files FROM known k LEFT JOIN have h ON h.repo = k.repo""")
def workspace_coverage(spark, sf):
    """Sources of documents are repositories with a graph, pages are listed ones without."""
    nodes = S.document_nodes(spark, sf).select("kind", F.concat_ws("/", "lang", "source").alias("repo"))
    known = nodes.select("repo").union(S.table(spark, sf, "pages").select("url"))
    return WS.coverage(known, nodes)


@query("federate_grep", f"""WITH {Q.LINES}, {HITS}, {Q.SPANS}, {Q.COPIES}, {INNER.format(hits='hits')},
deg AS (SELECT target_path || '#B0.S0' AS id, count(*) AS n FROM copies GROUP BY 1),
total AS (SELECT split_part(path, '/', 1) AS repo, count(*) AS total_hits FROM hits GROUP BY 1)
SELECT t.repo, i.path, coalesce(span_id, 'file:' || i.path) AS key, coalesce(max(deg.n), 0) AS in_degree,
       count(*) AS n_hits, min(line) AS first_line, t.total_hits
FROM inner_span i LEFT JOIN deg ON deg.id = i.span_id JOIN total t ON t.repo = split_part(i.path, '/', 1)
GROUP BY t.repo, i.path, span_id, t.total_hits""")
def federate_grep(spark, sf):
    """All hits of all repositories, grouped by section; one language is one repository."""
    repo = F.substring_index("path", "/", 1)
    files = S.document_files(spark, sf).withColumn("repo", repo)
    nodes = S.document_spans(spark, sf).withColumn("kind", F.lit("function"))
    groups, counts = FED.federate_grep(nodes, S.span_edges(spark, sf), files, PATTERN)
    return groups.withColumn("repo", repo).join(counts.select("repo", "total_hits"), "repo").select(
        "repo", "path", "key", "in_degree", "n_hits", F.col("first_line").cast("long").alias("first_line"), "total_hits")


@query("federate_check", f"""WITH {ENRICH},
found AS (SELECT d.lang AS repo, CASE WHEN p.id IS NULL THEN 'added' ELSE 'changed' END AS status
          FROM docs d LEFT JOIN prior p ON p.id = d.id WHERE p.id IS NULL OR d.lang = 'fr'),
known AS (SELECT DISTINCT lang AS repo FROM documents UNION SELECT DISTINCT url FROM pages),
built AS (SELECT DISTINCT d.lang AS repo FROM docs d JOIN prior p ON p.id = d.id),
n AS (SELECT repo, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed FROM found GROUP BY repo)
SELECT k.repo, b.repo IS NOT NULL AS built, coalesce(added, 0) AS added, coalesce(changed, 0) AS changed,
       b.repo IS NULL OR coalesce(added + changed, 0) = 0 AS ok
FROM known k LEFT JOIN built b ON b.repo = k.repo LEFT JOIN n ON n.repo = k.repo""")
def federate_check(spark, sf):
    """One language is one repository; pages are repositories that were never built."""
    nodes, prior = _layers(spark, sf)
    now = nodes.withColumn("repo", F.substring_index("path", "/", 1))
    known = now.select("repo").union(S.table(spark, sf, "pages").select("url")).distinct()
    rows = FED.federate_check(prior.join(now.select("id", "repo"), "id"), now, known)
    return rows.select("repo", "built", "added", "changed", "ok")
