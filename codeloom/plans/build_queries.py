"""Line search, resolution, drift, concepts and sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import concepts as C
from ..operators import drift as D
from ..operators import enrich as E
from ..operators import extract as EX
from ..operators import grep as G
from ..operators import resolve as R
from ..operators import savings as SV
from ..operators import viz as V
from ..session import checkpoint_dir, materialize
from ..sources import tables as S
from ..streaming import sessions as SS
from . import sqltext as Q
from .registry import query

# --------------------------------------------------------------------------
# line search

PATTERN = "[Ll]icen[cs]e|Copyright|@"
HITS = f"""hits AS (SELECT path, line, text FROM lines WHERE regexp_matches(text, '{PATTERN}'))"""
INNER = """inner_span AS (
  SELECT h.path, h.line, h.text, arg_max(s.id, s.s * 1000000 + s.ord) AS span_id
  FROM {hits} h LEFT JOIN spans s ON s.path = h.path AND h.line BETWEEN s.s AND s.e GROUP BY h.path, h.line, h.text)"""


@query("grep_hits", f"""WITH {Q.LINES}, {HITS} SELECT path, line, trim(text) AS text FROM hits""")
def grep_hits(spark, sf):
    found = G.matching_lines(S.document_files(spark, sf), PATTERN)
    return found.select("path", F.col("line").cast("long").alias("line"),
                        F.trim("text").alias("text"))


@query("grep_literal", f"""WITH {Q.LINES}
SELECT path, line FROM lines WHERE contains(lower(text), 'tion. th')""")
def grep_literal(spark, sf):
    found = G.matching_lines(S.document_files(spark, sf), "TION. TH", fixed=True, ignore_case=True)
    return found.select("path", F.col("line").cast("long").alias("line"))


@query("grep_innermost_span", f"""WITH {Q.LINES}, {HITS}, {Q.SPANS}, {INNER.format(hits='hits')}
SELECT path, line, span_id FROM inner_span""")
def grep_innermost(spark, sf):
    found = G.matching_lines(S.document_files(spark, sf), PATTERN)
    return G.innermost_span(found, S.document_spans(spark, sf)).select(
        "path", F.col("line").cast("long").alias("line"), "span_id")


def _grep(spark, sf, max_hits):
    nodes = S.document_spans(spark, sf).withColumn("kind", F.lit("function"))
    return G.grep(nodes, S.span_edges(spark, sf), S.document_files(spark, sf), PATTERN, max_hits=max_hits)


@query("grep_grouped_by_span", f"""WITH {Q.LINES}, {HITS}, {Q.SPANS}, {Q.COPIES}, {INNER.format(hits='hits')},
deg AS (SELECT target_path || '#B0.S0' AS id, count(*) AS n FROM copies GROUP BY 1)
SELECT i.path, coalesce(span_id, 'file:' || i.path) AS key, coalesce(max(deg.n), 0) AS in_degree, count(*) AS n_hits, min(line) AS first_line
FROM inner_span i LEFT JOIN deg ON deg.id = i.span_id GROUP BY i.path, span_id""")
def grep_grouped(spark, sf):
    groups = _grep(spark, sf, None).groups
    return groups.select("path", "key", "in_degree", "n_hits", F.col("first_line").cast("long").alias("first_line"))


@query("grep_hit_cap", f"""WITH {Q.LINES}, {HITS}, kept AS (SELECT * FROM hits ORDER BY path, line LIMIT 20), {Q.SPANS},
{INNER.format(hits='kept')}
SELECT span_id AS key, count(*) AS n_hits, (SELECT greatest(count(*) - 20, 0) FROM hits) AS dropped FROM inner_span GROUP BY span_id""")
def grep_cap(spark, sf):
    """A page of 20 hits, with the others counted."""
    res = _grep(spark, sf, 20)
    return res.groups.select("key", "n_hits", F.lit(res.dropped).cast("long").alias("dropped"))


@query("residual_lines_anti_join", f"""WITH {Q.LINES}, {Q.SPANS}, secs AS (SELECT * FROM spans WHERE contains(id, '.S')),
left_over AS (SELECT l.path, l.line, l.text FROM lines l
  WHERE NOT EXISTS (SELECT 1 FROM secs s WHERE s.path = l.path AND l.line BETWEEN s.s AND s.e))
SELECT path, count(*) AS n_lines,
       sha256(trim(regexp_replace(string_agg(text, ' ' ORDER BY line), '\\s+', ' ', 'g'))) AS residual_hash
FROM left_over GROUP BY path""")
def residual(spark, sf):
    """Text outside every section, whole."""
    sections = S.document_spans(spark, sf).where(F.contains("id", F.lit(".S")))
    rest = EX.file_residual(S.document_files(spark, sf), sections)
    return rest.select("path", "n_lines", F.sha2(F.col("residual").cast("binary"), 256).alias("residual_hash"))


@query("savings_estimate", f"""WITH {Q.LINES}, {HITS}, {Q.DOCS}, s AS (
  SELECT count(*) AS files, sum(chars)::BIGINT AS baseline_chars FROM docs WHERE kind = 'file' AND path IN (SELECT path FROM hits))
SELECT files, baseline_chars, floor(baseline_chars / 4.0 + 0.5)::BIGINT - 3000 AS saved,
       floor(100.0 * (floor(baseline_chars / 4.0 + 0.5) - 3000) / floor(baseline_chars / 4.0 + 0.5) + 0.5)::BIGINT AS percent FROM s""")
def savings(spark, sf):
    """What a 12,000 character answer saves against the files behind it."""
    found = G.matching_lines(S.document_files(spark, sf), PATTERN)
    saved = SV.savings_for(S.document_nodes(spark, sf), found)
    out = F.lit(12_000)
    return saved.select("files", "baseline_chars", SV.saved_tokens(F.col("baseline_chars"), out).alias("saved"),
                        SV.saved_percent(F.col("baseline_chars"), out).alias("percent"))


# --------------------------------------------------------------------------
# resolution

NAME_NODES = """
fn AS (
  SELECT 'part:' || p_partkey AS id, p_name AS name, 'part/' || p_brand || '/' || p_type AS path, p_partkey AS ord FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'sup/' || s_nationkey, 1000000000 + s_suppkey FROM supplier),
asked AS (
  SELECT l_orderkey, p_name AS name, 'part/' || p_brand || '/' || p_type AS file FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT l_orderkey, s_name, 'part/' || p_brand || '/' || p_type
            FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  UNION ALL SELECT l_orderkey, p_name, 'sup/' || s_nationkey
            FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""


def _lines_with_names(spark, sf):
    t = lambda n: S.table(spark, sf, n)
    return (
        t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        .join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
        .join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .withColumns({"part_file": F.concat_ws("/", F.lit("part"), "p_brand", "p_type"),
                      "sup_file": F.concat(F.lit("sup/"), F.col("s_nationkey").cast("string"))})
    )


@query("resolve_name_unique", f"""WITH {NAME_NODES},
loc AS (SELECT path, name, arg_min(id, ord) AS id FROM fn GROUP BY path, name),
glo AS (SELECT name, min(id) AS id FROM fn GROUP BY name HAVING count(*) = 1)
SELECT 'order:' || a.l_orderkey AS source, a.name, a.file, coalesce(loc.id, glo.id) AS hit,
       CASE WHEN loc.id IS NOT NULL THEN 'extracted' WHEN glo.id IS NOT NULL THEN 'inferred' END AS confidence
FROM asked a LEFT JOIN loc ON loc.path = a.file AND loc.name = a.name LEFT JOIN glo ON glo.name = a.name""")
def resolve_name(spark, sf):
    """Names met in order lines: local first, else unique, else nothing."""
    t = lambda n: S.table(spark, sf, n)
    nodes = t("part").select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"),
        F.concat_ws("/", F.lit("part"), "p_brand", "p_type").alias("path"), F.col("p_partkey").alias("ord")
    ).unionByName(t("supplier").select(
        F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("sup/"), F.col("s_nationkey").cast("string")).alias("path"),
        (F.col("s_suppkey") + 1_000_000_000).alias("ord"))).withColumn("kind", F.lit("function"))
    rows = _lines_with_names(spark, sf)
    asked = rows.select(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source"),
        F.explode(F.array(
            F.struct(F.col("p_name").alias("name"), F.col("part_file").alias("file")),
            F.struct(F.col("s_name").alias("name"), F.col("part_file").alias("file")),
            F.struct(F.col("p_name").alias("name"), F.col("sup_file").alias("file")),
        )).alias("a")).select("source", "a.name", "a.file")
    return R.resolve_names(asked, nodes, ["function"]).select("source", "name", "file", "hit", "confidence")


TYPED = """
own AS (
  SELECT 'part/' || p_type || '#' || replace(p_brand, '#', '') || '_' || p_size || '.' || split_part(p_name, ' ', 1) AS id,
         replace(p_brand, '#', '') || '_' || p_size AS owner, split_part(p_name, ' ', 1) AS name, 'part/' || p_type AS path,
         p_partkey AS ord, replace(p_brand, '#', '') AS brand, p_size FROM part),
parents AS (SELECT DISTINCT owner AS type, brand || '_' || (p_size - 1) AS parent FROM own),
keys AS (
  SELECT DISTINCT replace(a.p_brand, '#', '') || '_' || a.p_size AS recv_type, split_part(b.p_name, ' ', 1) AS name, 'part/' || a.p_type AS file
  FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey),
climb AS (
  SELECT DISTINCT recv_type, recv_type AS type, 0 AS level FROM keys
  UNION ALL SELECT c.recv_type, p.parent, c.level + 1 FROM climb c JOIN parents p ON p.type = c.type WHERE c.level < 3),
counted AS (SELECT owner, name, count(*) AS n, arg_min(id, ord) AS one, arg_min(path, ord) AS one_path FROM own GROUP BY owner, name),
tried AS (
  SELECT k.*, c.level, o.n, o.one, o.one_path, row_number() OVER (PARTITION BY k.recv_type, k.name, k.file ORDER BY c.level) AS rn
  FROM keys k JOIN climb c ON c.recv_type = k.recv_type JOIN counted o ON o.owner = c.type AND o.name = k.name),
decided AS (
  SELECT t.recv_type, t.name, t.file,
         CASE WHEN n = 1 THEN one ELSE (SELECT arg_min(id, ord) FROM own w JOIN climb c ON c.type = w.owner AND c.recv_type = t.recv_type
            WHERE c.level = t.level AND w.name = t.name AND w.path = t.file) END AS hit, n, one_path FROM tried t WHERE rn = 1)
SELECT k.recv_type, k.name, k.file, d.hit,
       CASE WHEN d.hit IS NOT NULL THEN 'hit' WHEN d.n IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS outcome,
       CASE WHEN d.hit IS NULL THEN NULL WHEN d.n > 1 OR d.one_path = k.file THEN 'extracted' ELSE 'inferred' END AS confidence
FROM keys k LEFT JOIN decided d USING (recv_type, name, file)"""


@query("resolve_typed_chain", f"WITH RECURSIVE {TYPED}")
def resolve_typed(spark, sf):
    """Member calls through a receiver type, climbing up to three bases."""
    part = S.table(spark, sf, "part")
    brand = F.regexp_replace("p_brand", "#", "")
    owner = F.concat_ws("_", brand, F.col("p_size").cast("string"))
    verb = F.substring_index("p_name", " ", 1)
    path = F.concat(F.lit("part/"), F.col("p_type"))
    own = part.select(
        F.concat(path, F.lit("#"), owner, F.lit("."), verb).alias("id"), verb.alias("name"),
        F.lit("method").alias("kind"), path.alias("path"), F.col("p_partkey").alias("ord"))
    raw = part.select(
        F.concat(path, F.lit("#"), owner).alias("source"), F.lit("extends").alias("relation"),
        F.concat_ws("_", brand, (F.col("p_size") - 1).cast("string")).alias("name"), F.col("p_partkey").alias("ord"))
    a = part.select(F.col("p_partkey").alias("l_partkey"), owner.alias("recv_type"), path.alias("file"))
    b = part.select(F.col("p_partkey").alias("l_suppkey"), verb.alias("name"))
    calls = S.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").join(a, "l_partkey").join(b, "l_suppkey")
    return R.resolve_typed(calls, own, raw).select("recv_type", "name", "file", "hit", "outcome", "confidence")


IMPORTS = """
paths AS (
  SELECT doc_id, lang || '/' || source || '/' || doc_id AS stem,
         CASE source WHEN 'src1' THEN '.py' WHEN 'src2' THEN '/index.ts' WHEN 'src3' THEN '.tsx' WHEN 'src4' THEN '.rs' ELSE '.ts' END AS ext
  FROM documents),
asked AS (
  SELECT a.stem || a.ext AS file,
         CASE WHEN a.ext = '/index.ts' THEN '../../../' ELSE '../.././' END || b.stem || CASE WHEN b.ext = '.ts' THEN '.js' ELSE '' END AS specifier,
         b.stem || b.ext AS target_file, b.ext
  FROM paths a JOIN paths b ON b.doc_id = a.doc_id + 1)"""


@query("import_candidates", f"""WITH {IMPORTS}
SELECT file, specifier, CASE WHEN ext = '.rs' THEN specifier ELSE target_file END AS target FROM asked""")
def imports(spark, sf):
    """Relative imports tried under every suffix; unknown suffixes stay raw."""
    d = S.table(spark, sf, "documents")
    src = F.col("source")
    ext = (F.when(src == "src1", ".py").when(src == "src2", "/index.ts").when(src == "src3", ".tsx")
           .when(src == "src4", ".rs").otherwise(".ts"))
    paths = d.select("doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("stem"), ext.alias("ext"))
    a = paths.select((F.col("doc_id") + 1).alias("doc_id"), F.concat("stem", "ext").alias("file"),
                     F.when(F.col("ext") == "/index.ts", "../../../").otherwise("../.././").alias("up"))
    asked = a.join(paths, "doc_id").select(
        "file", F.concat("up", "stem", F.when(F.col("ext") == ".ts", ".js").otherwise("")).alias("specifier"))
    nodes = paths.select(F.concat("stem", "ext").alias("id"))
    return R.resolve_imports(asked, nodes)


@query("go_import_candidates", """
WITH files AS (SELECT doc_id, lang || '/' || source AS pkg, lang || '/' || source || '/' || doc_id || '.go' AS id FROM documents),
firsts AS (SELECT pkg, min(id) AS id FROM files GROUP BY pkg),
asked AS (SELECT a.id AS file, 'example.org/' || b.pkg AS specifier, b.pkg FROM files a JOIN files b ON b.doc_id = a.doc_id + 1
          UNION SELECT id, 'fmt', NULL FROM files)
SELECT DISTINCT a.file, a.specifier,
       CASE WHEN a.pkg = 'en/src1' OR a.pkg IS NULL THEN a.specifier ELSE f.id END AS target
FROM asked a LEFT JOIN firsts f ON f.pkg = a.pkg""")
def go_imports(spark, sf):
    """Package paths through the longest owning module."""
    d = S.table(spark, sf, "documents")
    pkg = F.concat_ws("/", "lang", "source")
    files = d.select("doc_id", pkg.alias("pkg"),
                     F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".go"))).alias("id"))
    nodes = files.select("id", F.col("id").alias("path"), F.lit("file").alias("kind"))
    a = files.select((F.col("doc_id") + 1).alias("doc_id"), F.col("id").alias("file"))
    asked = a.join(files, "doc_id").select("file", F.concat(F.lit("example.org/"), F.col("pkg")).alias("specifier"))
    asked = asked.unionByName(files.select(F.col("id").alias("file"), F.lit("fmt").alias("specifier")))
    modules = d.select(F.concat(F.lit("example.org/"), F.col("lang")).alias("module"), F.col("lang").alias("dir")).distinct()
    nested = d.where("lang = 'en' AND source = 'src1'").select(
        F.lit("example.org/en/src1").alias("module"), F.lit("elsewhere").alias("dir")).distinct()
    return R.resolve_go_imports(asked, nodes, modules.unionByName(nested))


# --------------------------------------------------------------------------
# drift and enrichment

RECORDED = """
recorded AS (
  SELECT lang || '/' || source || '/' || d.doc_id AS path, sha256(text || CASE WHEN quality = 0 THEN '!' ELSE '' END) AS hash
  FROM labels JOIN documents d USING (doc_id)
  UNION ALL SELECT 'benchmark/' || item_id, sha256(text) FROM benchmark),
present AS (SELECT lang || '/' || source || '/' || doc_id AS path, sha256(text) AS hash FROM documents)"""


def recorded(spark, sf):
    d = S.table(spark, sf, "documents")
    labels = S.table(spark, sf, "labels")
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    body = F.concat("text", F.when(F.col("quality") == 0, "!").otherwise(""))
    old = labels.join(d, "doc_id").select(path.alias("path"), X.content_hash(body).alias("hash"))
    gone = S.table(spark, sf, "benchmark").select(
        F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), X.content_hash(F.col("text")).alias("hash"))
    return old.unionByName(gone)


def present(spark, sf):
    return S.document_files(spark, sf).select("path", X.content_hash(F.col("content")).alias("hash"))


@query("drift_full_outer", f"""WITH {RECORDED}
SELECT path, CASE WHEN r.hash IS NULL THEN 'added' WHEN p.hash IS NULL THEN 'removed'
                  WHEN r.hash <> p.hash THEN 'changed' ELSE 'same' END AS status
FROM recorded r FULL JOIN present p USING (path)""")
def drift_outer(spark, sf):
    """Labelled documents as the recorded state, all documents as the present one."""
    return D.diff(recorded(spark, sf), present(spark, sf), "path", "hash").select("path", "status")


@query("manifest_coverage", f"""WITH {RECORDED}, j AS (SELECT path, r.hash AS rh, p.hash AS ph FROM recorded r FULL JOIN present p USING (path))
SELECT path, CASE WHEN rh IS NULL THEN 'coverage' WHEN ph IS NULL THEN 'removed' ELSE 'content' END AS status,
       CASE WHEN rh <> ph THEN substring(rh, 1, 8) END AS before, CASE WHEN rh <> ph THEN substring(ph, 1, 8) END AS now
FROM j WHERE rh IS DISTINCT FROM ph""")
def manifest(spark, sf):
    return D.check_manifest(recorded(spark, sf), present(spark, sf))


@query("index_freshness", f"""WITH {RECORDED}
SELECT count(*) FILTER (path NOT IN (SELECT path FROM present)) AS missing, count(*) AS total FROM recorded""")
def index_freshness(spark, sf):
    return D.freshness(recorded(spark, sf), present(spark, sf))


@query("roster_drift", f"""WITH {RECORDED}
SELECT path AS slug, CASE WHEN r.hash IS NULL THEN 'not in manifest' WHEN p.hash IS NULL THEN 'note missing' ELSE 'digest differs' END AS status
FROM recorded r FULL JOIN present p USING (path) WHERE r.hash IS DISTINCT FROM p.hash""")
def roster(spark, sf):
    as_notes = lambda df: df.select(F.col("path").alias("slug"), F.col("hash").alias("sources_digest"))
    return D.check_roster(as_notes(recorded(spark, sf)), as_notes(present(spark, sf)))


PROBE = """
p AS (SELECT lang || '/' || source || '/' || d.doc_id AS path, n_chars AS size, quality AS mtime,
             CASE WHEN toxic = 1 THEN '' ELSE sha256(text || CASE WHEN quality = 0 THEN '!' ELSE '' END) END AS hash
      FROM labels JOIN documents d USING (doc_id)),
f AS (SELECT lang || '/' || source || '/' || doc_id AS path, n_chars AS size, 1 AS mtime, sha256(text) AS hash FROM documents)"""


@query("fingerprint_probe", f"""WITH {PROBE}, s AS (
  SELECT path, CASE WHEN p.hash IS NULL THEN 'added' WHEN f.hash IS NULL THEN 'removed'
                    WHEN p.hash <> '' AND p.size = f.size AND p.mtime = f.mtime THEN 'same'
                    WHEN p.hash <> f.hash THEN 'changed' ELSE 'same' END AS status FROM p FULL JOIN f USING (path))
SELECT path, status FROM s WHERE status <> 'same'""")
def fingerprint(spark, sf):
    """Size and time first; only suspects are hashed."""
    d = S.table(spark, sf, "documents")
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    files = d.select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"), F.col("text").alias("content"))
    body = F.concat("content", F.when(F.col("quality") == 0, "!").otherwise(""))
    prints = S.table(spark, sf, "labels").join(files.drop("mtime"), "doc_id").select(
        "path", "size", F.col("quality").alias("mtime"),
        F.when(F.col("toxic") == 1, "").otherwise(X.content_hash(body)).alias("hash"))
    return D.probe(prints, files)


ENRICH = f"""{Q.DOCS},
prior AS (
  SELECT 'doc:' || doc_id AS id, CASE WHEN quality = 1 THEN 'ready' ELSE 'pending' END AS state,
         CASE WHEN toxic = 0 THEN 'about ' || doc_id END AS summary, quality FROM labels)"""


def _layers(spark, sf):
    nodes = S.document_nodes(spark, sf).withColumns({
        "body_hash": X.content_hash(F.col("body_text")), "summary_state": F.lit("pending"),
        "summary": F.lit(None).cast("string"), "crux": F.lit(None).cast("struct<code:string,span:string>")})
    prior = S.table(spark, sf, "labels").join(nodes.withColumn("doc_id", F.col("ord")), "doc_id").select(
        "id", F.when(F.col("lang") == "fr", "other").otherwise(F.col("body_hash")).alias("body_hash"),
        F.when(F.col("quality") == 1, "ready").otherwise("pending").alias("summary_state"),
        F.when(F.col("toxic") == 0, F.concat(F.lit("about "), F.col("doc_id").cast("string"))).alias("summary"),
        "crux", "ord")
    return nodes, prior


@query("enrich_state", f"""WITH {ENRICH}
SELECT d.id, CASE WHEN p.state = 'ready' AND d.lang <> 'fr' THEN 'ready' WHEN p.summary IS NOT NULL THEN 'stale' ELSE 'pending' END AS summary_state,
       p.summary FROM docs d LEFT JOIN prior p ON p.id = d.id""")
def enrich_state(spark, sf):
    """Labels as the prior meaning layer; French bodies count as edited."""
    nodes, prior = _layers(spark, sf)
    return E.carry_over(nodes, prior).select("id", "summary_state", "summary")


@query("check_graph", f"""WITH {ENRICH}, s AS (
  SELECT id, state, summary, CASE WHEN state = 'pending' AND summary IS NOT NULL THEN 1 END AS x FROM prior)
SELECT d.id, CASE WHEN p.id IS NULL THEN 'added' ELSE 'changed' END AS status FROM docs d LEFT JOIN prior p ON p.id = d.id
WHERE p.id IS NULL OR d.lang = 'fr'""")
def check_graph(spark, sf):
    nodes, prior = _layers(spark, sf)
    return D.check_graph(prior, nodes)


# --------------------------------------------------------------------------
# concepts

DRAFTS = """
drafts AS (
  SELECT doc_id AS ord, regexp_extract(text, '^[A-Za-z]+') AS name, CASE WHEN lang = 'en' THEN 'concept' ELSE lang END AS type,
         text AS summary, lang || '/' || source || '/' || doc_id AS path,
         regexp_extract(text, '^\\S+\\s+([A-Za-z]+)', 1) AS to_name, source AS relation FROM documents),
slugged AS (SELECT *, CASE WHEN name = '' THEN 'node' ELSE lower(name) END AS slug, lower(name) AS key FROM drafts),
merged AS (
  SELECT slug, min(ord) AS ord, arg_min(name, ord) AS name,
         (list(summary ORDER BY length(summary) DESC, ord))[1] AS summary,
         coalesce((list(type ORDER BY ord) FILTER (type <> 'concept'))[1], 'concept') AS type FROM slugged GROUP BY slug),
names AS (SELECT key, arg_min(slug, ord) AS slug FROM slugged WHERE key <> '' GROUP BY key),
linked AS (
  SELECT s.slug, n.slug AS "to", s.relation, min(s.ord) AS ord FROM slugged s JOIN names n ON n.key = lower(s.to_name)
  WHERE n.slug <> s.slug GROUP BY 1, 2, 3)"""


def drafts(spark, sf):
    d = S.table(spark, sf, "documents")
    link = F.struct(F.regexp_extract("text", r"^\S+\s+([A-Za-z]+)", 1).alias("to"), F.col("source").alias("relation"),
                    F.col("doc_id").cast("string").alias("description"))
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    return d.select(
        F.col("doc_id").alias("ord"), F.regexp_extract("text", "^[A-Za-z]+", 0).alias("name"),
        F.when(F.col("lang") == "en", "concept").otherwise(F.col("lang")).alias("type"),
        F.col("text").alias("summary"),
        F.when(F.col("lang") == "en", F.array(path)).otherwise(F.array()).alias("sources"),
        F.array(link).alias("links"))


@query("concept_merge", f"WITH {DRAFTS} SELECT slug, ord, name, summary, type FROM merged")
def concept_merge(spark, sf):
    """First words of documents as concept names; whatever shares a slug merges."""
    return C.merge(drafts(spark, sf)).select("slug", "ord", "name", "summary", "type")


@query("link_dedup_first", f"""WITH {DRAFTS} SELECT slug, "to", relation, ord FROM linked""")
def link_dedup(spark, sf):
    return C.resolve_links(drafts(spark, sf)).select("slug", "to", "relation", "ord")


@query("concept_sources", f"""WITH RECURSIVE {DRAFTS},
own AS (SELECT DISTINCT slug, path FROM slugged WHERE type = 'concept'),
bare AS (SELECT slug, ord FROM merged WHERE slug NOT IN (SELECT slug FROM own)),
pull AS (SELECT DISTINCT l.slug, l."to" FROM linked l JOIN bare b ON b.slug = l.slug),
chain AS (SELECT p.slug, p."to" FROM pull p JOIN bare a ON a.slug = p.slug JOIN bare b ON b.slug = p."to" WHERE b.ord < a.ord),
gained AS (
  SELECT p.slug, o.path FROM pull p JOIN own o ON o.slug = p."to"
  UNION SELECT c.slug, g.path FROM chain c JOIN gained g ON g.slug = c."to")
SELECT slug, path FROM own UNION SELECT slug, path FROM gained""")
def concept_sources(spark, sf):
    """Concepts without files of their own take those of what they link to."""
    d = drafts(spark, sf)
    files = present(spark, sf)
    own = materialize(C.own_sources(d, files))
    return C.inherit_sources(C.merge(d), own, C.resolve_links(d)).select("slug", "path")


BATCHES = """
entries AS (
  SELECT path, length(path) + length(content) + 8 AS size, hash, row_number() OVER (ORDER BY path) AS pos FROM (
    SELECT lang || '/' || source || '/' || doc_id AS path, text AS content, sha256(text) AS hash FROM documents)),
fold AS (
  SELECT pos, pos AS batch, size AS used FROM entries WHERE pos = 1
  UNION ALL
  SELECT e.pos, CASE WHEN f.used + e.size > 48000 THEN e.pos ELSE f.batch END, CASE WHEN f.used + e.size > 48000 THEN e.size ELSE f.used + e.size END
  FROM fold f JOIN entries e ON e.pos = f.pos + 1)"""


@query("batch_greedy", f"""WITH RECURSIVE {BATCHES}
SELECT batch, count(*) AS files, sha256(string_agg(path || ':' || hash, chr(10) ORDER BY path || ':' || hash)) AS key
FROM fold JOIN entries USING (pos) GROUP BY batch""")
def batch_greedy(spark, sf):
    """Whole documents packed in path order, and the digest of each batch."""
    files = S.document_files(spark, sf)
    entries = files.select(
        "path", (F.length("path") + F.length("content") + C.ENTRY_OVERHEAD).cast("long").alias("size"),
        X.content_hash(F.col("content")).alias("hash"))
    return C.batch_keys(C.batch_by_size(entries)).select("batch", "files", "key")


@query("sources_digest", """WITH lines AS (
  SELECT conv_id, 'turn/' || turn || ':' || sha256(text) AS line FROM conversations)
SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM lines GROUP BY conv_id""")
def sources_digest(spark, sf):
    """Digest of a conversation over its turns."""
    c = S.table(spark, sf, "conversations")
    line = F.concat_ws(":", F.concat(F.lit("turn/"), F.col("turn").cast("string")), X.content_hash(F.col("text")))
    return c.groupBy("conv_id").agg(X.digest(F.collect_list(line)).alias("digest"))


@query("tree_digest", f"""WITH {RECORDED}, b AS (
  SELECT substring(sha256(path), 1, 3) AS bucket, count(*) AS n,
         sha256(string_agg(path || ':' || hash, chr(10) ORDER BY path || ':' || hash)) AS d FROM present GROUP BY 1)
SELECT sha256(string_agg(bucket || ':' || d, chr(10) ORDER BY bucket || ':' || d)) AS digest, sum(n)::BIGINT AS files FROM b""")
def tree_digest(spark, sf):
    """One digest over all documents, folded in two levels."""
    return C.tree_digest(present(spark, sf))


# --------------------------------------------------------------------------
# shown graphs

VERBS = """CASE event_type WHEN 'click' THEN 'supports' WHEN 'view' THEN 'uses' WHEN 'error' THEN 'defines'
WHEN 'purchase' THEN 'influences' ELSE 'part_of' END"""


def _verb():
    e = F.col("event_type")
    return (F.when(e == "click", "supports").when(e == "view", "uses").when(e == "error", "defines")
            .when(e == "purchase", "influences").otherwise("part_of"))


@query("relation_normalize", f"""WITH v AS (SELECT {VERBS} AS said FROM events),
n AS (SELECT CASE said WHEN 'influences' THEN 'configures' WHEN 'uses' THEN 'uses' WHEN 'part_of' THEN 'part_of' ELSE 'validates' END AS relation FROM v)
SELECT CASE relation WHEN 'part_of' THEN 'part of' ELSE relation END AS chip,
       CASE relation WHEN 'part_of' THEN 'structure' ELSE 'dependency' END AS family, count(*) AS n FROM n GROUP BY 1, 2""")
def relation_normalize(spark, sf):
    edges = S.table(spark, sf, "events").select(V.normalize_relation(_verb()).alias("relation"))
    return V.chip_counts(edges)


@query("dangling_edges_dropped", f"""WITH {Q.CATALOG}, kept AS (SELECT id FROM nodes WHERE kind <> 'method')
SELECT relation, count(*) AS n FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept) GROUP BY relation""")
def dangling(spark, sf):
    g = S.catalog(spark, sf)
    kept = V.real_edges(g.nodes.where("kind <> 'method'"), g.edges, S.catalog_parts(spark, sf))
    return kept.groupBy("relation").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------
# sessions

SEEN = """
ev AS (SELECT user_id AS session, event_id AS step, event_type || regexp_extract(props, '(\\d+)', 1) AS pointer,
              row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
walked AS (
  SELECT session, n, step, pointer, true AS fresh, [pointer] AS seen FROM ev WHERE n = 1
  UNION ALL
  SELECT e.session, e.n, e.step, e.pointer, NOT list_contains(w.seen, e.pointer),
         CASE WHEN list_contains(w.seen, e.pointer) THEN w.seen
              ELSE list_append(w.seen, e.pointer)[greatest(len(w.seen) + 1 - 39, 1):] END
  FROM walked w JOIN ev e ON e.session = w.session AND e.n = w.n + 1)"""


def shown(spark, sf):
    return S.table(spark, sf, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("step"),
        F.concat("event_type", F.regexp_extract("props", r"(\d+)", 1)).alias("pointer"))


@query("novelty_dedup", f"WITH RECURSIVE {SEEN} SELECT session, step, pointer FROM walked WHERE fresh")
def novelty(spark, sf):
    """Pointers a session does not remember among its last forty."""
    return SS.fresh_pointers(shown(spark, sf))


@query("novelty_stream", f"WITH RECURSIVE {SEEN} SELECT session, step, pointer FROM walked WHERE fresh")
def novelty_stream(spark, sf):
    """The same gate as a stream over the events file."""
    stream = event_stream(spark, sf)
    rows = stream.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("step"),
        F.concat("event_type", F.regexp_extract("props", r"(\d+)", 1)).alias("pointer"))
    return drain(spark, SS.novelty_stream(rows), "novelty")


@query("event_counts_stream", """WITH d AS (
  SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2)
SELECT start, event_type, n, total FROM d""")
def event_counts(spark, sf):
    """Daily counts as they stand when the stream has read what is there; the last day counts as well."""
    out = drain_latest(spark, SS.event_counts_stream(event_stream(spark, sf)), "counts", ["start", "event_type"])
    return out.select("start", "event_type", "n", F.round("total", 2).alias("total"))


def event_stream(spark, sf):
    """The events table as a stream, whether it is one file or a folder of files."""
    schema = S.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")  # the glob admits both


def drain_latest(spark, stream, name, keys):
    """Run a stream of updates over what is there; the last state of every key."""
    base = f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/at={number}")

    q = (stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state")
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(stream.schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def drain(spark, stream, name):
    """Run a stream over what is there and read its output back."""
    base = f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("session_accumulate", """
SELECT user_id AS session, sum(regexp_extract(props, '(\\d+)', 1)::BIGINT)::BIGINT AS saved FROM events GROUP BY user_id""")
def accumulate(spark, sf):
    outputs = S.table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("props").alias("text"))
    return SS.saved_total(outputs, r"(\d+)")


@query("session_nudges", """
SELECT user_id AS session, event_id AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nudge
FROM events WHERE event_type = 'error' QUALIFY nudge <= 2""")
def session_nudges(spark, sf):
    weak = S.table(spark, sf, "events").where("event_type = 'error'").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("step"))
    return SS.nudges(weak, [F.col("step")]).select("session", "step", F.col("nudge").cast("long").alias("nudge"))


@query("session_scope_hint", f"""WITH {Q.DOCS},
u AS (SELECT name, min(lang) AS scope FROM docs GROUP BY name HAVING count(DISTINCT lang) = 1)
SELECT d.doc_id AS session, d.name, u.scope FROM docs d JOIN u ON u.name = d.name""")
def session_scope_hint(spark, sf):
    docs = S.document_nodes(spark, sf).select("name", F.col("lang").alias("scope"), F.col("ord").alias("session"))
    return SS.scope_hint(docs.select("name", "scope"), docs.select("session", "name")).select("session", "name", "scope")


@query("status_counts", f"""WITH {ENRICH}, st AS (
  SELECT CASE WHEN p.state = 'ready' AND d.lang <> 'fr' THEN 'ready' WHEN p.summary IS NOT NULL THEN 'stale' ELSE 'pending' END AS s
  FROM docs d LEFT JOIN prior p ON p.id = d.id), {Q.COPIES}
SELECT count(*) AS nodes, count(*) FILTER (s = 'ready') AS ready, count(*) FILTER (s = 'stale') AS stale,
       (SELECT count(*) FROM copies) AS edges FROM st""")
def status_counts(spark, sf):
    nodes, prior = _layers(spark, sf)
    return SS.status(E.carry_over(nodes, prior), S.copy_edges(spark, sf))
