"""Shared pieces of the SQL twins."""

from __future__ import annotations

from ..functions.text import STOP_WORDS, TEST_PATH, plural_forms, query_terms

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens(expr: str) -> str:
    return (
        "list_filter(string_split_regex(lower(regexp_replace("
        f"coalesce({expr}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), "
        f"lambda t: length(t) > 1 AND t NOT IN ({STOP_SQL}))"
    )


DOCS = """
docs AS (
  SELECT 'doc:' || doc_id AS id, split_part(text, chr(10), 1) AS name,
         CASE WHEN contains(text, chr(10)) THEN 'file' ELSE 'function' END AS kind,
         lang || '/' || source || '/' || doc_id AS path, text AS body, lang, source, doc_id,
         length(text) AS chars, 1 AS start_line, len(string_split(text, chr(10))) AS end_line
  FROM documents)"""

CATALOG = """
geo AS (
  SELECT n_nationkey, n_name, n_regionkey, 'region/' || r_name || '/' || n_name AS geo_path
  FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS name, 'file' AS kind, 'region/' || r_name AS path, NULL::BIGINT AS chars, r_regionkey::BIGINT AS ord FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'file', geo_path, NULL, n_nationkey FROM geo
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'struct', geo_path, length(c_name), c_custkey FROM customer JOIN geo ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'method', geo_path, length(s_name), s_suppkey FROM supplier JOIN geo ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'class', 'part/' || p_brand || '/' || p_type, p_size, p_partkey FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order ' || o_orderkey, 'function', 'order/' || o_orderpriority || '/' || o_orderstatus, length(o_orderstatus), o_orderkey FROM orders),
edges AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'contains' AS relation FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'calls' FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'references' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'imports' FROM lineitem),
walk AS (SELECT * FROM edges WHERE relation <> 'contains')"""

COPIES = """
hashed AS (SELECT doc_id, text, lang || '/' || source || '/' || doc_id AS path FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id, arg_min(path, doc_id) AS first_path FROM hashed GROUP BY text),
copies AS (
  SELECT 'doc:' || h.doc_id AS source, 'doc:' || f.first_id AS target, 'references' AS relation,
         h.path, f.first_path AS target_path
  FROM hashed h JOIN firsts f ON h.text = f.text WHERE h.doc_id <> f.first_id)"""

SPANS = """
lens AS (SELECT lang || '/' || source || '/' || doc_id AS path, len(string_split(text, chr(10))) AS n FROM documents),
blocks AS (SELECT path, n, unnest(range(0, (n - 1) // 20 + 1)) AS b FROM lens),
spans AS (
  SELECT path || '#B' || b AS id, path, b * 20 + 1 AS s, least(b * 20 + 20, n) AS e, b * 10 AS ord FROM blocks
  UNION ALL
  SELECT path || '#B' || b || '.S' || k, path, b * 20 + k * 5 + 1, least(b * 20 + k * 5 + 5, n), b * 10 + k + 1
  FROM blocks, (VALUES (0), (1)) v(k) WHERE b * 20 + k * 5 + 1 <= n)"""

LINES = """
lines AS (
  SELECT path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text
  FROM (SELECT lang || '/' || source || '/' || doc_id AS path, string_split(text, chr(10)) AS parts FROM documents))"""

CONV = """
turns AS (
  SELECT 'conv:' || conv_id || '#' || role || '.' || turn AS id, role || turn AS name,
         CASE WHEN role = 'user' THEN 'function' ELSE 'method' END AS kind, 'conv/' || conv_id AS path, conv_id, turn, text
  FROM conversations),
replies AS (
  SELECT a.id AS source, b.id AS target, 'references' AS relation
  FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND a.turn - 1 = b.turn)"""


def lexical(query: str, source: str, by: str = "", body: str = "body", factor: bool = True, prefix: str = "lx") -> str:
    """CTEs ``lx_hits`` (id, …, lex, coverage, coverage_strong) over table ``source``.

    ``by`` is a column name for per-group statistics.
    """
    terms = query_terms(query)
    values = ", ".join(f"('{t}')" for t in terms)
    folds = ", ".join(f"('{t}', '{v}')" for t in terms for v in plural_forms(t))
    grp = f"{by}, " if by else ""
    group_by = f"GROUP BY {by}" if by else ""
    on = f"AND s.{by} = d.{by}" if by else ""
    p = prefix
    test = f"CASE WHEN regexp_matches(path, '{TEST_PATH}') THEN 0.35 ELSE 1.0 END" if factor else "1.0"
    return f"""
{p}_terms AS (SELECT * FROM (VALUES {values}) v(term)),
{p}_folds AS (SELECT * FROM (VALUES {folds}) v(term, form)),
{p}_tok AS MATERIALIZED (
  SELECT id, {grp}kind, path, {tokens('name')} AS nt, {tokens('path')} AS pt, {tokens(body)} AS bt FROM {source}),
{p}_cell AS MATERIALIZED (
  SELECT d.id, {f"d.{by}, " if by else ""}d.kind, d.path, len(d.bt) AS dl, q.term,
         len(list_filter(d.nt, lambda x: x = q.term)) AS n_tf,
         len(list_filter(d.pt, lambda x: x = q.term)) AS p_tf,
         len(list_filter(d.bt, lambda x: x = q.term)) AS b_tf,
         list_has_any(d.nt, (SELECT list(form) FROM {p}_folds f WHERE f.term = q.term)) AS n_has,
         list_has_any(d.nt || d.pt || d.bt, (SELECT list(form) FROM {p}_folds f WHERE f.term = q.term)) AS a_has
  FROM {p}_tok d CROSS JOIN {p}_terms q),
{p}_n AS (SELECT {grp}count(*) AS n, avg(len(bt)) AS avgdl FROM {p}_tok {group_by}),
{p}_df AS (
  SELECT {grp}term, count(*) FILTER (n_tf + p_tf + b_tf > 0) AS df FROM {p}_cell GROUP BY {grp}term),
{p}_idf AS (
  SELECT {f"x.{by}, " if by else ""}x.term, s.avgdl, ln(1 + s.n / (1 + x.df)) AS idf
  FROM {p}_df x JOIN {p}_n s ON {f"s.{by} = x.{by}" if by else "TRUE"}),
{p}_all AS (
  SELECT d.id, {f"d.{by}, " if by else ""}d.kind, d.path,
         sum(3 * s.idf * n_tf + 2 * s.idf * p_tf
             + s.idf * b_tf * 2.2 / (b_tf + 1.2 * (0.25 + 0.75 * dl / CASE WHEN s.avgdl = 0 THEN 1 ELSE s.avgdl END)))
           * any_value({test}) AS lex,
         sum(CASE WHEN a_has THEN s.idf ELSE 0 END) / sum(s.idf) AS coverage,
         CASE WHEN d.kind = 'file' THEN 0 ELSE sum(CASE WHEN n_has THEN s.idf ELSE 0 END) / sum(s.idf) END AS coverage_strong
  FROM {p}_cell d JOIN {p}_idf s ON s.term = d.term {on}
  GROUP BY d.id, {f"d.{by}, " if by else ""}d.kind, d.path),
{p}_hits AS MATERIALIZED (SELECT * FROM {p}_all WHERE lex > 0)"""


def pagerank(nodes: str, walk: str, seeds: str, by: str = "", prefix: str = "pr", steps: int = 25) -> str:
    """CTEs ending in ``pr`` (id, pr): the iteration written out step by step.

    ``nodes`` has id (and ``by``), ``walk`` source and target, ``seeds`` id and weight.
    """
    p = prefix
    same = f"AND a.{by} = b.{by}" if by else ""
    out = [f"""
{p}_in AS MATERIALIZED (
  SELECT w.source, w.target FROM {walk} w JOIN {nodes} a ON a.id = w.source JOIN {nodes} b ON b.id = w.target {same}),
{p}_adj AS MATERIALIZED (
  SELECT source AS src, target AS dst FROM {p}_in UNION ALL SELECT target, source FROM {p}_in),
{p}_deg AS MATERIALIZED (SELECT src, count(*) AS deg FROM {p}_adj GROUP BY src),
{p}_grp AS MATERIALIZED (SELECT id, {by or "0"} AS g FROM {nodes}),
{p}_w AS MATERIALIZED (
  SELECT s.id, g.g, s.weight / sum(s.weight) OVER (PARTITION BY g.g) AS w
  FROM {seeds} s JOIN {p}_grp g ON g.id = s.id),
{p}_r0 AS MATERIALIZED (SELECT id, g, w AS r FROM {p}_w)"""]
    for i in range(steps):
        out.append(f"""
{p}_r{i + 1} AS MATERIALIZED (
  SELECT id, any_value(g) AS g, sum(v) AS r FROM (
    SELECT a.dst AS id, r.g, 0.75 * r.r / d.deg AS v
    FROM {p}_r{i} r JOIN {p}_deg d ON d.src = r.id JOIN {p}_adj a ON a.src = r.id
    UNION ALL
    SELECT w.id, w.g, (0.25 + 0.75 * coalesce(l.loose, 0)) * w.w
    FROM {p}_w w LEFT JOIN (
      SELECT r.g, sum(r.r) AS loose FROM {p}_r{i} r LEFT JOIN {p}_deg d ON d.src = r.id WHERE d.src IS NULL GROUP BY r.g
    ) l ON l.g = w.g) GROUP BY id)""")
    out.append(f"\npr AS MATERIALIZED (SELECT id, g, r / max(r) OVER (PARTITION BY g) AS pr FROM {p}_r{steps})")
    return ",".join(out)
