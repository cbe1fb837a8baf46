"""Token statistics and lexical ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ranking import top_per_group
from ..operators import ask as A
from ..operators import lexical as L
from ..session import checkpoint_dir
from ..sources import tables as S
from ..sources.token_index import TokenStore
from . import sqltext as Q
from .registry import query

DOC_QUERY = "attion la elle mit"
PART_QUERY = "red widget economy"


def r6(col):
    return F.round(col, 6)


POSTINGS_SQL = f"""
WITH {Q.DOCS}, tok AS (
  SELECT id, 'name' AS field, unnest({Q.tokens('name')}) AS token FROM docs
  UNION ALL SELECT id, 'path', unnest({Q.tokens('path')}) FROM docs
  UNION ALL SELECT id, 'body', unnest({Q.tokens('body')}) FROM docs)"""


@query("tokenize_counts", f"""{POSTINGS_SQL}
SELECT field, token, count(*) AS n FROM tok GROUP BY field, token""")
def tokenize_counts(spark, sf):
    post = L.postings(S.document_nodes(spark, sf))
    return post.groupBy("field", "token").agg(F.sum("tf").alias("n"))


@query("token_postings", f"""{POSTINGS_SQL}
SELECT id, field, token, count(*) AS tf FROM tok GROUP BY id, field, token""")
def token_postings(spark, sf):
    return L.postings(S.document_nodes(spark, sf))


@query("doc_frequency", f"""{POSTINGS_SQL}
SELECT token, count(DISTINCT id) AS df FROM tok GROUP BY token""")
def doc_frequency(spark, sf):
    return L.document_frequency(L.postings(S.document_nodes(spark, sf)))


@query("idf_table", f"""{POSTINGS_SQL}, df AS (SELECT token, count(DISTINCT id) AS df FROM tok GROUP BY token)
SELECT token, round(ln(1 + (SELECT count(*) FROM documents) / (1 + df)), 6) AS idf FROM df""")
def idf_table(spark, sf):
    docs = S.document_nodes(spark, sf)
    df = L.document_frequency(L.postings(docs))
    return df.select("token", r6(L.idf(F.lit(docs.count()), F.col("df"))).alias("idf"))


@query("body_lengths", f"""WITH {Q.DOCS}
SELECT lang AS scope, count(*) AS docs, sum(len({Q.tokens('body')}))::BIGINT AS tokens,
       round(avg(len({Q.tokens('body')})), 6) AS avgdl FROM docs GROUP BY lang""")
def body_lengths(spark, sf):
    docs = S.document_nodes(spark, sf).select("lang", F.size(X.tokenize(F.col("body_text"))).alias("dl"))
    return docs.groupBy(F.col("lang").alias("scope")).agg(
        F.count("*").alias("docs"), F.sum("dl").alias("tokens"), r6(F.avg("dl")).alias("avgdl"))


def doc_hits(spark, sf, text=DOC_QUERY, by=None):
    docs = A.with_labels(S.document_nodes(spark, sf).withColumn("scope", F.col("lang")))
    return L.score_corpus(docs, text, A.LABELS, by)


LEX = Q.lexical(DOC_QUERY, "docs")


@query("lexical_scores", f"""WITH {Q.DOCS}, {LEX}
SELECT id, round(lex, 6) AS lex FROM lx_hits""")
def lexical_scores(spark, sf):
    return doc_hits(spark, sf).hits.select("id", r6("lex").alias("lex"))


@query("ask_lexical_topk", f"""WITH {Q.DOCS}, {LEX}
SELECT id, path, round(lex / (SELECT max(lex) FROM lx_hits), 6) AS score, round(coverage, 6) AS coverage
FROM lx_hits ORDER BY round(lex, 6) DESC, id LIMIT 8""")
def ask_lexical_topk(spark, sf):
    scored = doc_hits(spark, sf)
    hits = A.blend(scored, None, [])
    return scored.hits.select("id", "path").join(
        hits.select("id", "score", "coverage").orderBy(r6("score").desc(), "id").limit(8), "id"
    ).select("id", "path", r6("score").alias("score"), r6("coverage").alias("coverage"))


@query("bm25_topk", f"""WITH {Q.DOCS}, {LEX}, scored AS (
  SELECT d.id, round(sum(s.idf * b_tf * 2.2 / (b_tf + 1.2 * (0.25 + 0.75 * dl / s.avgdl))), 6) AS bm25
  FROM lx_cell d JOIN lx_idf s ON s.term = d.term GROUP BY d.id)
SELECT id, bm25 FROM scored WHERE bm25 > 0 ORDER BY bm25 DESC, id LIMIT 20""")
def bm25_topk(spark, sf):
    scored = doc_hits(spark, sf)
    one = scored.stats.first()
    weights = F.array(*[F.lit(v) for v in one["idf"]])
    body = L._bm25(F.col("body_tf"), weights, F.col("body_len"), F.lit(one["avgdl"]))
    return scored.matches.select("id", r6(body).alias("bm25")).where("bm25 > 0").orderBy(F.col("bm25").desc(), "id").limit(20)


@query("field_score_topk", f"""WITH {Q.CATALOG}, cat AS (SELECT *, '' AS body FROM nodes), {Q.lexical(PART_QUERY, 'cat')}
SELECT id, round(lex, 6) AS lex FROM lx_hits ORDER BY round(lex, 6) DESC, id LIMIT 20""")
def field_score_topk(spark, sf):
    nodes = A.with_labels(S.catalog_nodes(spark, sf))
    hits = L.score_corpus(nodes, PART_QUERY, A.LABELS).hits
    return hits.select("id", r6("lex").alias("lex")).orderBy(F.col("lex").desc(), "id").limit(20)


@query("ask_from_index", f"""WITH {Q.DOCS}, {LEX}
SELECT id, round(lex, 6) AS lex, round(coverage, 6) AS coverage, round(coverage_strong, 6) AS coverage_strong FROM lx_hits""")
def ask_from_index(spark, sf):
    """The same scores from a stored token index instead of the text."""
    docs = S.document_nodes(spark, sf)
    index = token_store(spark).update("first", docs).index()
    hits = L.score_corpus(docs.select("id", "path", "kind"), DOC_QUERY, [], index=index, whole=True).hits
    return hits.select("id", *[r6(c).alias(c) for c in ("lex", "coverage", "coverage_strong")])


def token_store(spark):
    return TokenStore(spark, f"{checkpoint_dir(spark)}/index/{uuid.uuid4().hex}")


@query("idf_from_index", f"""{POSTINGS_SQL}, df AS (SELECT token, count(DISTINCT id) AS df FROM tok GROUP BY token)
SELECT token, df, round(ln(1 + (SELECT count(*) FROM documents) / (1 + df)), 6) AS idf FROM df""")
def idf_from_index(spark, sf):
    """Weights from the stored counters of an index, without its postings."""
    index = token_store(spark).update("first", S.document_nodes(spark, sf)).index()
    return index.frequencies.select("token", "df", r6(L.idf(F.lit(index.n_docs), F.col("df"))).alias("idf"))


@query("index_after_delta", f"""{POSTINGS_SQL}, len AS (SELECT count(*) AS n_docs, round(avg(len({Q.tokens('body')})), 6) AS avgdl FROM docs)
SELECT token, count(DISTINCT id) AS df, count(*) AS tf, count(DISTINCT (id, field)) AS n_postings, any_value(n_docs) AS n_docs,
       any_value(avgdl) AS avgdl FROM tok, len GROUP BY token""")
def index_after_delta(spark, sf):
    """An index of an earlier state, brought up to date by two changes; the twin indexes the present state afresh.

    Earlier, web pages were indexed as well, the last language was not, and of
    texts with several lines there were only the first ones.
    """
    docs = S.document_nodes(spark, sf)
    last = docs.agg(F.max("lang")).first()[0]
    known = docs.where(F.col("lang") != F.lit(last))
    pages = S.table(spark, sf, "pages").select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("name"), F.col("url").alias("path"), F.col("html").alias("body_text"))
    begun = known.withColumn("body_text", F.substring_index("body_text", "\n", 1)).select(*pages.columns)
    store = token_store(spark).update("first", begun.union(pages))
    store = store.update("second", known.select(*pages.columns))  # everything is compared
    store = store.update("third", docs.where(F.col("lang") == F.lit(last)), docs.where(F.col("lang") == F.lit(last)))  # the change is named
    index = store.index()
    tokens = index.postings.groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("n_postings"))
    return tokens.join(index.frequencies, "token").select(
        "token", "df", "tf", "n_postings", F.lit(index.n_docs).alias("n_docs"), r6(F.lit(index.avgdl)).alias("avgdl"))


@query("ask_prefix_filtered", f"""WITH {Q.DOCS}, en AS (SELECT * FROM docs WHERE path = 'en' OR starts_with(path, 'en/')),
{Q.lexical(DOC_QUERY, 'en')}
SELECT id, round(lex / (SELECT max(lex) FROM lx_hits), 6) AS score, round(coverage, 6) AS coverage FROM lx_hits""")
def ask_prefix_filtered(spark, sf):
    """A prefix bounds the corpus, so every statistic differs from the whole."""
    hits = A.rank_nodes(S.document_nodes(spark, sf), None, DOC_QUERY, prefix="en").hits
    return hits.select("id", r6("score").alias("score"), r6("coverage").alias("coverage"))


@query("coverage_share", f"""WITH {Q.DOCS}, {LEX}
SELECT id, round(coverage, 6) AS coverage, round(coverage_strong, 6) AS coverage_strong FROM lx_all""")
def coverage_share(spark, sf):
    """Match strength of every document, plural forms folded."""
    scored = doc_hits(spark, sf)
    return L.coverage_of(scored.matches, scored.stats, []).select(
        "id", r6("coverage").alias("coverage"), r6("coverage_strong").alias("coverage_strong"))


def _test_paths(pages):
    return pages.select(
        F.col("url").alias("id"), F.col("page_id"),
        F.when(F.col("url").startswith("https"), F.concat(F.lit("tests"), F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)))
        .otherwise(F.concat(F.lit("src"), F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1))).alias("path"))


@query("test_path_penalty", f"""
WITH p AS (
  SELECT url AS id, CASE WHEN starts_with(url, 'https') THEN 'tests' ELSE 'src' END
         || regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT id, path, regexp_matches(path, '{X.TEST_PATH}') AS is_test,
       CASE WHEN regexp_matches(path, '{X.TEST_PATH}') THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END AS factor,
       1.0::DOUBLE AS factor_for_tests FROM p""")
def test_path_penalty(spark, sf):
    rows = _test_paths(S.table(spark, sf, "pages"))
    return rows.select(
        "id", "path", X.is_test_path(F.col("path")).alias("is_test"),
        X.test_factor(F.col("path"), "open the door").alias("factor"),
        X.test_factor(F.col("path"), "which tests cover it").alias("factor_for_tests"))


@query("slug_and_first_prose", """
WITH t AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS name FROM documents),
flat AS (SELECT doc_id, text, regexp_replace(regexp_replace(lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))),
         '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM t)
SELECT doc_id, CASE WHEN slug = '' THEN 'node' ELSE slug END AS slug,
       coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)),
         lambda s: s <> '' AND NOT regexp_matches(s, '^(#|<!--|-)'))[1], '') AS prose,
       sha256(text) AS hash, floor(length(text) / 4.0 + 0.5)::BIGINT AS est_tokens,
       lang || '/' || source AS dir FROM flat JOIN documents USING (doc_id, text)""")
def slug_and_first_prose(spark, sf):
    """The small text functions over whole texts."""
    d = S.table(spark, sf, "documents")
    name = F.substring_index("text", "\n", 1)
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    return d.select(
        "doc_id", X.slugify(name).alias("slug"), X.first_prose(F.col("text")).alias("prose"),
        X.content_hash(F.col("text")).alias("hash"), X.to_tokens(F.length("text")).alias("est_tokens"),
        X.dir_key(path, 2).alias("dir"))


SCOPE_LEX = Q.lexical(DOC_QUERY, "docs", by="lang")


@query("scope_lexical_topk", f"""WITH {Q.DOCS}, {SCOPE_LEX}
SELECT lang AS scope, id, round(lex, 6) AS lex, row_number() OVER (PARTITION BY lang ORDER BY round(lex, 6) DESC, id) AS rank
FROM lx_hits QUALIFY rank <= 10""")
def scope_lexical_topk(spark, sf):
    hits = doc_hits(spark, sf, by=["scope"]).hits.withColumn("lex", r6("lex"))
    top = top_per_group(hits, ["scope"], [F.col("lex").desc(), F.col("id")], 10)
    return top.select("scope", "id", "lex", F.col("rank").cast("long").alias("rank"))


GATE = """
best AS (SELECT lang, id, coverage, coverage_strong FROM lx_hits
         QUALIFY row_number() OVER (PARTITION BY lang ORDER BY lex DESC, id) = 1)"""


@query("scope_gate_also_matched", f"""WITH {Q.DOCS}, {SCOPE_LEX}, {GATE}
SELECT lang AS scope, id AS best_id, round(coverage, 6) AS coverage, round(coverage_strong, 6) AS coverage_strong,
       coverage_strong >= 0.1 OR coverage >= 0.5 AS joins FROM best""")
def scope_gate_also_matched(spark, sf):
    gate = A.scope_gate(doc_hits(spark, sf, by=["scope"]).hits)
    return gate.select("scope", "best_id", r6("coverage").alias("coverage"), r6("coverage_strong").alias("coverage_strong"), "joins")


def rrf_sql(k: int) -> str:
    return f"""
kept AS (SELECT h.lang AS scope, h.id, round(h.lex / max(h.lex) OVER (PARTITION BY h.lang), 9) AS score
         FROM lx_hits h JOIN best b ON b.lang = h.lang AND (b.coverage_strong >= 0.1 OR b.coverage >= 0.5)),
ranked AS (SELECT scope, id, score, 1.0 / (60 + row_number() OVER (PARTITION BY scope ORDER BY score DESC, id)) AS s FROM kept),
fused AS (SELECT id, scope, CASE WHEN (SELECT count(DISTINCT scope) FROM kept) > 1 THEN s / max(s) OVER () ELSE score END AS score FROM ranked)
SELECT id, scope, round(score, 6) AS score FROM fused ORDER BY round(score, 6) DESC, scope, id LIMIT {k}"""


@query("ask_scope_rrf", f"WITH {Q.DOCS}, {SCOPE_LEX}, {GATE}, {rrf_sql(12)}")
def ask_scope_rrf(spark, sf):
    nodes = S.document_nodes(spark, sf).withColumn("scope", F.col("lang"))
    ranking = A.rank_scopes(nodes, None, DOC_QUERY, limit=12)
    return ranking.hits.select("id", "scope", r6("score").alias("score")).orderBy(F.col("score").desc(), "scope", "id").limit(12)
