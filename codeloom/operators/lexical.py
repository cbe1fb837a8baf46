"""Field-weighted lexical scoring.

A query names few terms, so a document is reduced in place, without a
shuffle, to its counts of those terms plus its body length.  The text is
read and split once; statistics and scores come from the compact rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import broadcast_if_small, materialize, store_table

# Field weights and BM25 parameters.
NAME_WEIGHT, PATH_WEIGHT = 3.0, 2.0
K1, B = 1.2, 0.75

FIELDS = ("name", "path", "body")


def body_of(docs: DataFrame) -> Column:
    """Searchable body: signature, summary and body text that are present."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("signature", "summary", "body_text") if c in docs.columns]
    return F.concat_ws(" ", *parts)


# --------------------------------------------------------------------------
# query-time reduction of documents


def _count(hits: Column, term: str) -> Column:
    return F.size(F.filter(hits, lambda x: x == term))


def _tf(hits: Column, terms: list[str]) -> Column:
    return F.array(*[_count(hits, t) for t in terms])


def _has(hits: Column, terms: list[str]) -> Column:
    return F.array(*[F.arrays_overlap(hits, F.array(*map(F.lit, X.plural_forms(t)))) for t in terms])


def term_matches(docs: DataFrame, terms: list[str], keep: list[str]) -> DataFrame:
    """One compact row per document: term counts and presence per field.

    ``name_tf`` … ``body_tf`` are aligned with ``terms``; ``name_has`` and
    ``any_has`` fold plurals, as coverage does.
    """
    wanted = sorted({v for t in terms for v in X.plural_forms(t)})
    sources = {"name": F.col("name"), "path": F.col("path"), "body": body_of(docs)}
    tokens = docs.select("id", *keep, *[X.tokenize(c).alias(f"{f}_tokens") for f, c in sources.items()])
    hits = tokens.select(
        "id", *keep,
        F.size("body_tokens").alias("body_len"),
        *[F.filter(f"{f}_tokens", lambda x: x.isin(*wanted)).alias(f"{f}_hits") for f in FIELDS],
    )
    everything = F.concat(*[F.col(f"{f}_hits") for f in FIELDS])
    return hits.select(
        "id", *keep, "body_len",
        *[_tf(F.col(f"{f}_hits"), terms).alias(f"{f}_tf") for f in FIELDS],
        _has(F.col("name_hits"), terms).alias("name_has"),
        _has(everything, terms).alias("any_has"),
    )


def _in_document(i: int) -> Column:
    return sum((F.get(f"{f}_tf", F.lit(i)) for f in FIELDS), F.lit(0)) > 0


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + n / (1 + df))


@dataclass
class ConceptStats:
    """Concept notes count as documents everywhere: their number and term counts."""

    n: int
    df: list[int]


def no_concepts(terms: list[str]) -> ConceptStats:
    return ConceptStats(0, [0] * len(terms))


def corpus_stats(matches: DataFrame, terms: list[str], by: list[str], concepts: ConceptStats) -> DataFrame:
    """Document count, mean body length, idf per term and unseen-term idf."""
    counted = matches.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("body_len").alias("avgdl"),
        *[F.sum(_in_document(i).cast("long")).alias(f"df{i}") for i in range(len(terms))],
    )
    n = F.col("n") + concepts.n
    return counted.select(
        *by,
        n.alias("n_docs"),
        F.col("avgdl"),
        F.array(*[idf(n, F.col(f"df{i}") + concepts.df[i]) for i in range(len(terms))]).alias("idf"),
    )


def _dot(tf: Column, weights: Column) -> Column:
    products = F.zip_with(tf, weights, lambda a, w: a * w)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def _bm25(tf: Column, weights: Column, dl: Column, avgdl: Column) -> Column:
    norm = K1 * (1 - B + B * dl / F.when(avgdl == 0, 1.0).otherwise(avgdl))
    parts = F.zip_with(tf, weights, lambda a, w: w * (a * (K1 + 1)) / (a + norm))
    return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)


def share(has: Column, weights: Column) -> Column:
    """idf-weighted share of the query that is present."""
    matched = F.aggregate(
        F.zip_with(has, weights, lambda h, w: F.when(h, w).otherwise(0.0)), F.lit(0.0), lambda acc, v: acc + v
    )
    total = F.aggregate(weights, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(total > 0, matched / total).otherwise(0.0)


def _is_matched() -> Column:
    return F.exists(F.concat(*[F.col(f"{f}_tf") for f in FIELDS]), lambda a: a > 0)


def _with_scores(rows: DataFrame, weights: Column, avgdl: Column, query: str) -> DataFrame:
    raw = (
        NAME_WEIGHT * _dot(F.col("name_tf"), weights)
        + PATH_WEIGHT * _dot(F.col("path_tf"), weights)
        + _bm25(F.col("body_tf"), weights, F.col("body_len"), avgdl)
    )
    kept = [c for c in rows.columns if c not in
            {"name_tf", "path_tf", "body_tf", "name_has", "any_has", "body_len", "idf", "avgdl", "n_docs"}]
    return rows.select(
        *kept,
        (raw * X.test_factor(F.col("path"), query)).alias("lex"),
        share(F.col("any_has"), weights).alias("coverage"),
        F.when(F.col("kind") == "file", 0.0).otherwise(share(F.col("name_has"), weights)).alias("coverage_strong"),
    )


@dataclass
class Scored:
    """Documents with a positive score, and what to use for the others."""

    hits: DataFrame      # id, kept columns, lex, coverage, coverage_strong
    matches: DataFrame   # compact row of every document
    stats: DataFrame     # statistics, one row per scope (or one row)


@dataclass
class TokenIndex:
    """A stored token index: postings, the body length of every document, and where kept their statistics."""

    postings: DataFrame      # id, field, token, tf
    body_lengths: DataFrame  # id, body_len
    frequencies: DataFrame | None = None  # token, df
    n_docs: int = 0
    avgdl: float = 0.0

    def stats(self, terms: list[str], concepts: ConceptStats) -> DataFrame:
        """The row of ``corpus_stats`` over the whole index, from its counters alone."""
        found = dict(self.frequencies.where(F.col("token").isin(*terms)).select("token", "df").collect())  # a row per term
        n = F.lit(self.n_docs + concepts.n)
        row = self.postings.sparkSession.range(1)
        weights = [idf(n, F.lit(found.get(t, 0) + concepts.df[i])) for i, t in enumerate(terms)]
        return row.select(n.alias("n_docs"), F.lit(self.avgdl).alias("avgdl"), F.array(*weights).alias("idf"))


def score_corpus(
    docs: DataFrame,
    query: str,
    keep: list[str],
    by: list[str] | None = None,
    concepts: ConceptStats | None = None,
    index: TokenIndex | None = None,
    whole: bool = False,
) -> Scored:
    """Score ``docs`` against ``query``, with statistics per ``by`` group.

    The statistics have one row per group.  With a stored index only the
    postings of the query's terms are read, not the texts.  If ``docs`` are
    all that is indexed (``whole``), its stored statistics are used and only
    documents that hold a term are looked at.
    """
    by = by or []
    terms = X.query_terms(query)
    concepts = concepts or no_concepts(terms)
    keep = list(dict.fromkeys([*keep, *by, "path", "kind"]))
    if not terms:
        empty = docs.select("id", *keep).where(F.lit(False))
        zero = F.lit(0.0)
        hits = empty.select("*", zero.alias("lex"), zero.alias("coverage"), zero.alias("coverage_strong"))
        return Scored(hits, empty, empty)
    if index is not None and whole and not by and index.frequencies is not None:
        info = docs.select("id", *keep).join(index.body_lengths, "id")
        stats = index.stats(terms, concepts)
        matched = materialize(matches_from_index(index.postings, info, terms, keep, "inner"))
        return score_matches(matched, terms, query, stats=stats, others=matches_from_index(index.postings, info, terms, keep))
    if index is None:
        matches = term_matches(docs, terms, keep)
    else:
        info = docs.select("id", *keep).join(index.body_lengths, "id")
        matches = matches_from_index(index.postings, info, terms, keep)
    return score_matches(store_table(matches)[0], terms, query, by, concepts)  # a row per document, of which each reader needs little


def score_matches(
    matches: DataFrame, terms: list[str], query: str, by: list[str] | None = None, concepts: ConceptStats | None = None,
    stats: DataFrame | None = None, others: DataFrame | None = None,
) -> Scored:
    """Score compact rows, read from the text or from a stored index.

    With ``stats`` the rows need only be those that hold a term; ``others`` are
    then the rows of all documents, which nothing reads unless asked for some.
    """
    by, concepts = by or [], concepts or no_concepts(terms)
    if stats is None:
        stats = corpus_stats(matches, terms, by, concepts)
    matched = matches.where(_is_matched())
    if by:
        stats = broadcast_if_small(stats)
        scored = _with_scores(matched.join(stats, by), F.col("idf"), F.col("avgdl"), query)
    else:
        one = stats.first()  # a single row of query-sized numbers
        weights = F.array(*[F.lit(float(v)) for v in one["idf"]])
        scored = _with_scores(matched, weights, F.lit(float(one["avgdl"] or 0.0)), query)
    return Scored(scored.where(F.col("lex") > 0), matches if others is None else others, stats)


def coverage_of(rows: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Coverage columns for compact rows that need not match lexically."""
    if by:
        rows = rows.join(stats, by)
        weights = F.col("idf")
    else:
        weights = F.array(*[F.lit(float(v)) for v in stats.first()["idf"]])
    return rows.select(
        "id", *by,
        share(F.col("any_has"), weights).alias("coverage"),
        F.when(F.col("kind") == "file", 0.0).otherwise(share(F.col("name_has"), weights)).alias("coverage_strong"),
    )


# --------------------------------------------------------------------------
# concepts


def concept_matches(concepts: DataFrame, query: str) -> tuple[ConceptStats, DataFrame]:
    """The concept notes' share of the statistics and the compact rows that match.

    ``concepts``: slug, name, text, … .
    """
    terms = X.query_terms(query)
    docs = concepts.select(
        F.col("slug").alias("id"), "name", F.lit("").alias("path"), F.col("text").alias("body_text"),
        F.lit("concept").alias("kind"),
    )
    rows = materialize(term_matches(docs, terms, ["kind"]))
    agg = rows.agg(
        F.count("*").alias("n"),
        *[F.coalesce(F.sum(_in_document(i).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(len(terms))],
    ).first()
    return ConceptStats(agg["n"], [agg[f"df{i}"] for i in range(len(terms))]), rows.where(_is_matched())


def score_concepts(matched: DataFrame, weights: Column) -> DataFrame:
    total = NAME_WEIGHT * _dot(F.col("name_tf"), weights) + _dot(F.col("body_tf"), weights)
    return matched.select(
        "id",
        total.alias("raw"),
        share(F.col("any_has"), weights).alias("coverage"),
        share(F.col("name_has"), weights).alias("coverage_strong"),
    ).where(F.col("raw") > 0)


# --------------------------------------------------------------------------
# the stored token index


def postings(docs: DataFrame) -> DataFrame:
    """Long token table: one row per document, field and token.

    All tokens of a document sit in one row, so the partial aggregate before
    the shuffle already holds the final counts.
    """
    fields = {"name": F.col("name"), "path": F.col("path"), "body": body_of(docs)}
    tagged = F.array_compact(F.array(*[
        F.struct(F.lit(f).alias("field"), X.tokenize(c).alias("tokens")) for f, c in fields.items()
    ]))
    flat = docs.select("id", F.explode(tagged).alias("f")).select(
        "id", F.col("f.field").alias("field"), F.explode("f.tokens").alias("token"))
    return flat.groupBy("id", "field", "token").agg(F.count("*").alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    """Documents per token.  Deduplicates first, so a common token only adds counts."""
    return post.select("id", "token").distinct().groupBy("token").agg(F.count("*").alias("df"))


def body_lengths(docs: DataFrame, post: DataFrame) -> DataFrame:
    """Body token count of every document, zero included."""
    lengths = post.where(F.col("field") == "body").groupBy("id").agg(F.sum("tf").alias("dl"))
    return docs.select("id").join(lengths, "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("body_len"))


def matches_from_index(index: DataFrame, doc_info: DataFrame, terms: list[str], keep: list[str], how: str = "left") -> DataFrame:
    """Rebuild the compact rows from a stored token index.

    ``index`` is ``postings``; only the query's terms are read, which the
    parquet token statistics prune.  ``doc_info`` carries id, kept columns and
    body_len, one row per document; an ``inner`` join leaves out those without a term.
    """
    wanted = sorted({v for t in terms for v in X.plural_forms(t)})
    cells = index.where(F.col("token").isin(*wanted))

    def tf(field: str, t: str) -> Column:
        hit = (F.col("field") == field) & (F.col("token") == t)
        return F.coalesce(F.sum(F.when(hit, F.col("tf"))), F.lit(0)).cast("int")

    def has(cond: Column) -> Column:
        return F.coalesce(F.max(cond), F.lit(False))

    per_doc = cells.groupBy("id").agg(
        *[F.array(*[tf(f, t) for t in terms]).alias(f"{f}_tf") for f in FIELDS],
        F.array(*[has(F.col("token").isin(*X.plural_forms(t)) & (F.col("field") == "name")) for t in terms]).alias("name_has"),
        F.array(*[has(F.col("token").isin(*X.plural_forms(t))) for t in terms]).alias("any_has"),
    )
    zeros = F.array(*[F.lit(0) for _ in terms])
    nothing = F.array(*[F.lit(False) for _ in terms])
    return doc_info.join(per_doc, "id", how).select(
        "id", *keep, "body_len",
        *[F.coalesce(f"{f}_tf", zeros).alias(f"{f}_tf") for f in FIELDS],
        F.coalesce("name_has", nothing).alias("name_has"),
        F.coalesce("any_has", nothing).alias("any_has"),
    )
