"""Concept notes: batching, merging and linking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ranking import ordered_prefix
from ..session import broadcast_if_small, materialize

# Characters per batch and per entry besides its texts.
BATCH_CHARS = 48_000
ENTRY_OVERHEAD = 8


# --------------------------------------------------------------------------
# summaries and batches


def summarize_files(files: DataFrame, cache: DataFrame, summarizer: Callable[[str, str], str]) -> DataFrame:
    """One summary per file (path, content, hash); unchanged files reuse the cache.

    The summarizer sees the whole text and clips it itself where it must.

    Returns (path, hash, summary, error, cached).
    """
    known = cache.select("path", "hash", F.col("summary").alias("old"))
    joined = files.select("path", "content", "hash").join(known, ["path", "hash"], "left")
    reused = joined.where(F.col("old").isNotNull()).select(
        "path", "hash", F.col("old").alias("summary"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, hash_ in zip(b["path"], b["content"], b["hash"]):
                try:
                    rows.append((path, hash_, summarizer(path, content), None, False))
                except Exception as e:  # kept: the file still counts, unsummarized
                    rows.append((path, hash_, None, str(e), False))
            yield pd.DataFrame(rows, columns=["path", "hash", "summary", "error", "cached"])

    fresh = joined.where(F.col("old").isNull()).select("path", "content", "hash").mapInPandas(
        run, "path string, hash string, summary string, error string, cached boolean")
    return reused.unionByName(fresh)


def batch_by_size(entries: DataFrame, budget: int = BATCH_CHARS) -> DataFrame:
    """Pack entries (path, size) greedily in path order: adds ``batch``.

    A batch takes entries while they fit, at least one; it is named by the
    position of its first entry.  Where a batch would end depends only on
    where it begins, so the ends are found for every entry at once.  The
    batches in use form the chain of ends from entry 1, which is marked by
    doubling the length of the jumps.
    """
    placed = materialize(ordered_prefix(entries, [F.col("path")], "size"))
    ends = materialize(_next_start(placed, budget))
    starts, hops = ends.where(F.col("pos") == 1).select("pos"), ends
    known = starts.count()
    while True:
        step = starts.join(hops, "pos").join(ends.select(F.col("pos").alias("next")), "next", "left_semi")
        starts = materialize(starts.unionAll(step.select(F.col("next").alias("pos"))).distinct())
        now = starts.count()
        if now == known:
            break
        known = now
        far = hops.select(F.col("pos").alias("next"), F.col("next").alias("far"))
        hops = materialize(hops.join(far, "next").select("pos", F.col("far").alias("next")))
    spans = starts.join(ends, "pos").select(
        F.col("pos").alias("batch"), F.explode(F.sequence(F.col("pos"), F.col("next") - 1)).alias("pos"))
    return placed.join(spans, "pos").drop("run", "pos")


def _next_start(placed: DataFrame, budget: int) -> DataFrame:
    """The first entry that no longer fits a batch begun at each entry: (pos, next).

    Running sums are laid on a grid of the budget's width.  A batch's limit
    lies exactly one cell after the sum it begins at, so it is compared only
    with entries of its own cell and with the last entry of the cell before.
    """
    points = placed.select("pos", F.col("run").alias("at"), F.lit(0).alias("limit"))
    limits = placed.select("pos", (F.col("run") - F.col("size") + budget).alias("at"), F.lit(1).alias("limit"))
    both = points.unionAll(limits).withColumn("cell", F.floor(F.col("at") / budget))
    inside = Window.partitionBy("cell").orderBy("at", "limit")
    fits = both.withColumn("fit", F.max(F.when(F.col("limit") == 0, F.col("pos"))).over(inside))
    before = points.groupBy((F.floor(F.col("at") / budget) + 1).alias("cell")).agg(F.max("pos").alias("prev"))
    return fits.where(F.col("limit") == 1).join(before, "cell", "left").select(
        "pos", (F.greatest(F.coalesce("fit", F.lit(0)), F.coalesce("prev", F.lit(0)), F.col("pos")) + 1).alias("next"))


def batch_keys(batched: DataFrame) -> DataFrame:
    """Digest per batch over its ``path:hash`` lines.  A batch is bounded by its budget."""
    line = F.concat_ws(":", "path", F.coalesce("hash", F.lit("")))
    return batched.groupBy("batch").agg(F.count("*").alias("files"), X.digest(F.collect_list(line)).alias("key"))


DRAFT = (
    "pos int, name string, type string, summary string, sources array<string>, "
    "links array<struct<to:string,relation:string,description:string>>"
)


def synthesize(batched: DataFrame, synthesizer: Callable[[list[tuple[str, str]]], list[dict]]) -> DataFrame:
    """Draft concepts for every batch (batch, path, summary) with a user's function.

    A batch is bounded by its budget.  ``ord`` keeps batch and answer order.
    """
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        drafts = synthesizer(list(zip(pdf["path"], pdf["summary"])))
        rows = [(key[0], i, d["name"], d.get("type"), d.get("summary"), list(d.get("sources") or []),
                 [{"to": x["to"], "relation": x.get("relation"), "description": x.get("description")} for x in d.get("links") or []])
                for i, d in enumerate(drafts)]
        return pd.DataFrame(rows, columns=["batch", "pos", "name", "type", "summary", "sources", "links"])

    drafts = batched.select("batch", "path", "summary").groupBy("batch").applyInPandas(run, "batch bigint, " + DRAFT)
    return drafts.withColumn("ord", F.col("batch") * 1_000_000 + F.col("pos")).drop("batch", "pos")


# --------------------------------------------------------------------------
# merging and linking

# Drafts of notes: ord, name, type, summary, sources array<string>,
# links array<struct<to, relation, description>>.


def merge(drafts: DataFrame) -> DataFrame:
    """One concept per slug: first name, longest summary, first telling type."""
    d = drafts.withColumn("slug", X.slugify("name"))
    text = F.coalesce("summary", F.lit(""))
    told = F.when((F.col("type") != "concept") & (F.col("type") != ""), F.col("type"))
    return d.groupBy("slug").agg(
        F.min("ord").alias("ord"),
        F.min_by("name", "ord").alias("name"),
        F.max_by(text, F.struct(F.length(text), -F.col("ord"))).alias("summary"),
        F.coalesce(F.min_by(told, F.when(told.isNotNull(), F.col("ord"))), F.lit("concept")).alias("type"),
    )


def own_sources(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """Sources of each concept that are known files: (slug, path, hash)."""
    named = drafts.select(X.slugify("name").alias("slug"), F.explode("sources").alias("path")).distinct()
    return named.join(files.select("path", "hash"), "path").select("slug", "path", "hash")


def resolve_links(drafts: DataFrame) -> DataFrame:
    """Links between defined concepts, first of each (to, relation): (slug, to, relation, description, ord, pos)."""
    names = drafts.where(X.name_key(F.col("name")) != "").groupBy(X.name_key(F.col("name")).alias("key")).agg(
        F.min_by(X.slugify("name"), "ord").alias("to_slug"))
    said = drafts.select(X.slugify("name").alias("slug"), "ord", F.posexplode("links").alias("pos", "l")).select(
        "slug", "ord", "pos", X.name_key(F.col("l.to")).alias("key"), F.col("l.relation").alias("relation"),
        F.col("l.description").alias("description"))
    found = said.join(names, "key").where(F.col("to_slug") != F.col("slug"))
    first = F.min(F.struct("ord", "pos", "description"))
    return found.groupBy("slug", F.col("to_slug").alias("to"), "relation").agg(first.alias("f")).select(
        "slug", "to", "relation", F.col("f.description").alias("description"), F.col("f.ord").alias("ord"),
        F.col("f.pos").alias("pos"))


def inherit_sources(concepts: DataFrame, own: DataFrame, links: DataFrame) -> DataFrame:
    """Sources with inheritance: a concept without any takes those of its link targets.

    Concepts are filled in order, so one filled earlier can feed a later one
    but not the reverse.  Each round passes on only what was new in the last.
    What travels are pairs of concepts; files are attached to them once, at the
    end.  Only files that several concepts name can then meet a concept twice.
    """
    has = own.select("slug").distinct()
    empty = materialize(concepts.join(has, "slug", "left_anti").select("slug", "ord"))
    pull = materialize(links.select("slug", "to").distinct().join(empty, "slug"))
    later = materialize(
        pull.join(empty.select(F.col("slug").alias("to"), F.col("ord").alias("to_ord")), "to")
        .where(F.col("to_ord") < F.col("ord")).select("slug", "to"))
    new = materialize(pull.join(has.withColumnRenamed("slug", "to"), "to", "left_semi").select("slug", F.col("to").alias("giver")))
    gained = new
    while not new.isEmpty():
        passed = later.join(new.withColumnRenamed("slug", "to"), "to").select("slug", "giver").distinct()
        new = materialize(passed.join(gained, ["slug", "giver"], "left_anti"))
        gained = materialize(gained.unionAll(new))
    given = own.select(F.col("slug").alias("giver"), "path", "hash").distinct()
    several = materialize(given.groupBy("path").agg(F.count_distinct("giver").alias("n")).where("n > 1").select("path"))
    pairs = broadcast_if_small(gained)
    once = given.join(broadcast_if_small(several), "path", "left_anti").join(pairs, "giver").select("slug", "path", "hash")
    more = given.join(several, "path", "left_semi").join(pairs, "giver").select("slug", "path", "hash").distinct()
    return own.unionByName(once).unionByName(more)


def build_concepts(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """Finished concept notes with sources, digest and links."""
    drafts = materialize(drafts)
    merged = materialize(merge(drafts))
    links = materialize(resolve_links(drafts))
    sources = inherit_sources(merged, materialize(own_sources(drafts, files)), links)
    packed = sources.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("path", "hash"))).alias("sources"))
    linked = links.groupBy("slug").agg(
        F.sort_array(F.collect_list(F.struct("to", "ord", "pos", "relation", "description"))).alias("l"))
    lines = F.transform("sources", lambda s: F.concat_ws(":", s["path"], s["hash"]))
    none = F.array().cast("array<struct<path:string,hash:string>>")
    no_links = F.array().cast("array<struct<to:string,relation:string,description:string>>")
    shown = F.transform("l", lambda x: F.struct(x["to"].alias("to"), x["relation"].alias("relation"),
                                                x["description"].alias("description")))
    return (
        merged.join(packed, "slug", "left").join(linked, "slug", "left")
        .withColumn("sources", F.coalesce("sources", none))
        .select("slug", "name", "type", "summary", "sources", X.digest(lines).alias("sources_digest"),
                F.coalesce(shown, no_links).alias("links"))
    )


def orphan_notes(existing: DataFrame, concepts: DataFrame) -> DataFrame:
    """Notes on disk that no concept stands behind any more."""
    return existing.join(concepts.select("slug"), "slug", "left_anti")


def tree_digest(files: DataFrame, digits: int = 3) -> DataFrame:
    """One digest over all (path, hash), folded in two levels.

    Lines are digested per hash bucket of the path and the bucket digests are
    digested in turn, so no task ever sees the whole list.  More ``digits``
    mean more and smaller buckets.
    """
    bucket = F.substring(X.content_hash(F.col("path")), 1, digits)
    line = F.concat_ws(":", "path", "hash")
    per = files.groupBy(bucket.alias("bucket")).agg(X.digest(F.collect_list(line)).alias("d"), F.count("*").alias("n"))
    entry = F.concat_ws(":", "bucket", "d")
    return per.agg(X.digest(F.collect_list(entry)).alias("digest"), F.sum("n").alias("files"))
