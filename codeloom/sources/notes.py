"""Markdown notes: concept notes, file cards and the index page."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.viz import GENERATED_END, GENERATED_START
from .files import delete_files, list_tree, read_contents, write_texts

INDEX = "INDEX.md"
MANIFEST = "manifest.json"
VERSION = 1

SOURCE = T.StructType([T.StructField("path", T.StringType()), T.StructField("hash", T.StringType())])
LINK = T.StructType([T.StructField(c, T.StringType()) for c in ("to", "relation", "description")])
FRONT = T.StructType([
    T.StructField("slug", T.StringType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("sources", T.ArrayType(SOURCE)), T.StructField("sources_digest", T.StringType()),
    T.StructField("links", T.ArrayType(LINK)), T.StructField("body", T.StringType()), T.StructField("broken", T.BooleanType()),
])


@F.pandas_udf(FRONT)
def _front_matter(text: pd.Series) -> pd.DataFrame:
    import yaml

    rows = []
    for t in text:
        meta, body, broken = {}, t or "", False
        if body.startswith("---\n") and "\n---" in body[3:]:
            head, _, body = body[4:].partition("\n---")
            body = body.partition("\n")[2]
            try:
                meta = yaml.safe_load(head) or {}
            except yaml.YAMLError:
                meta, broken = {}, True
        if not isinstance(meta, dict):
            meta, broken = {}, True
        as_list = lambda k: meta.get(k) if isinstance(meta.get(k), list) else []
        said = lambda d, k: None if d.get(k) is None else str(d[k])
        rows.append({
            **{k: said(meta, k) for k in ("slug", "name", "type", "sources_digest")},
            "sources": [{k: said(s, k) for k in ("path", "hash")} for s in as_list("sources") if isinstance(s, dict)],
            "links": [{k: said(d, k) for k in ("to", "relation", "description")} for d in as_list("links") if isinstance(d, dict)],
            "body": body, "broken": broken,
        })
    return pd.DataFrame(rows, columns=[f.name for f in FRONT.fields])


def parse_notes(texts: DataFrame) -> DataFrame:
    """Front matter and body of notes (path, content)."""
    return texts.select("path", _front_matter("content").alias("n")).select("path", "n.*").withColumn(
        "slug", F.coalesce("slug", F.regexp_replace("path", r"\.md$", "")))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Concept notes of a folder; the index page is none of them."""
    files = list_tree(spark, folder).where(
        ~F.col("is_dir") & F.col("path").rlike(r"^[^/]+\.md$") & (F.col("path") != INDEX))
    return parse_notes(read_contents(files, folder).where(F.col("content").isNotNull()))


def concept_docs(notes: DataFrame) -> DataFrame:
    """Notes as documents to rank: slug, name, sources, related, snippet, text."""
    paths = F.transform("sources", lambda s: s["path"])
    prose = X.first_prose(F.col("body"))
    return notes.where(~F.col("broken")).select(
        "slug", F.coalesce("name", F.lit("")).alias("name"), paths.alias("sources"),
        F.transform("links", lambda x: x["to"]).alias("related"), prose.alias("snippet"),
        F.concat_ws(" ", F.coalesce("name", F.lit("")), prose, F.concat_ws(" ", paths)).alias("text"))


# --------------------------------------------------------------------------
# concept notes

DEFAULT_TAIL = "\n## Notes\n\n_Text below the generated block is kept when the note is written again._\n"


@F.pandas_udf(T.StringType())  # a parsed type name would need a session at import
def _yaml(front: pd.DataFrame) -> pd.Series:
    import yaml

    plain = lambda items, drop=(): [
        {k: v for k, v in dict(i).items() if not (k in drop and not v)} for i in (items if items is not None else [])]
    out = []
    for r in front.to_dict("records"):
        data = {"name": r["name"], "slug": r["slug"], "type": r["type"], "sources": plain(r["sources"]),
                "sources_digest": r["sources_digest"], "links": plain(r["links"], ("description",)),
                "generator": {"version": VERSION}}
        if r.get("covers") is not None:
            data["covers"] = plain(r["covers"])
        out.append(yaml.safe_dump(data, sort_keys=False, allow_unicode=True))
    return pd.Series(out)


def human_tail(content):
    """What a person wrote below the generated block."""
    after = F.substring(content, F.instr(content, GENERATED_END) + len(GENERATED_END), F.length(content))
    return F.when(F.instr(content, GENERATED_END) > 0, F.regexp_replace(after, r"^\n", "")).otherwise(F.lit(DEFAULT_TAIL))


def render_notes(concepts: DataFrame, existing: DataFrame) -> DataFrame:
    """Note files (path, text) of finished concepts, human tails kept.

    ``existing``: path, content of the notes on disk.  ``concepts`` may carry
    ``covers``, the symbols its sources hold.
    """
    link = F.transform(F.array_sort("links"), lambda x: F.concat(
        F.lit("- "), F.regexp_replace(x["relation"], "_", " "), F.lit(" [["), x["to"], F.lit("]]"),
        F.when(F.coalesce(x["description"], F.lit("")) != "", F.concat(F.lit(" — "), x["description"])).otherwise("")))
    summary = F.when(F.trim("summary") == "", F.lit("_(no summary)_")).otherwise(F.trim("summary"))
    related = F.when(F.size("links") > 0, F.concat(F.lit("## Related\n\n"), F.array_join(link, "\n"), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit(GENERATED_START + "\n## Summary\n\n"), summary, F.lit("\n"),
                    F.when(related != "", F.concat(F.lit("\n"), related)).otherwise(""), F.lit(GENERATED_END + "\n"))
    fields = ["name", "slug", "type", "sources", "sources_digest", "links"] + (["covers"] if "covers" in concepts.columns else [])
    old = existing.select("path", F.col("content").alias("old"))
    joined = concepts.withColumn("path", F.concat("slug", F.lit(".md"))).join(old, "path", "left")
    return joined.select("path", F.concat(
        F.lit("---\n"), _yaml(F.struct(*fields)), F.lit("---\n"), body,
        F.coalesce(human_tail(F.col("old")), F.lit(DEFAULT_TAIL))).alias("text"))


def covers(concepts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Symbols in the source files of each concept: (slug, covers)."""
    symbols = nodes.where(F.col("kind") != "file").select(
        "path", "start_line", "name", "kind", X.pointer(F.col("path"), F.col("start_line"), F.col("end_line")).alias("at"))
    files = concepts.select("slug", F.explode(F.array_distinct(F.transform("sources", lambda s: s["path"]))).alias("path"))
    ordered = F.array_sort(F.collect_list(F.struct("path", "start_line", "name", "kind", "at")))
    return files.join(symbols, "path").groupBy("slug").agg(ordered.alias("c")).select(
        "slug", F.transform("c", lambda x: F.struct(
            x["name"].alias("symbol"), x["kind"].alias("kind"), x["at"].alias("at"))).alias("covers"))


def write_notes(spark: SparkSession, folder: str, concepts: DataFrame) -> DataFrame:
    """Write all notes and delete those no concept stands behind; returns the written paths."""
    files = list_tree(spark, folder).where(
        ~F.col("is_dir") & F.col("path").rlike(r"^[^/]+\.md$") & (F.col("path") != INDEX))
    existing = read_contents(files, folder)
    written = write_texts(render_notes(concepts, existing), folder)
    delete_files(files.select("path").join(written, "path", "left_anti"), folder)
    return written


# --------------------------------------------------------------------------
# cards


def _one_liner() -> object:
    summary = F.trim(F.coalesce("summary", F.lit("")))
    return F.when(summary != "", X.first_line(summary)).otherwise(F.trim(F.coalesce("signature", F.lit(""))))


def card_path(path):
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(".md"))


def render_cards(nodes: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """One card per source file: (path, text, source, symbols).

    ``concepts`` (slug, sources) adds links up to the notes that cite a file.
    """
    tail = F.when(_one_liner() != "", F.concat(F.lit(" — "), _one_liner())).otherwise("")
    line = F.concat_ws(" · ", F.concat(F.lit("- "), F.col("name")), "kind", F.concat(X.span(F.col("start_line"), F.col("end_line")), tail))
    is_file = F.col("kind") == "file"
    rows = nodes.withColumns({"line": line, "liner": _one_liner()})
    cards = rows.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(~is_file, F.struct("start_line", "name", "ord", "line")))).alias("lines"),
        F.max(F.when(is_file, F.col("liner"))).alias("about"))
    if concepts is not None:
        cited = concepts.select("slug", F.explode(F.transform("sources", lambda s: s["path"])).alias("path")).groupBy("path").agg(
            F.array_join(F.transform(F.array_sort(F.collect_set("slug")), lambda s: F.concat(F.lit("[["), s, F.lit("]]"))), " ").alias("up"))
        cards = cards.join(cited, "path", "left")
    else:
        cards = cards.withColumn("up", F.lit(None).cast("string"))
    head = F.when(F.col("up").isNotNull(), F.concat(F.lit("# "), F.col("path"), F.lit(" · "), F.col("up"))).otherwise(
        F.concat(F.lit("# "), F.col("path")))
    about = F.when(F.coalesce("about", F.lit("")) != "", F.concat(F.lit("\n"), F.col("about"), F.lit("\n"))).otherwise("")
    listed = F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).otherwise(
        F.lit("_No extracted symbols in this file._"))
    return cards.select(
        card_path(F.col("path")).alias("path"), F.concat(head, F.lit("\n"), about, F.lit("\n"), listed, F.lit("\n")).alias("text"),
        F.col("path").alias("source"), F.size("lines").alias("symbols"))


def write_cards(spark: SparkSession, folder: str, nodes: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Write the cards below ``folder`` and delete cards of files that are gone."""
    cards = render_cards(nodes, concepts)
    written = write_texts(cards, folder)
    there = list_tree(spark, folder).where(~F.col("is_dir") & F.col("path").rlike(r"/.*\.md$") & ~F.col("path").rlike("^versions/"))
    delete_files(there.join(written, "path", "left_anti"), folder)
    return written


def render_index(concepts: DataFrame | None, cards: DataFrame, title: str = "Source map") -> DataFrame:
    """The index page (path, text): the concept roster and the number of cards."""
    counts = cards.agg(F.count("*").alias("files"), F.coalesce(F.sum((F.col("symbols") > 0).cast("long")), F.lit(0)).alias("with_symbols"))
    text = F.concat(F.lit(f"# {title}\n\n"), F.coalesce("roster", F.lit("")),
                    F.lit("## Files\n\n"), F.col("files").cast("string"), F.lit(" cards mirror the source tree, "),
                    F.col("with_symbols").cast("string"), F.lit(" of them with extracted symbols.\n"))
    if concepts is None:
        return counts.withColumn("roster", F.lit(None).cast("string")).select(F.lit(INDEX).alias("path"), text.alias("text"))
    paths = F.array_join(F.transform("sources", lambda s: s["path"]), ", ")
    line = F.concat(F.lit("- ["), F.col("slug"), F.lit("]("), F.col("slug"), F.lit(".md) — "), F.coalesce("name", "slug"),
                    F.when(F.size("sources") > 0, F.concat(F.lit(" · "), paths)).otherwise(""))
    roster = concepts.agg(F.array_sort(F.collect_list(F.struct("slug", line.alias("line")))).alias("r")).select(
        F.when(F.size("r") > 0, F.concat(
            F.lit("## Concepts\n\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n\n"))).alias("roster"))
    row = counts.withColumn("roster", F.lit(roster.first()["roster"]))  # the page itself, written as one file
    return row.select(F.lit(INDEX).alias("path"), text.alias("text"))


# --------------------------------------------------------------------------
# manifest


def write_manifest(folder: str, files: DataFrame, concepts: DataFrame, digest: str, model: str) -> None:
    """Recorded files and the note roster, as two tables and a small description."""
    from .store import Store

    files.select("path", "hash").orderBy("path").write.mode("overwrite").json(posixpath.join(folder, ".manifest", "files"))
    concepts.select("slug", "name", "type", F.transform("sources", lambda s: s["path"]).alias("sources"), "sources_digest").orderBy(
        "slug").write.mode("overwrite").json(posixpath.join(folder, ".manifest", "notes"))
    import json

    Store(files.sparkSession, folder).write_text(
        json.dumps({"version": VERSION, "model": model, "repo_digest": digest}, indent=2) + "\n", MANIFEST)


def read_manifest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """Recorded files (path, hash) and notes (slug, sources_digest); None without a manifest."""
    from .store import Store

    if Store(spark, folder).read_text(MANIFEST) is None:
        return None
    files = spark.read.schema("path string, hash string").json(posixpath.join(folder, ".manifest", "files"))
    notes = spark.read.schema("slug string, name string, type string, sources array<string>, sources_digest string").json(
        posixpath.join(folder, ".manifest", "notes"))
    return files, notes


