"""The public interface: build a graph from a source tree and ask it questions."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import ask as A
from .operators import concepts as C
from .operators import drift as D
from .operators import enrich as E
from .operators import extract as EX
from .operators import grep as G
from .operators import lexical as L
from .operators import links as LN
from .operators import repomap as M
from .operators import resolve as R
from .operators import savings as SV
from .operators import scopes as SC
from .operators import walk as W
from .schemas import EDGES, NODES, RAW_EDGES, conform
from .session import materialize
from .sources import files as FS
from .sources import notes as N
from .sources.store import Store, extractor_stamp

# Shown source lines and hits.
MAX_SOURCE_LINES = 80
DEFAULT_LIMIT = 8


@dataclass
class BuildStats:
    files: int
    parsed: int
    replayed: int
    nodes: int
    edges: int
    errors: int


@dataclass
class Answer:
    mode: str                # structural, lexical or empty
    hits: DataFrame
    note: str | None = None
    subject: str | None = None
    ranking: A.Ranking | None = None


class Engine:
    """One source tree (``root``) and its stored graph (``out``)."""

    def __init__(self, spark: SparkSession, root: str, out: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.out = out or posixpath.join(self.root, ".codeloom")
        self.store = Store(spark, self.out)

    # -- build -------------------------------------------------------------

    def _skip(self) -> str | None:
        inside = self.out.startswith(self.root + "/")
        return self.out[len(self.root) + 1:] if inside else None

    def build(self, summarizer: E.Summarizer | None = None) -> BuildStats:
        """Bring the stored graph up to date.

        Every file is read and hashed; rows of unchanged files are taken from
        the last build, the others are extracted again.
        """
        listing = materialize(FS.list_tree(self.spark, self.root))
        files = FS.list_files(self.spark, self.root, self._skip())
        # contents are hashed here and read again for changed files only
        prints = materialize(FS.read_contents(FS.source_files(files), self.root).drop("content"))
        modules = FS.go_modules(FS.read_contents(files.where(X.basename(F.col("path")) == "go.mod"), self.root))
        found = SC.discover(*FS.project_tree(self.spark, self.root, listing))
        scopes = [r["prefix"] for r in found.orderBy(F.length("prefix").desc(), "prefix").collect()]  # one per project
        return self._store_build(prints, materialize(modules), scopes, summarizer)

    def apply(self, changes: DataFrame) -> BuildStats:
        """Take over named changes (path) without listing or reading the rest.

        Files that are gone drop out; scopes and Go modules stay as built.
        """
        prints = self._need("prints")
        touched = materialize(changes.select("path").distinct().where(X.language_of(F.col("path")).isNotNull()))
        unknown = F.lit(None)
        named = touched.select("path", unknown.cast("bigint").alias("size"), unknown.cast("timestamp").alias("mtime"))
        read = FS.read_contents(named, self.root).where(F.col("content").isNotNull()).withColumn(
            "size", F.octet_length("content").cast("bigint")).drop("content")
        kept = prints.join(touched, "path", "left_anti").withColumn("error", unknown.cast("string"))
        return self._store_build(materialize(kept.unionByName(read)), self._need("modules"), self.scopes())

    def _store_build(
        self, prints: DataFrame, modules: DataFrame, scopes: list[str],
        summarizer: E.Summarizer | None = None,
    ) -> BuildStats:
        """Extract what changed, replay the rest, resolve, enrich and store a new version.

        ``prints`` names every file with its hash.  Contents are read for files
        whose hash the last build does not know.
        """
        good = prints.where(F.col("hash") != "")
        stamp = extractor_stamp()
        meta = self.store.meta() or {}
        seen = self.store.table("prints") if meta.get("stamp") == stamp else None
        if seen is not None:
            same = materialize(good.select("path", "hash").join(seen.select("path", "hash"), ["path", "hash"], "left_semi"))
        else:
            same = good.select("path", "hash").limit(0)
        todo = materialize(good.join(same.select("path"), "path", "left_anti").select("path", "size", "mtime"))
        changed = FS.read_contents(todo, self.root).where(F.col("content").isNotNull()).persist(StorageLevel.DISK_ONLY)
        fresh = EX.extract(changed.select("path", "content"))
        nodes, raw = conform(fresh.nodes, NODES), conform(fresh.raw_edges, RAW_EDGES)
        if seen is not None:
            nodes = nodes.unionByName(self.store.table("memo_nodes").join(same.select("path"), "path", "left_semi").select(*nodes.columns))
            raw = raw.unionByName(self.store.table("memo_raw").join(
                same.select(F.col("path").alias("file")), "file", "left_semi").select(*raw.columns))
        nodes, raw = materialize(nodes), materialize(raw)
        fresh.release()
        changed.unpersist()
        edges = materialize(R.resolve_edges(nodes, raw, modules))

        prior = self.store.table("nodes")
        layer = conform(prior, NODES) if prior is not None else nodes.limit(0)
        # only files with open nodes are read for a summarizer, and none without one
        enriched, problems = E.enrich(nodes, layer, lambda paths: self._read(good, paths), summarizer)
        enriched = materialize(enriched)
        scopes = SC.substantial(enriched, scopes)

        version = self.store.new_version()
        self.store.write_graph(version, enriched, conform(edges, EDGES))
        index = self.store.write_index(version, enriched, meta.get("stamp") == stamp)
        self.store.write(version, "memo_nodes", nodes)
        self.store.write(version, "memo_raw", raw)
        self.store.write(version, "modules", modules)
        self.store.write(version, "prints", prints.select("path", "size", "mtime", "hash"))
        bad = prints.where(F.col("error").isNotNull()).select("path", "error")
        if problems is not None:
            bad = bad.unionByName(problems)
        self.store.write(version, "errors", bad)
        stats = BuildStats(prints.count(), todo.count(), same.count(), enriched.count(), edges.count(), bad.count())
        self.store.commit(version, {"stamp": stamp, "scopes": scopes, "files": stats.files, "index": index})
        return stats

    def write_cards(self) -> int:
        """Markdown cards that mirror the tree, and the index page."""
        notes = N.read_notes(self.spark, self.out)
        cards = materialize(N.render_cards(self.nodes(), notes))
        N.write_cards(self.spark, self.out, self.nodes(), notes)
        FS.write_texts(N.render_index(notes, cards), self.out)
        return cards.count()

    def ensure_fresh(self) -> bool:
        """Rebuild when files drifted.  A failing rebuild leaves the old graph in use."""
        drift = self.drift()
        if drift is not None and drift.isEmpty():
            return True
        if not self.store.lock():
            return False
        try:
            drift = self.drift()
            if drift is None or not drift.isEmpty():
                self.build()
            return True
        except Exception:
            return False
        finally:
            self.store.unlock()

    # -- stored tables -----------------------------------------------------

    def _need(self, name: str) -> DataFrame:
        df = self.store.table(name)
        if df is None:
            raise LookupError("nothing is built here yet")
        return df

    def nodes(self) -> DataFrame:
        return self._need("nodes")

    def edges(self) -> DataFrame:
        return self._need("edges")

    def scopes(self) -> list[str]:
        return (self.store.meta() or {}).get("scopes") or [""]

    def _links(self, way: str) -> LN.Links:
        """The stored links of the graph, for walks inside its scopes where it has several."""
        grouped = len(self.scopes()) > 1
        nodes = SC.with_scope(self.nodes(), self.scopes()) if grouped else self.nodes()
        return self.store.links(way, nodes, ["scope"] if grouped else [])

    def token_index(self) -> L.TokenIndex | None:
        """The stored token index of the graph."""
        return self.store.token_index()

    def _with_bodies(self, nodes: DataFrame) -> DataFrame:
        bodies = self._need("memo_nodes").select("id", "ord", "path", "body_text")
        return nodes.join(bodies, ["id", "ord", "path"], "left")

    def contents(self, paths: DataFrame | None = None) -> DataFrame:
        """Present contents of the indexed files, or of some of them."""
        return self._read(self._need("prints"), paths)

    def _read(self, prints: DataFrame, paths: DataFrame | None = None) -> DataFrame:
        if paths is not None:
            prints = prints.join(paths.select("path").distinct(), "path", "left_semi")
        return FS.read_contents(prints, self.root).where(F.col("content").isNotNull())

    # -- questions ---------------------------------------------------------

    def ask(
        self, query: str, limit: int = DEFAULT_LIMIT, within: str | None = None, graph_rank: bool = True,
        source: bool = False, full: bool = False,
    ) -> Answer:
        """Answer by edges when the question asks for them, else by rank."""
        nodes, edges = self.nodes(), self.edges()
        prefix = within.rstrip("/") if within else None
        if prefix and nodes.where(X.under_prefix(F.col("path"), prefix)).isEmpty():
            raise ValueError(f"no indexed path begins with {prefix}/")
        found = W.structural(nodes, edges, query, limit, prefix)
        if found is not None and found.answered:
            answer = Answer("structural", found.hits, found.note, found.subject)
        else:
            concepts = N.concept_docs(N.read_notes(self.spark, self.out))
            index = self.token_index()
            docs = nodes if index is not None else self._with_bodies(nodes)
            hits, ranking = A.ask(
                docs, edges if graph_rank else None, query, limit, self.scopes(), prefix, concepts, index=index,
                links=self._links("walk") if graph_rank and not prefix else None)
            hits = materialize(hits)
            note = found.note if found is not None else None
            answer = Answer("empty" if hits.isEmpty() else "lexical", hits, note, ranking=ranking)
        if source:
            answer.hits = self.inline_source(answer.hits, full)
        return answer

    def inline_source(self, hits: DataFrame, full: bool = False) -> DataFrame:
        """Add the code behind each pointer, in the order of the hits: its crux, or up to eighty lines."""
        parts = {
            "h_path": F.regexp_extract("pointer", r"^(.*):L\d+-L\d+$", 1),
            "h_from": F.expr(r"try_cast(regexp_extract(pointer, ':L(\\d+)-L\\d+$', 1) AS int)"),
            "h_to": F.expr(r"try_cast(regexp_extract(pointer, ':L\\d+-L(\\d+)$', 1) AS int)"),
        }
        placed = materialize(hits.withColumns({**parts, "_place": F.monotonically_increasing_id()}))  # one page, in its order
        text = self.contents(placed.select(F.col("h_path").alias("path"))).select(
            F.col("path").alias("h_path"), F.split("content", "\n").alias("lines"))
        crux = self.nodes().where(F.col("crux").isNotNull()).select(
            X.pointer(F.col("path"), F.col("start_line"), F.col("end_line")).alias("pointer"), F.col("crux.code").alias("crux"))
        joined = placed.join(text, "h_path", "left").join(crux.dropDuplicates(["pointer"]), "pointer", "left")
        last = F.least("h_to", F.size("lines"))
        size = last - F.col("h_from") + 1
        head = F.array_join(F.slice("lines", F.greatest("h_from", F.lit(1)), F.greatest(F.least(size, F.lit(MAX_SOURCE_LINES)), F.lit(0))), "\n")
        more = F.when(size > MAX_SOURCE_LINES, F.concat(
            F.lit("\n… (+"), (size - MAX_SOURCE_LINES).cast("string"), F.lit(" more lines)"))).otherwise("")
        code = F.when(F.col("lines").isNotNull() & F.col("h_from").isNotNull(), F.concat(head, more))
        short = F.when(F.col("crux").isNotNull() & F.lit(not full), F.concat("crux", F.lit("\n… (crux; ask for the full definition)")))
        return joined.withColumn("code", F.coalesce(short, code)).orderBy("_place").drop(*parts, "lines", "crux", "_place")

    def callers(self, symbol: str, direction: str = "in", depth: int | None = 1, within: str | None = None) -> DataFrame:
        matches = materialize(W.resolve_symbol(self.nodes(), symbol, within))
        deep = depth is None or depth > 1
        links = self._links("into" if direction == "in" else "out") if deep else None
        return W.edge_walk(self.nodes(), self.edges(), matches, direction, depth, links)

    def grep(self, pattern: str, within: str | None = None, ignore_case: bool = False, fixed: bool = False) -> G.GrepResult:
        paths = self.nodes().where(F.col("kind") == "file").select("path")
        if within:
            paths = paths.where(F.contains(F.col("path"), F.lit(within)))
        found = G.grep(self.nodes(), self.edges(), self.contents(paths), pattern, fixed, ignore_case)
        found.groups = G.rank_groups(found.groups)
        return found

    def repo_map(self, max_dirs: int = M.MAX_DIRS) -> M.RepoMap:
        return M.repo_map(self.nodes(), self.edges(), self.scopes(), max_dirs)

    def skeleton(self, file: str) -> DataFrame:
        return W.skeleton(self.nodes(), file)

    def savings(self, hits: DataFrame) -> DataFrame:
        return SV.savings_for(self.nodes(), SV.pointer_paths(hits))

    # -- freshness ---------------------------------------------------------

    def drift(self, always_hash: bool = False) -> DataFrame | None:
        """Files that differ from the last build; None before the first."""
        prints = self.store.table("prints")
        if prints is None:
            return None
        now = FS.source_files(FS.list_files(self.spark, self.root, self._skip()))
        if not always_hash:
            # only files whose size or time moved are read at all
            same = now.join(prints.where(F.col("hash") != "").select("path", "size", "mtime"), ["path", "size", "mtime"], "left_semi")
            calm = same.join(prints.select("path", "hash"), "path").withColumn("content", F.lit(None).cast("string"))
            read = FS.read_contents(now.join(same, "path", "left_anti"), self.root)
            now = read.select("path", "size", "mtime", "content").unionByName(calm.select("path", "size", "mtime", "content"))
        else:
            now = FS.read_contents(now, self.root)
        return materialize(D.probe(prints, now, always_hash))

    def check(self) -> dict[str, DataFrame | None]:
        """Drift of the graph and of the concept notes; a missing layer is None."""
        contents = FS.read_contents(FS.source_files(FS.list_files(self.spark, self.root, self._skip())), self.root)
        stored = self.store.table("nodes")
        graph = None
        if stored is not None:
            current = EX.extract(contents.where(F.col("content").isNotNull()).select("path", "content"))
            graph = materialize(D.check_graph(stored, current.nodes))
            current.release()
        manifest = N.read_manifest(self.spark, self.out)
        files = roster = None
        if manifest is not None:
            code = FS.code_files(FS.list_files(self.spark, self.root, self._skip()))
            files = D.check_manifest(manifest[0], FS.read_contents(code, self.root))
            roster = D.check_roster(manifest[1], N.read_notes(self.spark, self.out))
        return {"graph": graph, "files": files, "roster": roster}

    def ok(self) -> bool:
        """Present layers must be clean; with none present there is nothing to trust."""
        found = [df for df in self.check().values() if df is not None]
        return bool(found) and all(df.isEmpty() for df in found)

    # -- concept notes -----------------------------------------------------

    def build_concepts(self, summarizer, synthesizer, model: str = "custom") -> DataFrame:
        """Summarize files, draft concepts per batch, merge, link and write the notes.

        ``summarizer(path, text)`` returns a summary.  ``synthesizer(entries)``
        takes a batch of (path, summary) and returns dicts with name, type,
        summary, sources and links.
        """
        code = FS.code_files(FS.list_files(self.spark, self.root, self._skip()))
        contents = FS.read_contents(code, self.root).where(F.col("content").isNotNull())
        prints = materialize(contents.select("path", "hash"))
        cache = self.spark.createDataFrame([], "path string, hash string, summary string")
        cached = posixpath.join(self.out, ".summaries")
        if self.store._exists(".summaries"):
            cache = materialize(self.spark.read.parquet(cached))
        said = materialize(C.summarize_files(contents, cache, summarizer))
        done = said.where(F.coalesce("summary", F.lit("")) != "").select("path", "hash", "summary")
        done.write.mode("overwrite").parquet(cached)
        entries = done.withColumn("size", (F.length("path") + F.length("summary") + C.ENTRY_OVERHEAD).cast("long"))
        batches = C.batch_by_size(entries)
        drafts = materialize(C.synthesize(batches, synthesizer))
        concepts = materialize(C.build_concepts(drafts, prints))
        if self.store.table("nodes") is not None:
            concepts = materialize(concepts.join(N.covers(concepts, self.nodes()), "slug", "left"))
        N.write_notes(self.spark, self.out, concepts)
        digest = C.tree_digest(prints).first()["digest"]
        N.write_manifest(self.out, prints, concepts, digest, model)
        return concepts

