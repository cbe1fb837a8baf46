"""The stored graph: versioned Parquet tables behind one pointer file.

Every build writes a new version folder and then moves the pointer, so a
reader sees one whole version and a lost executor leaves nothing half done.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import posixpath
import time
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical as L
from ..operators import links as LN
from ..schemas import last_by_id
from .files import open_root
from .token_index import TokenStore

POINTER = "CURRENT"
KEPT_VERSIONS = 2


class Store:
    """Tables of one graph below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.fs, self.base = open_root(root)
        self._loaded: tuple[str, dict[str, DataFrame]] | None = None

    # -- versions ----------------------------------------------------------

    def _at(self, *parts: str) -> str:
        return posixpath.join(self.base, *parts)

    def _exists(self, *parts: str) -> bool:
        return self.fs.get_file_info(self._at(*parts)).type != pafs.FileType.NotFound

    def read_text(self, *parts: str) -> str | None:
        if not self._exists(*parts):
            return None
        with self.fs.open_input_file(self._at(*parts)) as f:
            return f.read().decode("utf-8")

    def write_text(self, text: str, *parts: str) -> None:
        """Write a small file and move it into place."""
        at = self._at(*parts)
        self.fs.create_dir(posixpath.dirname(at), recursive=True)
        aside = f"{at}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(aside) as f:
            f.write(text.encode("utf-8"))
        self.fs.move(aside, at)

    def current(self) -> str | None:
        """Name of the current version, if its tables are all there."""
        name = (self.read_text(POINTER) or "").strip()
        return name if name and self._exists("versions", name, "meta.json") else None

    def new_version(self) -> str:
        return f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"

    def uri(self, *parts: str) -> str:
        return posixpath.join(self.root, *parts)

    def write(self, version: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.uri("versions", version, name))

    def table(self, name: str, version: str | None = None) -> DataFrame | None:
        """A table of the current version; handles are kept until the version changes."""
        version = version or self.current()
        if version is None or not self._exists("versions", version, name):
            return None
        if self._loaded is None or self._loaded[0] != version:
            self._loaded = (version, {})
        tables = self._loaded[1]
        if name not in tables:
            tables[name] = self.spark.read.parquet(self.uri("versions", version, name))
        return tables[name]

    def commit(self, version: str, meta: dict) -> None:
        """Make ``version`` current and drop all but the newest versions."""
        self.write_text(json.dumps(meta, sort_keys=True), "versions", version, "meta.json")
        self.write_text(version, POINTER)
        self._loaded = None
        folder = self.fs.get_file_info(pafs.FileSelector(self._at("versions")))
        names = sorted(posixpath.basename(e.path) for e in folder if e.type == pafs.FileType.Directory)
        for old in [n for n in names if n != version][: max(0, len(names) - KEPT_VERSIONS)]:
            self.fs.delete_dir(self._at("versions", old))
        self._drop_generations([n for n in names if self._exists("versions", n, "meta.json")])

    def _drop_generations(self, versions: list[str]) -> None:
        """Drop what no kept version counts among the generations of its index."""
        if not self._exists("index"):
            return
        used = {g for v in versions for g, _ in json.loads(self.read_text("versions", v, "meta.json")).get("index") or []}
        for e in self.fs.get_file_info(pafs.FileSelector(self._at("index"))):
            if e.type == pafs.FileType.Directory and posixpath.basename(e.path) not in used:
                self.fs.delete_dir(e.path)

    def meta(self) -> dict | None:
        version = self.current()
        return json.loads(self.read_text("versions", version, "meta.json")) if version else None

    # -- graph and token index --------------------------------------------

    def write_graph(self, version: str, nodes: DataFrame, edges: DataFrame) -> None:
        """Nodes without body text, sorted by id; edges sorted by source.

        Sorted ranges give every file tight id statistics for later lookups.
        """
        self.write(version, "nodes", _sorted(nodes.drop("body_text"), "id", "ord"))
        self.write(version, "edges", _sorted(edges, "source", "relation", "target"))

    def write_index(self, version: str, nodes: DataFrame, same_rules: bool = True) -> list[list]:
        """Bring the token index up to date; returns its generations, which ``commit`` has to be told.

        Only documents that differ are written.  Rows made by other rules are not kept.
        """
        docs = last_by_id(nodes.select("id", "name", "path", "signature", "summary", "body_text", "ord"))
        known = ((self.meta() or {}).get("index") or []) if same_rules else []
        store = TokenStore(self.spark, self.uri("index"), [tuple(g) for g in known]).update(version, docs)
        return [list(g) for g in store.live]

    def index_is_valid(self) -> bool:
        """The token index belongs to the graph: both are made current by one pointer."""
        return bool((self.meta() or {}).get("index"))

    def token_index(self) -> L.TokenIndex | None:
        known = (self.meta() or {}).get("index")
        return TokenStore(self.spark, self.uri("index"), [tuple(g) for g in known]).index() if known else None

    def links(self, way: str, grouped: DataFrame, by: list[str]) -> LN.Links:
        """Link tables of the current version with ``way`` among them.

        A table is made when a question first needs it, kept with the version
        and only read after that.  ``grouped`` are the nodes with the columns ``by``.
        """
        version = self.current()
        at, edges = self.uri("versions", version, "links"), self.table("edges", version)
        told = json.loads(self.read_text("versions", version, "links", "made.json") or "{}")
        if not told:
            LN.number(grouped, edges, at, by)
            told = {"by": by}
        if way not in told:
            LN.add(LN.read(self.spark, at, {}, told["by"]), way, edges, at)
            told[way] = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.write_text(json.dumps(told), "versions", version, "links", "made.json")
        return LN.read(self.spark, at, {w: told[w] for w in LN.WAYS if w in told}, told["by"])

    def export_json(self, folder: str) -> None:
        """The graph as sorted JSON lines: nodes by id, edges by source, relation, target."""
        self.table("nodes").orderBy("id", "ord").write.mode("overwrite").json(posixpath.join(folder, "nodes"))
        self.table("edges").drop("ord").orderBy("source", "relation", "target").write.mode("overwrite").json(
            posixpath.join(folder, "edges"))

    # -- lock --------------------------------------------------------------

    STALE_AFTER, WAIT, POLL = 300.0, 2.0, 0.05

    def lock(self) -> bool:
        """Take the build lock; a lock older than five minutes is taken over."""
        deadline = time.time() + self.WAIT
        mine = f"{time.time()}"
        while True:
            held = self.read_text("LOCK")
            if held is None or time.time() - float(held or 0) > self.STALE_AFTER:
                self.write_text(mine, "LOCK")
                return self.read_text("LOCK") == mine
            if time.time() > deadline:
                return False
            time.sleep(self.POLL)

    def unlock(self) -> None:
        if self._exists("LOCK"):
            self.fs.delete_file(self._at("LOCK"))


def _sorted(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def extractor_stamp() -> str:
    """Identity of the extraction rules; stored rows of other rules are not reused."""
    from .. import schemas
    from ..functions import text
    from ..operators import extract, grep, wiring

    sources = "".join(inspect.getsource(m) for m in (schemas, text, extract, grep, wiring))
    return hashlib.sha256(sources.encode()).hexdigest()[:16]
