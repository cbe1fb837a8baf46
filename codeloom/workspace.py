"""A folder of repositories: each has its own graph, and questions go to all of them.

A graph is built as if its repository stood alone.  The workspace keeps a list
of its repositories and nothing else; the tables of a question are the stored
tables of the repositories side by side, with ``repo`` and qualified ids.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import DEFAULT_LIMIT, Engine
from .operators import extract as EX
from .operators import federation as FED
from .operators.fuse import Fusion
from .operators.workspace import coverage_note
from .session import materialize
from .sources import files as FS
from .sources.store import Store

INDEX = "workspace.json"


@dataclass
class Refresh:
    rebuilt: list[str]   # repositories whose files had moved
    failed: list[str]    # repositories that still answer from their last graph


class Workspace:
    """The repositories directly below ``root``; ``out`` holds their list."""

    def __init__(self, spark: SparkSession, root: str, out: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, out or posixpath.join(self.root, ".codeloom"))
        self._engines: dict[str, Engine] = {}

    def engine(self, repo: str) -> Engine:
        """The graph of one repository, always kept inside it."""
        if repo not in self._engines:
            self._engines[repo] = Engine(self.spark, posixpath.join(self.root, repo))
        return self._engines[repo]

    def listed(self) -> list[str] | None:
        """The repositories of the stored list; None before the first split or with a damaged list."""
        try:
            known = json.loads(self.store.read_text(INDEX) or "null")
            return sorted(map(str, known["repositories"])) if known else None
        except (ValueError, KeyError, TypeError):
            return None

    def repositories(self) -> list[str]:
        """The listed repositories, or those that are found where none are listed."""
        known = self.listed()
        return FS.repositories_below(self.root) if known is None else known

    def is_workspace(self) -> bool:
        return self.listed() is not None or len(FS.repositories_below(self.root)) >= 2

    def split(self, told: Callable[[list[str], bool], None] | None = None) -> list[str]:
        """Build every repository and list them.

        ``told`` hears the repositories, and whether one graph over the whole
        folder is given up for them, before the first is built.  Files of that
        graph are left where they are.
        """
        found = FS.repositories_below(self.root)
        mixed = self.listed() is None and self.store.current() is not None
        if told is not None:
            told(found, mixed)
        for repo in found:
            self.engine(repo).build()
        self.store.write_text(json.dumps({"repositories": found}), INDEX)
        return found

    def built(self) -> list[str]:
        return [r for r in self.repositories() if self.engine(r).store.current() is not None]

    def missing(self) -> list[str]:
        built = set(self.built())
        return [r for r in self.repositories() if r not in built]

    def note(self) -> str:
        """What is not covered; empty when every repository is built."""
        return coverage_note(len(self.repositories()), self.missing())

    def refresh(self) -> Refresh:
        """Rebuild the built repositories whose files drifted; the others are left alone."""
        done = Refresh([], [])
        for repo in self.built():
            engine = self.engine(repo)
            before = engine.store.current()
            if not engine.ensure_fresh():
                done.failed.append(repo)
            elif engine.store.current() != before:
                done.rebuilt.append(repo)
        return done

    # -- tables of all repositories ------------------------------------------

    def _all(self, of: Callable[[Engine], DataFrame], *columns: str) -> DataFrame:
        built = self.built()
        if not built:
            raise LookupError("no repository is built here yet")
        each = [FED.qualify(of(self.engine(r)).withColumn("repo", F.lit(r)), *columns) for r in built]
        return reduce(DataFrame.unionByName, each)

    def nodes(self, bodies: bool = False) -> DataFrame:
        return self._all(lambda e: e._with_bodies(e.nodes()) if bodies else e.nodes(), "id", "path")

    def edges(self) -> DataFrame:
        """Links of all repositories; names outside a repository are qualified too."""
        return self._all(lambda e: e.edges(), "source", "target")

    def files(self) -> DataFrame:
        return self._all(lambda e: e.contents(), "path").select("repo", "path", "content")

    # -- questions -------------------------------------------------------------

    def ask(self, query: str, limit: int = DEFAULT_LIMIT, only: str | None = None, graph_rank: bool = True) -> Fusion:
        if only is not None and only not in self.built():
            raise ValueError(f"no built repository {only}; there are {', '.join(self.built())}")
        return FED.federate_ask(self.nodes(bodies=True), self.edges() if graph_rank else None, query, limit, only)

    def grep(self, pattern: str, max_hits: int | None = None, **flags) -> tuple[DataFrame, DataFrame]:
        return FED.federate_grep(self.nodes(), self.edges(), self.files(), pattern, max_hits, **flags)

    def repo_map(self, max_dirs: int | None = None) -> tuple[DataFrame, DataFrame]:
        return FED.federate_map(self.nodes(), self.edges(), max_dirs)

    def callers(self, symbol: str, direction: str = "in", depth: int | None = 1, within: str | None = None) -> DataFrame:
        return FED.federate_callers(self.nodes(), self.edges(), symbol, direction, depth, within)

    def check(self) -> DataFrame:
        """Drift counts of every listed repository; one that is not built is listed and does not fail."""
        def present(e: Engine) -> DataFrame:
            files = FS.source_files(FS.list_files(self.spark, e.root, e._skip()))
            return FS.read_contents(files, e.root).where(F.col("content").isNotNull()).select("path", "content")

        known = self.spark.createDataFrame([(r,) for r in self.repositories()], "repo string")
        found = EX.extract(self._all(present, "path").drop("repo"))
        current = found.nodes.withColumn("repo", F.substring_index("path", "/", 1))
        counts = materialize(FED.federate_check(self.nodes(), current, known))
        found.release()
        return counts
