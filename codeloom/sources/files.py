"""Source trees: listing, reading and writing many small files.

Spark's own file sources skip names that begin with an underscore, which
would lose ``__init__.py``.  Directories are therefore listed by tasks, one
level of the tree per round, and file contents are read by tasks as well; the
driver never holds the listing.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.scopes import MARKERS
from ..session import materialize

# Directories never entered.
SKIP_DIRS = [
    "node_modules", "dist", "build", "out", "target", "vendor", "coverage", "__pycache__", "venv",
]

# Extensions that concept notes are built from.
CODE_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".kt", ".scala",
    ".rb", ".php", ".c", ".h", ".cpp", ".hpp", ".cc", ".cs", ".swift", ".sql", ".sh", ".proto",
]

# Bytes of content handed to Spark at a time.
BATCH_BYTES = 16 << 20

ENTRY = "path string, is_dir boolean, size bigint, mtime timestamp"


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and base path of a folder or URI."""
    uri = root if re.match(r"^[a-z0-9]+:", root) else "file://" + posixpath.abspath(root)
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri)


def _list(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    system, base = open_root(root)
    for batch in batches:
        rows = []
        for d in batch["path"]:
            at = posixpath.join(base, d) if d else base
            for e in system.get_file_info(pafs.FileSelector(at, recursive=False, allow_not_found=True)):
                name = posixpath.basename(e.path)
                if e.type == pafs.FileType.Directory:
                    # .git itself is reported, as it marks a repository, but never entered
                    if (not name.startswith(".") or name == ".git") and name not in SKIP_DIRS:
                        rows.append((posixpath.join(d, name), True, 0, None))
                elif e.type == pafs.FileType.File and not name.startswith("."):
                    rows.append((posixpath.join(d, name), False, e.size, e.mtime))
        yield pd.DataFrame(rows, columns=["path", "is_dir", "size", "mtime"])


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every directory and file below ``root``: (path, is_dir, size, mtime)."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([("",)], "path string")
    found = []
    while True:
        entries = materialize(level.mapInPandas(lambda it: _list(it, root), ENTRY))
        found.append(entries)
        level = entries.where(F.col("is_dir") & (X.basename(F.col("path")) != ".git")).select("path")
        if level.isEmpty():
            break
        level = level.repartition(parts, "path")
    return reduce(DataFrame.unionAll, found)


def list_files(spark: SparkSession, root: str, skip: str | None = None) -> DataFrame:
    """All files: (path, size, mtime).  ``skip`` is the output folder."""
    files = list_tree(spark, root).where(~F.col("is_dir"))
    if skip:
        files = files.where(~X.under_prefix(F.col("path"), skip))
    return files.select("path", "size", "mtime")


def source_files(files: DataFrame) -> DataFrame:
    return files.where(X.language_of(F.col("path")).isNotNull())


def code_files(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    ends = "|".join(re.escape(e) for e in extensions or CODE_EXTENSIONS)
    return files.where(F.lower("path").rlike(f"({ends})$"))


def _read(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    system, base = open_root(root)
    for batch in batches:
        rows, held = [], 0
        for path, size, mtime in zip(batch["path"], batch["size"], batch["mtime"]):
            text, error = None, None
            try:
                with system.open_input_file(posixpath.join(base, path)) as f:
                    text = f.read().decode("utf-8", errors="replace")
            except OSError as e:  # recorded, never fatal
                error = str(e)
            rows.append((path, size, mtime, text, error))
            held += len(text or "")
            if held > BATCH_BYTES:
                yield pd.DataFrame(rows, columns=["path", "size", "mtime", "content", "error"])
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=["path", "size", "mtime", "content", "error"])


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """Contents of listed files: (path, size, mtime, content, error, hash)."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = files.select("path", "size", "mtime").repartition(parts, "path").mapInPandas(
        lambda it: _read(it, root), "path string, size bigint, mtime timestamp, content string, error string")
    return read.withColumn("hash", F.coalesce(X.content_hash(F.col("content")), F.lit("")))


def _write(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    system, base = open_root(root)
    for batch in batches:
        for path, text in zip(batch["path"], batch["text"]):
            at = posixpath.join(base, path)
            system.create_dir(posixpath.dirname(at), recursive=True)
            # written aside and moved, so a repeated task leaves whole files only
            with system.open_output_stream(at + ".tmp") as f:
                f.write(text.encode("utf-8"))
            system.move(at + ".tmp", at)
        yield pd.DataFrame({"path": batch["path"]})


def write_texts(texts: DataFrame, root: str) -> DataFrame:
    """Write (path, text) rows as files below ``root``; returns the written paths."""
    return materialize(texts.select("path", "text").mapInPandas(lambda it: _write(it, root), "path string"))


def _delete(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    system, base = open_root(root)
    for batch in batches:
        for path in batch["path"]:
            at = posixpath.join(base, path)
            if system.get_file_info(at).type == pafs.FileType.File:
                system.delete_file(at)
        yield pd.DataFrame({"path": batch["path"]})


def delete_files(paths: DataFrame, root: str) -> DataFrame:
    """Delete listed files below ``root``; returns the paths."""
    return materialize(paths.select("path").mapInPandas(lambda it: _delete(it, root), "path string"))


# --------------------------------------------------------------------------
# project layout


def go_modules(contents: DataFrame) -> DataFrame:
    """Modules declared by ``go.mod`` files: (module, dir)."""
    name = F.regexp_extract("content", r"(?m)^\s*module\s+(\S+)", 1)
    mods = contents.where((X.basename(F.col("path")) == "go.mod") & F.col("content").isNotNull())
    return mods.select(name.alias("module"), X.dirname(F.col("path")).alias("dir")).where(F.col("module") != "")


def workspace_globs(pnpm: str | None, package: str | None) -> list[str] | None:
    """Workspace entries of the two root files, pnpm first; None without any."""
    import json

    if pnpm:
        block = re.search(r"(?m)^[ \t]*packages[ \t]*:.*\n((?:[ \t]*(?:-.*)?\r?(?:\n|$))*)", pnpm)
        entries = re.findall(r"(?m)^[ \t]*-[ \t]*(.*?)[ \t\r]*$", block.group(1)) if block else []
        entries = [re.sub(r"^['\"]|['\"]$", "", e) for e in entries]
        if any(entries):
            return [e for e in entries if e]
    if package:
        try:
            ws = json.loads(package).get("workspaces")
        except ValueError:
            return None
        ws = ws.get("packages") if isinstance(ws, dict) else ws
        if isinstance(ws, list):
            return ws
    return None


def project_tree(spark: SparkSession, root: str, listing: DataFrame) -> tuple[DataFrame, DataFrame, list[str] | None]:
    """What scopes are found from: directories (dir), project files (dir, marker), workspace entries of the root."""
    name = X.basename(F.col("path"))
    marks = listing.where(~F.col("is_dir") & name.isin(*MARKERS)).select(
        F.when(F.instr("path", "/") > 0, X.dirname(F.col("path"))).otherwise("").alias("dir"), name.alias("marker"))
    dirs = listing.where(F.col("is_dir") & (name != ".git")).select(F.col("path").alias("dir"))
    system, base = open_root(root)

    def text_of(file: str) -> str | None:
        at = posixpath.join(base, file)
        if system.get_file_info(at).type != pafs.FileType.File:
            return None
        with system.open_input_file(at) as f:
            return f.read().decode("utf-8", errors="replace")

    return dirs, marks, workspace_globs(text_of("pnpm-workspace.yaml"), text_of("package.json"))


def child_repositories(listing: DataFrame) -> list[str]:
    """Immediate subfolders that are repositories; empty when the root is one itself."""
    gits = [r[0] for r in listing.where(F.col("is_dir") & F.col("path").rlike(r"^([^/]+/)?\.git$")).select("path").collect()]
    if ".git" in gits:
        return []
    children = sorted(g.split("/")[0] for g in gits)
    return children if len(children) >= 2 else []


def repositories_below(root: str) -> list[str]:
    """Folders directly below ``root`` that are repositories; empty when the root is one itself."""
    system, base = open_root(root)

    def has_git(at: str) -> bool:
        return system.get_file_info(posixpath.join(at, ".git")).type != pafs.FileType.NotFound

    if has_git(base):
        return []
    folders = [e.path for e in system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
               if e.type == pafs.FileType.Directory]
    names = sorted(posixpath.basename(f) for f in folders if has_git(f))
    return [n for n in names if not n.startswith(".") and n not in SKIP_DIRS]
