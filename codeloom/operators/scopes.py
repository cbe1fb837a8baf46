"""Sub-project scopes of a source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a scope with fewer symbols folds into the root.
MIN_SCOPE_NODES = 5

# Files that mark a project directory.
MARKERS = ["package.json", "go.mod", "pyproject.toml", "setup.py", "Cargo.toml"]

# Scopes up to this number are matched inside an expression; more are joined.
LITERAL_SCOPES = 500


def prefixes(path: Column) -> Column:
    """All segment prefixes of a path, shortest first: a, a/b, a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def with_scope(df: DataFrame, scopes: list[str] | DataFrame, path: str = "path", out: str = "scope") -> DataFrame:
    """Add the longest scope prefix that owns ``path``; the root is ``''``.

    ``scopes`` is a list of prefixes or a table with column ``prefix``.
    """
    if isinstance(scopes, list) and len(scopes) <= LITERAL_SCOPES:
        named = [s for s in scopes if s]
        if not named:
            return df.withColumn(out, F.lit(""))
        owners = F.filter(prefixes(F.col(path)), lambda p: p.isin(*named))
        return df.withColumn(out, F.coalesce(F.try_element_at(owners, F.lit(-1)), F.lit("")))
    table = scopes if isinstance(scopes, DataFrame) else df.sparkSession.createDataFrame(
        [(s,) for s in scopes], "prefix string")
    dirs = df.select(path).distinct()
    owned = (
        dirs.select(path, F.explode(prefixes(F.col(path))).alias("prefix"))
        .join(table.select("prefix").distinct(), "prefix")
        .groupBy(path).agg(F.max_by("prefix", F.length("prefix")).alias(out))
    )
    return df.join(owned, path, "left").withColumn(out, F.coalesce(out, F.lit("")))


def substantial(nodes: DataFrame, scopes: list[str]) -> list[str]:
    """Drop scopes with too few symbols; their nodes belong to the root then."""
    if len(scopes) <= 1:
        return scopes
    counts = (
        with_scope(nodes.where(F.col("kind") != "file"), scopes).groupBy("scope").agg(F.count("*").alias("n"))
        .where(F.col("n") >= MIN_SCOPE_NODES).select("scope")
    )
    big = {r[0] for r in counts.collect()}  # at most one row per scope
    kept = [s for s in scopes if s == "" or s in big]
    return kept or [""]


def _matches(path: Column, pattern: str) -> Column:
    """Whether a directory is one that a workspace entry stands for: ``a/*``, ``a/**`` or a plain path."""
    pattern = pattern.replace("\\", "/").rstrip("/")
    if "*" not in pattern:
        return path == pattern
    head, _, last = pattern.rpartition("/")
    if "*" in head or last not in ("*", "**"):
        return F.lit(False)
    below = (path != "") & F.startswith(path, F.lit(f"{head}/" if head else ""))
    return below if last == "**" else below & (F.size(F.split(path, "/")) == len(head.split("/")) * bool(head) + 1)


def _with_parent(scopes: DataFrame) -> DataFrame:
    """Each scope with the closest other one above it: adds ``up`` and ``up_listed``, null where there is none."""
    above = scopes.select("prefix", F.explode(prefixes(F.col("prefix"))).alias("up")).where(F.col("up") != F.col("prefix"))
    known = scopes.select(F.col("prefix").alias("up"), F.col("listed").alias("up_listed"))
    parent = above.join(known, "up").groupBy("prefix").agg(F.max_by(F.struct("up", "up_listed"), F.length("up")).alias("p"))
    return scopes.join(parent, "prefix", "left").select("prefix", "markers", "listed", "p.up", "p.up_listed")


def discover(dirs: DataFrame, marks: DataFrame, globs: list[str] | None) -> DataFrame:
    """Project scopes (prefix, label, markers) of a tree, as joins of directories with the ones above them.

    ``dirs``: dir.  ``marks``: dir, marker, the project files.  A directory is a
    scope when the workspace entries ``globs`` list it, or when it holds a
    project file at most two levels down.  Where there are entries,
    ``package.json`` counts only in listed directories.  A listed scope
    replaces an unlisted one right above it; after that, a scope below another
    stays only if it is listed and the other is not.  Without any, the root is.
    """
    hit = F.lit(False)
    for g in globs or []:
        hit = hit | _matches(F.col("dir"), g)
    listed = dirs.where(hit).select("dir").distinct().withColumn("listed", F.lit(True))
    rank = F.array_position(F.array(*[F.lit(m) for m in MARKERS]), F.col("marker"))
    flagged = marks.join(listed, "dir", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    if globs is not None:
        flagged = flagged.where(F.col("listed") | (F.col("marker") != "package.json"))
    held = flagged.groupBy("dir").agg(F.array_sort(F.collect_set(F.struct(rank.alias("r"), "marker"))).alias("m"))
    level = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    found = held.join(listed, "dir", "full_outer").where(F.col("listed") | (level <= 2)).select(
        F.col("dir").alias("prefix"), F.coalesce(F.transform("m", lambda x: x["marker"]), F.array().cast("array<string>")).alias("markers"),
        F.coalesce("listed", F.lit(False)).alias("listed"))
    replaced = _with_parent(found).where("listed and not up_listed").select(F.col("up").alias("prefix")).distinct()
    found = found.join(replaced, "prefix", "left_anti")
    kept = _with_parent(found).where("up is null or (listed and not up_listed)").select(
        "prefix", F.col("prefix").alias("label"), "markers")
    spark = dirs.sparkSession
    root = spark.createDataFrame([("", "", [])], "prefix string, label string, markers array<string>")
    none = kept.groupBy().count().where("count = 0")
    return kept.union(root.join(none).select("prefix", "label", "markers"))
