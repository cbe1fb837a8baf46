"""Resolution of raw edges to node ids, as joins on names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import broadcast_if_small, materialize

# Import suffixes in the order they are tried.
IMPORT_EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".py"]
STRIPPED_EXTENSION = r"\.(js|jsx|mjs|cjs|ts|tsx|py)$"

# Receiver types whose methods are never symbols of a repository.
BUILTIN_CONTAINERS = [
    "Map", "Set", "WeakMap", "WeakSet", "Array", "Promise", "Object", "Date", "RegExp", "Error",
    "dict", "list", "set", "tuple", "str", "frozenset", "bytes",
]

# How far up an inheritance chain a method is looked for.
MAX_CLIMB = 3


# --------------------------------------------------------------------------
# names


def resolve_names(asked: DataFrame, nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Resolve (file, name) pairs: the first match in the file, else the only
    match anywhere.  Adds ``hit`` and ``confidence``; null when neither exists.
    """
    pool = nodes.where(F.col("kind").isin(*kinds))
    local = pool.groupBy(F.col("path").alias("file"), "name").agg(F.min_by("id", "ord").alias("local_id"))
    unique = pool.groupBy("name").agg(F.count("*").alias("n"), F.first("id").alias("global_id")).where("n = 1").drop("n")
    return (
        asked.join(local, ["file", "name"], "left").join(unique, "name", "left")
        .withColumn("hit", F.coalesce("local_id", "global_id"))
        .withColumn("confidence", F.when(F.col("local_id").isNotNull(), "extracted")
                    .when(F.col("global_id").isNotNull(), "inferred"))
        .drop("local_id", "global_id")
    )


def own_name(id_: Column) -> Column:
    """Last name segment of an id."""
    return F.element_at(F.split(F.substring(id_, F.instr(id_, "#") + 1, F.length(id_)), r"\."), -1)


def owner_methods(nodes: DataFrame) -> DataFrame:
    """Methods by the last two segments of their id: (owner, name, id, path, ord)."""
    parts = F.split(F.substring("id", F.instr("id", "#") + 1, F.length("id")), r"\.")
    return (
        nodes.where((F.col("kind") == "method") & (F.size(parts) >= 2))
        .select(F.element_at(parts, -2).alias("owner"), F.element_at(parts, -1).alias("name"), "id", "path", "ord")
    )


def class_parents(raw: DataFrame) -> DataFrame:
    """Declared bases by class name: (type, parent, ord)."""
    ext = raw.where((F.col("relation") == "extends") & F.col("name").isNotNull())
    return ext.groupBy(own_name(F.col("source")).alias("type"), F.col("name").alias("parent")).agg(
        F.min("ord").alias("ord"))


def ancestors(types: DataFrame, parents: DataFrame, depth: int = MAX_CLIMB) -> DataFrame:
    """Each type with its ancestors in search order.

    (recv_type, type, level, trail): the trail of declaration orders sorts the
    types of a level the way a breadth-first climb meets them.
    """
    level = types.select("recv_type", F.col("recv_type").alias("type"),
                         F.lit(0).alias("level"), F.array().cast("array<bigint>").alias("trail"))
    out = seen = level
    for step in range(1, depth + 1):
        up = level.join(parents, "type").select(
            "recv_type", F.col("parent").alias("type"),
            F.array_append("trail", F.col("ord")).alias("trail"))
        level = materialize(
            up.groupBy("recv_type", "type").agg(F.min("trail").alias("trail"))
            .join(seen.select("recv_type", "type"), ["recv_type", "type"], "left_anti")
            .select("recv_type", "type", F.lit(step).alias("level"), "trail"))
        if level.isEmpty():
            break
        out = seen = out.unionByName(level)
    return out


def resolve_typed(calls: DataFrame, nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """Resolve distinct (recv_type, name, file) member calls.

    The first type of the climb that owns such a method decides: one owner
    wins, several win only through one in the calling file, else the call is
    ambiguous and stops there.  Adds ``hit``, ``confidence`` and ``outcome``
    (``hit``, ``ambiguous`` or ``none``).
    """
    keys = calls.select("recv_type", "name", "file").distinct()
    methods = owner_methods(nodes)
    counted = methods.groupBy("owner", "name").agg(
        F.count("*").alias("n"), F.min_by(F.struct("id", "path"), "ord").alias("one"))
    in_file = methods.groupBy("owner", "name", F.col("path").alias("file")).agg(F.min_by("id", "ord").alias("same_file"))
    chain = ancestors(keys.select("recv_type").distinct(), class_parents(raw))
    tried = (
        keys.join(chain, "recv_type").withColumnRenamed("type", "owner")
        .join(counted, ["owner", "name"])
        .join(in_file, ["owner", "name", "file"], "left")
    )
    first = tried.groupBy("recv_type", "name", "file").agg(
        F.min_by(F.struct("n", "one", "same_file"), F.struct("level", "trail")).alias("f"))
    decided = first.select(
        "recv_type", "name", "file",
        F.when(F.col("f.n") == 1, F.col("f.one.id")).otherwise(F.col("f.same_file")).alias("hit"),
        F.when((F.col("f.n") > 1) | (F.col("f.one.path") == F.col("file")), "extracted")
        .otherwise("inferred").alias("confidence"),
    )
    return keys.join(decided, ["recv_type", "name", "file"], "left").withColumn(
        "outcome",
        F.when(F.col("hit").isNotNull(), "hit").when(F.col("confidence").isNotNull(), "ambiguous").otherwise("none"),
    ).withColumn("confidence", F.when(F.col("hit").isNotNull(), F.col("confidence")))


# --------------------------------------------------------------------------
# imports


def normalize_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    def fold(acc: Column, s: Column) -> Column:
        can_pop = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return (
            F.when((s == "") | (s == "."), acc)
            .when((s == "..") & can_pop, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.array_append(acc, s))
        )

    start = F.array().cast("array<string>")
    # an empty array has no last element; a sentinel in front keeps element_at legal
    start = F.array_append(start, F.lit(".."))
    folded = F.aggregate(F.split(path, "/"), start, fold)
    clean = F.concat_ws("/", F.slice(folded, F.lit(2), F.size(folded)))
    return F.when(clean == "", F.lit(".")).otherwise(clean)


def import_keys(nodes: DataFrame) -> DataFrame:
    """Every spelling under which a file can be imported, with its priority.

    Turning each file into its few spellings keeps the lookup an equi-join of
    two keys per import instead of one probe per suffix.
    """
    id_ = F.col("id")
    exts = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(i).alias("i")) for i, e in enumerate(IMPORT_EXTENSIONS)])
    ends = F.filter(exts, lambda x: id_.endswith(x["e"]))

    def cut(suffix_len):
        return F.substring(id_, F.lit(1), F.length(id_) - suffix_len)

    direct = F.transform(ends, lambda x: F.struct(
        cut(F.length(x["e"])).alias("key"), (x["i"] + 1).alias("pos"), F.lit(True).alias("stem")))
    indexed = F.filter(ends, lambda x: id_.endswith(F.concat(F.lit("/index"), x["e"])))
    index = F.transform(indexed, lambda x: F.struct(
        cut(F.length(x["e"]) + 6).alias("key"), (x["i"] + 10).alias("pos"), F.lit(True).alias("stem")))
    exact = F.array(F.struct(id_.alias("key"), F.lit(0).alias("pos"), F.lit(False).alias("stem")))
    flat = nodes.select("id", F.explode(F.concat(exact, direct, index)).alias("k"))
    return flat.select("id", "k.key", "k.pos", "k.stem")


def resolve_imports(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """Resolve distinct (file, specifier) pairs; anything unknown stays as written."""
    keys = imports.select("file", "specifier").distinct()
    relative = F.col("specifier").startswith(".")
    base = normalize_path(F.concat_ws("/", X.dirname(F.col("file")), F.col("specifier")))
    probes = (
        keys.where(relative).withColumn("base", base)
        .select("file", "specifier", F.explode(F.array(
            F.struct(F.col("base").alias("key"), F.lit(False).alias("stem")),
            F.struct(F.regexp_replace("base", STRIPPED_EXTENSION, "").alias("key"), F.lit(True).alias("stem")),
        )).alias("p")).select("file", "specifier", "p.key", "p.stem")
    )
    found = probes.join(import_keys(nodes.select("id").distinct()), ["key", "stem"]).groupBy("file", "specifier").agg(
        F.min_by("id", "pos").alias("hit"))
    return keys.join(found, ["file", "specifier"], "left").withColumn("target", F.coalesce("hit", "specifier")).drop("hit")


def resolve_go_imports(imports: DataFrame, nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """Resolve Go package paths through the modules (module, dir) of the tree.

    The longest module that prefixes the path owns it; the package resolves to
    the first file of its directory.
    """
    from .scopes import prefixes

    keys = imports.select("file", "specifier").distinct()
    owned = (
        keys.select("file", "specifier", F.explode(prefixes(F.col("specifier"))).alias("module"))
        .join(broadcast_if_small(modules), "module")
        .groupBy("file", "specifier")
        .agg(F.max_by(F.struct("module", "dir"), F.length("module")).alias("m"))
    )
    sub = F.substring("specifier", F.length("m.module") + 2, F.length("specifier"))
    located = owned.select(
        "file", "specifier", normalize_path(F.concat_ws("/", F.col("m.dir"), sub)).alias("pkg"))
    first_file = (
        nodes.where((F.col("kind") == "file") & F.col("path").endswith(".go"))
        .groupBy(X.dirname(F.col("path")).alias("pkg")).agg(F.min("id").alias("hit"))
    )
    found = located.join(first_file, "pkg").select("file", "specifier", "hit")
    return keys.join(found, ["file", "specifier"], "left").withColumn("target", F.coalesce("hit", "specifier")).drop("hit")


# --------------------------------------------------------------------------
# everything together


def resolve_edges(nodes: DataFrame, raw: DataFrame, go_modules: DataFrame | None = None) -> DataFrame:
    """Raw edges to edges, first occurrence of (source, relation, target) kept."""
    raw = materialize(raw)
    out = ["source", "target", "relation", "confidence", "ord"]

    contains = raw.where((F.col("relation") == "contains") & F.col("target_id").isNotNull()).select(
        "source", F.col("target_id").alias("target"), "relation", F.lit("extracted").alias("confidence"), "ord")

    imports = raw.where((F.col("relation") == "imports") & F.col("specifier").isNotNull())
    is_go = F.col("file").endswith(".go") if go_modules is not None else F.lit(False)
    targets = resolve_imports(imports.where(~is_go), nodes)
    if go_modules is not None:
        targets = targets.unionByName(resolve_go_imports(imports.where(is_go), nodes, go_modules))
    imported = imports.join(targets, ["file", "specifier"]).withColumn("confidence", F.lit("extracted")).select(*out)

    def heritage(relation: str, kinds: list[str]) -> DataFrame:
        asked = raw.where(F.col("relation") == relation).select("source", "relation", "file", "name", "ord")
        hit = resolve_names(asked, nodes, kinds)
        return hit.withColumn("target", F.coalesce("hit", "name")).withColumn(
            "confidence", F.coalesce("confidence", F.lit("inferred"))).select(*out)

    calls = raw.where(F.col("relation") == "calls")
    typed = calls.where(F.col("via_member") & F.col("recv_type").isNotNull())
    verdicts = materialize(resolve_typed(typed, nodes, raw))
    judged = typed.drop("target_id", "specifier").join(verdicts, ["recv_type", "name", "file"])
    typed_hits = judged.where(F.col("outcome") == "hit").withColumn("target", F.col("hit")).select(*out)
    open_calls = judged.where((F.col("outcome") == "none") & ~F.col("recv_type").isin(*BUILTIN_CONTAINERS))
    ask = ["source", "relation", "file", "name", "ord"]
    member = calls.where(F.col("via_member") & F.col("recv_type").isNull()).select(*ask).unionByName(open_calls.select(*ask))
    plain = calls.where(~F.col("via_member")).select(*ask)

    def named(asked: DataFrame, kinds: list[str]) -> DataFrame:
        return resolve_names(asked, nodes, kinds).where(F.col("hit").isNotNull()).withColumn(
            "target", F.col("hit")).select(*out)

    every = (
        contains.unionByName(imported)
        .unionByName(heritage("extends", ["class", "interface"]))
        .unionByName(heritage("implements", ["interface"]))
        .unionByName(typed_hits).unionByName(named(member, ["method"])).unionByName(named(plain, ["function"]))
    )
    return every.groupBy("source", "relation", "target").agg(
        F.min_by("confidence", "ord").alias("confidence"), F.min("ord").alias("ord")).select(*out)
