"""Raw edges of source files: containment, heritage, calls and imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import _BEFORE_METHOD, IDENT, enclosing, in_file, make_id, scope_names

# Words that stand before a parenthesis without calling anything.
_NOT_CALLED = {
    "typescript": ["async", "if", "for", "while", "switch", "catch", "function", "return", "with", "typeof", "await", "yield", "in",
                   "of", "new", "class", "super", "import", "void", "else", "do", "export", "delete", "instanceof", "throw", "case"],
    "python": ["if", "for", "while", "return", "with", "await", "yield", "in", "and", "or", "not", "is", "lambda", "elif",
               "assert", "del", "raise", "except", "from", "import", "def", "class", "else", "case", "match"],
    "go": ["if", "for", "switch", "func", "return", "go", "defer", "range", "select", "case", "chan", "map", "struct",
           "interface", "var", "type", "const", "else", "import"],
}


def up_to_here():
    return in_file().rowsBetween(Window.unboundedPreceding, 0)


def exports(toks: DataFrame, defs: DataFrame) -> DataFrame:
    """Whether each definition is visible outside: (path, seq, exported).

    Python: no leading underscore.  Go: upper-case initial.  TypeScript: an
    ``export`` stands before it or before a definition around it.
    """
    told = toks.where((F.col("lang") == "typescript") & (F.col("tok") == "export"))
    # the export belongs to the first definition that starts after it
    marks = told.select("path", "seq", F.lit(True).alias("mark"))
    starts = defs.where(F.col("lang") == "typescript").select("path", "seq", F.lit(False).alias("mark"))
    both = marks.unionByName(starts)
    both = both.withColumn("last", F.lag("mark").over(in_file())).withColumn("last_seq", F.lag("seq").over(in_file()))
    own = both.where(~F.col("mark")).select(
        "path", "seq", (F.coalesce("last", F.lit(False)) & (F.col("seq") - F.col("last_seq") <= 5)).alias("own"))
    ts = defs.where(F.col("lang") == "typescript").select("path", "seq", "id", "parent").join(own, ["path", "seq"])
    shown = ts.where("own").select("path", "id").distinct()
    ids = ts.withColumn("prefix", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(F.split(F.substring_index("id", "#", -1), r"\."))),
        lambda i: F.concat(F.col("path"), F.lit("#"), F.array_join(F.slice(F.split(F.substring_index("id", "#", -1), r"\."), 1, i), ".")))))
    visible = ids.join(shown.withColumnRenamed("id", "prefix"), ["path", "prefix"], "left_semi").select("path", "seq").distinct()
    ts_flags = visible.withColumn("exported", F.lit(True))
    first = F.substring("name", 1, 1)
    other = defs.where(F.col("lang") != "typescript").select(
        "path", "seq",
        F.when(F.col("lang") == "python", ~F.col("name").startswith("_"))
        .otherwise((first != F.lower(first)) & (first == F.upper(first))).alias("exported"))
    return ts_flags.unionByName(other)


# --------------------------------------------------------------------------
# types of variables


def _bindings(toks: DataFrame) -> DataFrame:
    """Variables whose type is told where they are bound: (path, lang, seq, name, type, on_class)."""
    t, p1 = F.col("tok"), F.col("p1")
    n = [None, *[F.col(f"n{i}") for i in range(1, 8)]]
    ident = {i: n[i].rlike(IDENT) for i in range(1, 8)}
    no = F.coalesce(p1, F.lit("")) != "."
    py, ts, go = (F.col("lang") == x for x in ("python", "typescript", "go"))
    this = t.isin("self", "cls", "this") & (n[1] == ".") & ident[2]

    def pick(cond: Column, name: Column, type_: Column, on_class: bool = False) -> DataFrame:
        return toks.where(cond).select("path", "lang", "seq", name.alias("name"), type_.alias("type"), F.lit(on_class).alias("on_class"))

    called = (n[1] == "=") & ident[2] & (n[3] == "(")
    annotated = (n[1] == ":") & ident[2]
    declared = p1.isin("const", "let", "var")
    member = F.col("bol") | p1.isin("{", ";", "private", "public", "protected", "readonly", "static")
    plain_end = n[3].isin("=", ",", ")", ";", "}") | n[3].isNull()
    parts = [
        pick(py & F.col("bol") & t.rlike(IDENT) & called, t, n[2]),
        pick(py & F.col("bol") & t.rlike(IDENT) & annotated & ~n[3].isin("[", ".", "|"), t, n[2]),
        pick(py & p1.isin("(", ",") & (F.col("level") > 0) & t.rlike(IDENT) & annotated & n[3].isin(",", ")", "="), t, n[2]),
        pick(py & F.col("bol") & this & (n[3] == "=") & ident[4] & (n[5] == "("), F.concat(F.lit("self."), n[2]), n[4], True),
        pick(ts & declared & t.rlike(IDENT) & (n[1] == "=") & (n[2] == "new") & ident[3] & ~F.coalesce(n[4], F.lit("")).isin("."), t, n[3]),
        pick(ts & declared & t.rlike(IDENT) & annotated & (n[3] == "="), t, n[2]),
        pick(ts & p1.isin("(", ",") & (F.col("level") > 0) & t.rlike(IDENT) & annotated & n[3].isin(",", ")", "="), t, n[2]),
        pick(ts & member & ~declared & t.rlike(IDENT) & annotated & plain_end & ~p1.isin("(", ","), F.concat(F.lit("this."), t), n[2], True),
        pick(ts & member & ~declared & t.rlike(IDENT) & (n[1] == "=") & (n[2] == "new") & ident[3], F.concat(F.lit("this."), t), n[3], True),
        pick(go & (p1 == "var") & t.rlike(IDENT) & ident[1], t, n[1]),
        pick(go & (p1 == "var") & t.rlike(IDENT) & (n[1] == "*") & ident[2], t, n[2]),
        pick(go & no & t.rlike(IDENT) & (n[1] == ":=") & ident[2] & (n[3] == "{"), t, n[2]),
        pick(go & no & t.rlike(IDENT) & (n[1] == ":=") & (n[2] == "&") & ident[3] & (n[4] == "{"), t, n[3]),
        pick(go & no & t.rlike(IDENT) & (n[1] == ":=") & n[2].rlike("^New[A-Z]") & (n[3] == "("), t, F.substring(n[2], 4, 1000)),
    ]
    return reduce(DataFrame.unionByName, parts)


def _aliases(toks: DataFrame) -> DataFrame:
    """Renamed imports: (path, alias, original)."""
    renamed = (F.col("n1") == "as") & F.col("n2").rlike(IDENT) & F.col("tok").rlike(IDENT)
    return toks.where(renamed & (F.col("lang") != "go")).groupBy("path", F.col("n2").alias("alias")).agg(
        F.max_by("tok", "seq").alias("original"))


def _typed_scopes(toks: DataFrame, defs: DataFrame) -> DataFrame:
    """Type of each name per scope, the last binding winning: (path, scope, name, type)."""
    bound = _bindings(toks)
    # parameters stand in the header of their own definition, which is inside its span
    placed = enclosing(bound.withColumn("at", F.col("seq") * 2), defs)
    chain = F.coalesce(F.col("around"), F.array().cast(placed.schema["around"].dataType))
    classes = F.filter(F.transform(chain, lambda d, i: F.struct(d["kind"].alias("kind"), i.alias("i"))), lambda x: x["kind"] == "class")
    depth = F.when(F.col("on_class") & (F.size(classes) > 0), F.try_element_at(classes, F.lit(-1))["i"] + 1).otherwise(F.size(chain))
    scoped = placed.select(
        "path", "seq", "name", "type", F.array_join(F.slice(scope_names(F.col("around")), F.lit(1), depth), ".").alias("scope"))
    original = scoped.join(_aliases(toks).withColumnRenamed("alias", "type"), ["path", "type"], "left").withColumn(
        "type", F.coalesce("original", "type"))
    return original.groupBy("path", "scope", "name").agg(F.max_by("type", "seq").alias("type"))


# --------------------------------------------------------------------------
# calls


def _calls(toks: DataFrame) -> DataFrame:
    """Call sites: (path, lang, seq, name, via_member, receiver)."""
    t, p1, p2 = F.col("tok"), F.col("p1"), F.col("p2")
    before = {i: F.lag("tok", i).over(in_file()) for i in (3, 4, 5)}
    rows = toks.withColumns({f"p{i}": c for i, c in before.items()})
    member = F.coalesce(p1 == ".", F.lit(False))
    loose = ~F.coalesce(F.col("p3") == ".", F.lit(False))
    bare = p2.rlike(IDENT) & loose
    deep = p2.rlike(IDENT) & (F.col("p3") == ".") & F.col("p4").isin("self", "this") & ~F.coalesce(F.col("p5") == ".", F.lit(False))
    receiver = F.when(member & bare, p2).when(member & deep & (F.col("lang") != "go"), F.concat_ws(".", "p4", p2))
    word = F.lit(False)
    for lang, words in _NOT_CALLED.items():
        word = F.when(F.col("lang") == lang, t.isin(*words)).otherwise(word)
    # in Go only the name in a method header follows a closing parenthesis
    header = (F.col("lang") == "go") & F.coalesce(p1 == ")", F.lit(False)) & ~F.col("bol")
    called = t.rlike(IDENT) & (F.col("n1") == "(") & (member | ~word) & ~header & ~F.coalesce(
        p1.isin("def", "class", "function", "func", "new"), F.lit(False))
    return rows.where(called).select(
        "path", "lang", "seq", t.alias("name"), member.alias("via_member"), receiver.alias("receiver"),
        (~member & (F.col("bol") | p1.isin(*_BEFORE_METHOD))).alias("leads"))


def _call_edges(toks: DataFrame, defs: DataFrame) -> DataFrame:
    sites = _calls(toks).join(defs.select("path", "seq", F.lit(True).alias("is_def")), ["path", "seq"], "left").where(
        F.col("is_def").isNull()).drop("is_def")
    placed = enclosing(sites.withColumn("at", F.col("seq") * 2), defs)
    inner = F.coalesce(F.try_element_at("around", F.lit(-1))["kind"], F.lit("file"))
    # what looks like a call right inside a type or class body is a signature
    placed = placed.where(~inner.isin("interface", "struct", "type") & ~((inner == "class") & (F.col("lang") == "typescript") & F.col("leads")))
    chain = F.coalesce(F.col("around"), F.array().cast(placed.schema["around"].dataType))
    owners = F.filter(chain, lambda d: (d["kind"] == "class") | d["receiver"].isNotNull())
    owner = F.try_element_at(owners, F.lit(-1))
    owner_name = F.coalesce(owner["receiver"], owner["name"])
    names = scope_names(F.col("around"))
    site = placed.select(
        "path", "lang", "seq", "name", "via_member", "receiver", names.alias("names"), owner_name.alias("owner"),
        F.try_element_at(F.filter(chain, lambda d: d["receiver_var"].isNotNull()), F.lit(-1))["receiver_var"].alias("go_var"))
    direct = F.when(F.col("receiver").isin("self", "cls", "this"), F.col("owner")).when(
        (F.col("lang") == "go") & (F.col("receiver") == F.col("go_var")), F.col("owner"))
    site = site.withColumn("direct", direct)
    asked = site.where(F.col("receiver").isNotNull() & F.col("direct").isNull() & ~F.col("receiver").isin("self", "cls", "this"))
    spelled = F.array_distinct(F.array(F.col("receiver"), F.regexp_replace("receiver", r"^this\.", "self.")))
    looked = asked.select(
        "path", "seq", F.posexplode(spelled).alias("spelling", "key"), "names").select(
        "path", "seq", "spelling", "key", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("names")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("names", F.lit(1), i), ".").alias("scope"))
        )).alias("s")).select("path", "seq", "spelling", F.col("key").alias("name"), F.col("s.depth").alias("depth"), F.col("s.scope").alias("scope"))
    hit = looked.join(_typed_scopes(toks, defs), ["path", "scope", "name"]).groupBy("path", "seq").agg(
        F.min_by("type", F.struct("spelling", -F.col("depth"))).alias("bound"))
    typed = site.join(hit, ["path", "seq"], "left")
    return typed.select(
        make_id(F.col("path"), F.col("names")).alias("source"), F.lit("calls").alias("relation"), F.col("path").alias("file"),
        F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("specifier"), "name", "via_member",
        F.coalesce("direct", "bound").alias("recv_type"), F.col("seq").alias("at"))


# --------------------------------------------------------------------------
# heritage and imports


def _heritage(toks: DataFrame, defs: DataFrame) -> DataFrame:
    """Bases that are plain names, for classes only."""
    classes = defs.where(F.col("kind") == "class").select("path", "seq", F.struct("id", "header_off", F.col("seq").alias("start")).alias("cls"))
    # the header of a class is what follows its first token, up to where its body opens
    head = toks.join(classes, ["path", "seq"], "left").withColumn("of", F.last("cls", ignorenulls=True).over(up_to_here()))
    inside = head.where((F.col("seq") > F.col("of.start")) & (F.col("start_off") < F.col("of.header_off"))).select(
        "path", "lang", F.col("of.id").alias("id"), F.col("of.start").alias("start"), F.col("seq").alias("s"), "tok", "p1", "n1")
    w = Window.partitionBy("path", "start").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    clause = F.last(F.when(F.col("tok").isin("extends", "implements"), F.col("tok")), ignorenulls=True).over(w)
    named = F.col("tok").rlike(IDENT) & ~F.col("tok").isin("extends", "implements")
    plain = named & F.col("p1").isin("extends", "implements", ",", "(") & F.col("n1").isin(",", "{", ")", "implements", "<")
    rows = inside.withColumn("clause", F.when(F.col("lang") == "python", F.lit("extends")).otherwise(clause))
    rows = rows.where(plain & F.col("clause").isNotNull() & F.when(F.col("lang") == "python", F.col("n1").isin(",", ")") & (F.col("p1") != "{")).otherwise(F.lit(True)))
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("id").alias("source"), F.col("clause").alias("relation"), F.col("path").alias("file"), none.alias("target_id"),
        none.alias("specifier"), F.col("tok").alias("name"), F.lit(None).cast("boolean").alias("via_member"), none.alias("recv_type"), F.col("s").alias("at"))


def _imports(toks: DataFrame) -> DataFrame:
    t = F.col("tok")
    # the module is spelled by the names and dots after the first word of the statement
    started = toks.where(F.col("lang") == "python").withColumn(
        "opened", F.last(F.when(F.col("bol") & (F.col("level") == 0), F.struct("tok", "seq")), ignorenulls=True).over(up_to_here()))
    words = started.where(F.col("opened.tok").isin("import", "from") & (F.col("seq") > F.col("opened.seq"))).groupBy(
        "path", F.col("opened.seq").alias("seq"), F.col("opened.tok").alias("tok")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "tok"))), lambda x: x["tok"]).alias("tail"))
    flat = F.array_join("tail", " ")
    module = F.regexp_replace(F.regexp_extract(flat, r"^((?:\. ?)*(?:\w+(?: \. \w+)*)?)(?: |$)", 1), " ", "")
    module = F.regexp_replace(module, "import$", "")
    renamed = (t == "import") & F.regexp_extract(flat, r"^\w+(?: \. \w+)* as ", 0).startswith(F.regexp_extract(flat, r"^\w+", 0)) & flat.rlike(r"^\w+(?: \. \w+)* as ")
    python = words.where(~renamed).select("path", "seq", module.alias("specifier")).where(
        (F.col("specifier") != "") & (F.col("specifier") != "__future__"))
    text = F.regexp_replace(t, "^[\"'`]|[\"'`]$", "")
    is_string = t.rlike("^[\"'`]")
    statement = toks.where(F.col("lang") == "typescript").withColumn(
        "opened", F.last(F.when(F.col("bol") & (F.col("level") == 0), F.struct("tok", "seq")), ignorenulls=True).over(up_to_here()))
    script = statement.where(
        is_string & (F.col("level") == 0) & (F.col("opened.tok") == "import") & F.col("p1").isin("from", "import")
    ).select("path", "seq", text.alias("specifier"))
    go = toks.where(F.col("lang") == "go").withColumn(
        "opened", F.last(F.when(F.col("bol") & (F.col("level") == 0), F.col("tok")), ignorenulls=True).over(up_to_here()))
    package = go.where(is_string & (F.col("opened") == "import") & (F.col("level") <= 1)).select("path", "seq", text.alias("specifier"))
    none = F.lit(None).cast("string")
    every = python.unionByName(script).unionByName(package)
    return every.select(
        F.col("path").alias("source"), F.lit("imports").alias("relation"), F.col("path").alias("file"), none.alias("target_id"),
        "specifier", none.alias("name"), F.lit(None).cast("boolean").alias("via_member"), none.alias("recv_type"), F.col("seq").alias("at"))


def raw_edges(toks: DataFrame, defs: DataFrame) -> DataFrame:
    """All raw edges; ``ord`` follows the text inside each file."""
    none = F.lit(None).cast("string")
    contains = defs.select(
        F.col("parent").alias("source"), F.lit("contains").alias("relation"), F.col("path").alias("file"), F.col("id").alias("target_id"),
        none.alias("specifier"), none.alias("name"), F.lit(None).cast("boolean").alias("via_member"), none.alias("recv_type"), F.col("seq").alias("at"))
    every = contains.unionByName(_heritage(toks, defs)).unionByName(_call_edges(toks, defs)).unionByName(_imports(toks))
    return every.withColumn("ord", F.col("at").cast("bigint")).drop("at")
