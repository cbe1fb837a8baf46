"""Definitions, calls and imports of source files, from their token streams.

Files become token rows; brackets, blocks and scopes are found with windows
over those rows, names with joins.  A file is at most a megabyte, so its
window is small and files spread over all tasks.  There is no grammar here:
the rules read the shapes below and are approximate where a language allows
stranger ones (see the README).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialize, store_table
from .grep import BUCKET

# --------------------------------------------------------------------------
# tokens

_STRING = r'"(?:[^"\\\n]|\\.)*+"|' + r"'(?:[^'\\\n]|\\.)*+'"
_REST = r"|[A-Za-z_$][\w$]*+|\d[\w.]*+|=>|:=|\n[ \t]*+|[^\s]|\s"
_C_COMMENTS = r"/\*[\s\S]*?\*/|//[^\n]*+|"
_BACKTICK = r"`(?:[^`\\]|\\[\s\S])*+`|"
_TRIPLE = r'"""(?:\\[\s\S]|(?!""")[\s\S])*+"""|' + r"'''(?:\\[\s\S]|(?!''')[\s\S])*+'''"
LEXERS = {
    "typescript": _C_COMMENTS + _BACKTICK + _STRING + _REST,
    "python": rf"#[^\n]*+|\\\n|(?:[rRbBfFuU]{{1,2}}(?=[\"']))?+(?:{_TRIPLE}|{_STRING})" + _REST,
    "go": _C_COMMENTS + r"`[^`]*+`|" + _STRING + _REST,
}

IDENT = r"^[A-Za-z_$][\w$]*$"
OPEN, CLOSE = ["(", "[", "{"], [")", "]", "}"]


def in_file():
    """The tokens of a file in order."""
    return Window.partitionBy("path").orderBy("seq")


def before():
    return in_file().rowsBetween(Window.unboundedPreceding, -1)


def family(lang: Column) -> Column:
    return F.when(lang == "tsx", "typescript").otherwise(lang)


def tokens(files: DataFrame) -> DataFrame:
    """Token rows of ``files`` (path, content): lines, offsets and bracket levels.

    ``level`` is the bracket depth around a token; a bracket has the level of
    the place it stands in, so an opening bracket and its closing one are
    neighbours among the brackets of one level.
    """
    src = files.select("path", family(X.language_of(F.col("path"))).alias("lang"),
                       F.concat(F.lit("\n"), "content").alias("text")).where(F.col("lang").isNotNull())
    cut = F.lit(None).cast("array<string>")
    for lang, regex in LEXERS.items():
        cut = F.when(F.col("lang") == lang, F.regexp_extract_all("text", F.lit("[ \\t\\r]*+(?:" + regex + ")"), 0)).otherwise(cut)
    raw = src.select("path", "lang", F.posexplode(cut).alias("seq", "raw"))
    breaks = F.length("raw") - F.length(F.regexp_replace("raw", "\n", ""))
    tok = F.when(F.trim("raw").startswith("\n"), F.lit("\n")).otherwise(F.regexp_replace("raw", r"^[ \t\r]+", ""))
    rows = raw.select(
        "path", "lang", "seq", tok.alias("tok"),
        F.sum(breaks).over(in_file()).cast("int").alias("end_line"),
        breaks.alias("breaks"),
        (F.sum(F.length("raw")).over(in_file()) - 1).alias("end_off"),
        F.when(F.trim("raw").startswith("\n"), F.length("raw") - F.instr("raw", "\n")).alias("pad"),
    )
    is_break = F.col("tok") == "\n"
    rows = rows.select(
        "path", "lang", "seq", "tok", "end_line", "end_off",
        (F.col("end_line") - F.when(is_break, 0).otherwise(F.col("breaks"))).cast("int").alias("line"),
        (F.col("end_off") - F.length("tok") + 1).alias("start_off"), "pad",
    ).where(~F.col("tok").rlike(r"^(/\*|//)") & ~((F.col("lang") == "python") & F.col("tok").rlike(r"^(#|\\\n)")))
    rows = rows.withColumns({
        "bol": F.coalesce(F.lag(is_break).over(in_file()), F.lit(False)),
        "indent": F.when(F.coalesce(F.lag(is_break).over(in_file()), F.lit(False)), F.lag("pad").over(in_file())),
    }).where(~is_break & (F.trim("tok") != "")).drop("pad")
    delta = F.when(F.col("tok").isin(*OPEN), 1).when(F.col("tok").isin(*CLOSE), -1).otherwise(0)
    rows = rows.withColumn("level", (
        F.coalesce(F.sum(delta).over(before()), F.lit(0)) + F.when(F.col("tok").isin(*CLOSE), -1).otherwise(0)).cast("int"))
    near = {f"p{i}": F.lag("tok", i).over(in_file()) for i in (1, 2)}
    near |= {f"n{i}": F.lead("tok", i).over(in_file()) for i in range(1, 8)}
    rows = rows.withColumns(near)
    brackets = Window.partitionBy("path", "level").orderBy("seq")
    ahead = brackets.rowsBetween(1, Window.unboundedFollowing)

    def next_of(cond: Column, value: str = "seq") -> Column:
        return F.first(F.when(cond, F.col(value)), ignorenulls=True).over(ahead)

    t = F.col("tok")
    return rows.withColumns({
        "brace": next_of(t == "{"),
        "semi": next_of(t == ";"),
        "shut": next_of(t.isin(*CLOSE)),
        "new_line": next_of(F.col("bol")),
    })


# --------------------------------------------------------------------------
# definitions

_NOT_METHODS = ["if", "for", "while", "switch", "catch", "function", "return", "with", "new", "super", "await", "typeof"]
_MODIFIERS = ["abstract", "async", "static", "get", "set", "public", "private", "protected", "override", "readonly", "declare"]
_BEFORE_METHOD = ["{", "}", ";", ",", "async", "static", "get", "set", "public", "private", "protected", "override", "*", ")"]


# Stands for a token past the end of the file.
FAR = 2**31 - 1


def _tails(toks: DataFrame) -> DataFrame:
    """The token before each position: (path, limit, end_seq, end_line, end_off)."""
    return toks.select("path", F.coalesce("after_seq", F.lit(FAR)).alias("limit"), F.col("seq").alias("end_seq"), "end_line", "end_off")


def _is(c: str) -> Column:
    return F.col(c).rlike(IDENT)


def _shape(kind: str, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def _method(name: Column, recv: Column, var: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(name.alias("name"), recv.alias("recv"), (none if var is None else var).alias("var"))


def _ends(toks: DataFrame) -> DataFrame:
    """Closing bracket of every opening one: (path, open, close, close_line, close_off)."""
    w = Window.partitionBy("path", "level").orderBy("seq")
    br = toks.where(F.col("tok").isin(*OPEN, *CLOSE)).select(
        "path", F.col("seq").alias("open"), "tok", F.lead("seq").over(w).alias("close"),
        F.lead("end_line").over(w).alias("close_line"), F.lead("end_off").over(w).alias("close_off"),
        F.lead("after").over(w).alias("after_close"), F.lead("brace").over(w).alias("brace_after"),
        F.lead("semi").over(w).alias("semi_after"), F.col("start_off").alias("open_off"))
    return br.where(F.col("tok").isin(*OPEN)).drop("tok")


def _ts_definitions(toks: DataFrame, ends: DataFrame) -> DataFrame:
    t, p1, n1, n2 = (F.col(c) for c in ("tok", "p1", "n1", "n2"))
    has_body = F.col("brace").isNotNull() & (F.col("semi").isNull() | (F.col("brace") < F.col("semi")))
    fresh = F.coalesce(p1, F.lit("")) != "."
    word = (
        F.when((t == "class") & _is("n1") & ~n1.isin("extends", "implements"), _shape("class", n1))
        .when((t == "interface") & _is("n1") & n2.isin("{", "extends", "<"), _shape("interface", n1))
        .when((t == "enum") & _is("n1") & (n2 == "{"), _shape("enum", n1))
        .when((t == "function") & _is("n1") & n2.isin("(", "<"), _shape("function", n1))
        .when((t == "function") & (n1 == "*") & _is("n2"), _shape("function", n2))
    )
    begin = (
        F.when(p1.isin(*_MODIFIERS) & F.col("p2").isin(*_MODIFIERS), F.col("before_off2"))
        .when(p1.isin(*_MODIFIERS), F.col("before_off")).otherwise(F.col("start_off")).alias("start_off"))
    blocks = toks.where(fresh & has_body).withColumn("d", word).where(F.col("d").isNotNull()).select(
        "path", "seq", "line", begin, F.col("d.kind").alias("kind"), F.col("d.name").alias("name"), F.col("brace").alias("open"))

    calls = toks.where(_is("tok") & (n1 == "(") & ~t.isin(*_NOT_METHODS) & (p1.isin(*_BEFORE_METHOD) | F.col("bol")))
    opens = ends.select("path", (F.col("open") - 0).alias("paren"), "after_close", "brace_after", "semi_after")
    methods = calls.withColumn("paren", F.col("after_seq")).join(opens, ["path", "paren"]).where(
        (F.col("after_close") == "{")
        | ((F.col("after_close") == ":") & F.col("brace_after").isNotNull()
           & (F.col("semi_after").isNull() | (F.col("brace_after") < F.col("semi_after"))))
    ).select("path", "seq", "line", begin, F.lit("method").alias("kind"), t.alias("name"), F.col("brace_after").alias("open"))
    defs = blocks.unionByName(methods)
    closed = defs.join(ends.select("path", "open", "close", "close_line", "close_off", "open_off"), ["path", "open"])
    body = closed.select(
        "path", "seq", "line", "start_off", "kind", "name", F.col("open_off").alias("header_off"),
        F.col("close").alias("end_seq"), F.col("close_line").alias("end_line"), F.col("close_off").alias("end_off"))

    # const name = (…) => …   and   const name = function …
    value = Window.partitionBy("path", "level").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    eq = F.struct("seq", "n1", "n2", F.col("after_seq").alias("first"), F.col("after_seq2").alias("second"))
    declared = toks.withColumns({
        "eq": F.first(F.when(t == "=", eq), ignorenulls=True).over(value),
        "arrow": F.first(F.when(t == "=>", F.struct("seq", "n1", "after_seq", "start_off")), ignorenulls=True).over(value),
        "stop": F.least(F.coalesce("semi", F.lit(FAR)), F.coalesce("shut_up", F.lit(FAR))),
    }).where(p1.isin("const", "let", "var") & _is("tok") & n1.isin("=", ":") & F.col("eq").isNotNull() & (F.col("eq.seq") < F.col("stop")))
    first = F.when(F.col("eq.n1") == "async", F.col("eq.second")).otherwise(F.col("eq.first"))
    lead = F.when(F.col("eq.n1") == "async", F.col("eq.n2")).otherwise(F.col("eq.n1"))
    maybe = declared.select("path", "seq", "line", "start_off", t.alias("name"), "brace", "arrow", "stop", lead.alias("lead"),
                            first.alias("first"), F.col("eq.n2").alias("eq_n2"), "new_line")
    params = ends.select("path", F.col("open").alias("first"), F.col("close").alias("params_end"), F.col("after_close").alias("past_params"))
    maybe = maybe.join(params, ["path", "first"], "left")
    by_arrow = F.col("arrow").isNotNull() & (F.col("arrow.seq") < F.col("stop")) & (
        ((F.col("lead") == "(") & F.col("past_params").isin("=>", ":"))
        | (F.col("lead").rlike(IDENT) & (F.col("arrow.seq") == F.col("first") + 1)))
    by_word = (F.col("lead") == "function") & F.col("brace").isNotNull()
    fns = maybe.where(by_arrow | by_word).withColumn(
        "open", F.when(by_word, F.col("brace")).when(F.col("arrow.n1") == "{", F.col("arrow.after_seq")))
    fns = fns.join(ends.select("path", "open", "close", "close_line", "close_off", "open_off"), ["path", "open"], "left")
    limit = F.least(F.col("stop"), F.coalesce("new_line", F.lit(FAR)))
    short = fns.where(F.col("open").isNull()).withColumn("limit", limit).join(_tails(toks), ["path", "limit"])
    arrows = fns.where(F.col("open").isNotNull()).select(
        "path", "seq", "line", "start_off", F.lit("function").alias("kind"), "name", F.col("open_off").alias("header_off"),
        F.col("close").alias("end_seq"), F.col("close_line").alias("end_line"), F.col("close_off").alias("end_off"),
    ).unionByName(short.select(
        "path", "seq", "line", "start_off", F.lit("function").alias("kind"), "name", F.col("arrow.start_off").alias("header_off"),
        "end_seq", "end_line", "end_off"))

    # type Name = …
    alias = toks.where((t == "type") & _is("n1") & n2.isin("=", "<") & fresh & ~F.coalesce(p1, F.lit("")).isin("import", ","))
    limit = F.least(F.coalesce("semi", F.lit(FAR)), F.coalesce("new_line", F.lit(FAR)), F.coalesce("shut_up", F.lit(FAR)))
    types = alias.withColumn("limit", limit).drop("end_line", "end_off").join(_tails(toks), ["path", "limit"]).select(
        "path", "seq", "line", "start_off", F.lit("type").alias("kind"), n1.alias("name"), (F.col("end_off") + 1).alias("header_off"),
        "end_seq", "end_line", "end_off")
    return body.unionByName(arrows).unionByName(types).withColumns({
        "receiver": F.lit(None).cast("string"), "receiver_var": F.lit(None).cast("string")})


def _py_definitions(toks: DataFrame, ends: DataFrame) -> DataFrame:
    t = F.col("tok")
    # first tokens of statements; a line inside brackets continues one
    starts = toks.where(F.col("bol") & (F.col("level") == 0) & ~t.isin(*CLOSE))
    head = starts.where(t.isin("def", "class") | ((t == "async") & (F.col("n1") == "def"))).withColumn(
        "name", F.when(t == "async", F.col("n2")).otherwise(F.col("n1")))
    levels = head.select("path", F.col("indent").alias("deep")).distinct()
    dedents = starts.select("path", "seq", "indent").join(levels, "path").where(F.col("indent") <= F.col("deep"))
    w = Window.partitionBy("path", "deep").orderBy("seq")
    after = dedents.withColumn("next_seq", F.lead("seq").over(w)).where(F.col("indent") == F.col("deep")).select("path", "seq", "next_seq")
    found = head.join(after, ["path", "seq"]).select(
        "path", "seq", "line", "start_off", "name", F.when(t == "class", "class").otherwise("function").alias("kind"), "colon", "next_seq")
    both = found.withColumn("limit", F.coalesce("next_seq", F.lit(FAR))).join(_tails(toks), ["path", "limit"])
    return both.select(
        "path", "seq", "line", "start_off", "kind", "name", F.coalesce("colon.after_off", "end_off").alias("header_off"),
        "end_seq", "end_line", "end_off", F.lit(None).cast("string").alias("receiver"), F.lit(None).cast("string").alias("receiver_var"))


def _go_definitions(toks: DataFrame, ends: DataFrame) -> DataFrame:
    t = F.col("tok")
    n = [None, *[F.col(f"n{i}") for i in range(1, 8)]]
    # func ( v * T ) Name  |  func ( v T ) Name  |  func ( * T ) Name  |  func ( T ) Name
    shape = (
        F.when(n[1] != "(", _method(n[1], F.lit(None).cast("string")))
        .when((n[3] == "*") & (n[5] == ")"), _method(n[6], n[4], n[2]))
        .when((n[2] == "*") & (n[4] == ")"), _method(n[5], n[3]))
        .when(n[4] == ")", _method(n[5], n[3], n[2]))
        .when(n[3] == ")", _method(n[4], n[2]))
    )
    # a body opens on the line its signature ends on, so it stands before the next line of the same level
    bodied = F.col("brace").isNotNull() & (F.col("new_line").isNull() | (F.col("brace") < F.col("new_line")))
    funcs = toks.where((t == "func") & F.col("bol") & (F.col("level") == 0) & bodied).withColumn("d", shape).where(
        F.col("d").isNotNull() & F.col("d.name").rlike(IDENT)
    ).select("path", "seq", "line", "start_off", F.when(n[1] == "(", "method").otherwise("function").alias("kind"),
             F.col("d.name").alias("name"), F.col("brace").alias("open"), F.col("d.recv").alias("receiver"), F.col("d.var").alias("receiver_var"))

    def shaped(c: Column) -> Column:
        return F.when(c == "struct", "struct").when(c == "interface", "interface").otherwise("type")

    none = F.lit(None).cast("string")
    single = toks.where((t == "type") & F.col("bol") & _is("n1"))
    single = single.select("path", F.col("after_seq").alias("seq"), "line", (F.col("start_off") + 5).alias("start_off"),
                           shaped(n[2]).alias("kind"), n[1].alias("name"), "brace", "new_line", F.col("after_off2").alias("shape_off"))
    # a name on the first level stands in the last bracket opened on level zero
    outer = F.last(F.when((F.col("level") == 0) & t.isin(*OPEN), F.col("p1")), ignorenulls=True).over(before())
    inside = toks.withColumn("outer", outer).where(
        F.col("bol") & _is("tok") & (F.col("level") == 1) & (F.col("outer") == "type")
    ).select("path", "seq", "line", "start_off", shaped(n[1]).alias("kind"), t.alias("name"), "brace", "new_line", F.col("after_off").alias("shape_off"))
    named = single.unionByName(inside)
    blocky = named.where(F.col("kind") != "type").select(
        "path", "seq", "line", "start_off", "kind", "name", F.col("brace").alias("open"), none.alias("receiver"), none.alias("receiver_var"), "shape_off")
    closed = funcs.withColumn("shape_off", F.lit(None).cast("bigint")).unionByName(blocky).join(
        ends.select("path", "open", "close", "close_line", "close_off", "open_off"), ["path", "open"]).select(
        "path", "seq", "line", "start_off", "kind", "name", F.coalesce("shape_off", "open_off").alias("header_off"),
        F.col("close").alias("end_seq"), F.col("close_line").alias("end_line"), F.col("close_off").alias("end_off"), "receiver", "receiver_var")
    last = toks.select("path", F.col("line"), F.col("seq").alias("tail"), F.col("end_line").alias("tail_line"), F.col("end_off").alias("tail_off"))
    flat = named.where(F.col("kind") == "type").select("path", "seq", "line", "start_off", "kind", "name").join(
        last, ["path", "line"]).groupBy("path", "seq", "line", "start_off", "kind", "name").agg(
        F.max(F.struct("tail", "tail_line", "tail_off")).alias("e")).select(
        "path", "seq", "line", "start_off", "kind", "name", (F.col("e.tail_off") + 1).alias("header_off"),
        F.col("e.tail").alias("end_seq"), F.col("e.tail_line").alias("end_line"), F.col("e.tail_off").alias("end_off"),
        none.alias("receiver"), none.alias("receiver_var"))
    return closed.unionByName(flat)


def _linked(toks: DataFrame) -> DataFrame:
    """Add the positions of following tokens and of the bracket that closes around each."""
    ahead = Window.partitionBy("path", "level").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    near = toks.withColumns({
        "after": F.lead("tok").over(in_file()), "after_seq": F.lead("seq").over(in_file()),
        "after_seq2": F.lead("seq", 2).over(in_file()), "after_off": F.lead("start_off").over(in_file()),
        "after_off2": F.lead("start_off", 2).over(in_file()),
        "before_off": F.lag("start_off").over(in_file()), "before_off2": F.lag("start_off", 2).over(in_file()),
    }).withColumn("colon", F.first(F.when(F.col("tok") == ":", F.struct("seq", "after_off")), ignorenulls=True).over(ahead))
    # the bracket around a token closes one level up: it joins that token's level as a mark
    marks = near.where(F.col("tok").isin(*CLOSE)).select("path", "seq", (F.col("level") + 1).alias("level"), F.col("seq").alias("mark"))
    both = near.withColumn("mark", F.lit(None).cast("int")).unionByName(marks, allowMissingColumns=True)
    return both.withColumn("shut_up", F.first("mark", ignorenulls=True).over(ahead)).where(F.col("mark").isNull()).drop("mark")


def enclosing(points: DataFrame, defs: DataFrame) -> DataFrame:
    """Definitions around each point (path, at), outermost first: adds ``around``.

    Positions are doubled token numbers, so a point can lie between two tokens.
    Both sides meet per bucket of positions.
    """
    width = BUCKET * 64
    laid = defs.select(
        "path", (F.col("seq") * 2).alias("lo"), (F.col("end_seq") * 2).alias("hi"),
        F.struct(F.col("seq").alias("seq"), F.col("id_name").alias("name"), F.col("kind").alias("kind"),
                 F.col("receiver").alias("receiver"), F.col("receiver_var").alias("receiver_var")).alias("d"))
    laid = laid.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    met = points.select("path", "at").distinct().withColumn("bucket", F.floor(F.col("at") / width)).join(
        laid, ["path", "bucket"]).where(F.col("at").between(F.col("lo"), F.col("hi")))
    around = met.groupBy("path", "at").agg(F.sort_array(F.collect_list("d")).alias("around"))
    return points.join(around, ["path", "at"], "left")


def scope_names(around: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(around, lambda d: d["name"]), none)


def make_id(path: Column, names: Column) -> Column:
    return F.when(F.size(names) == 0, path).otherwise(F.concat(path, F.lit("#"), F.array_join(names, ".")))


@dataclass
class Extracted:
    nodes: DataFrame
    raw_edges: DataFrame
    scratch: str

    def release(self) -> None:
        """Remove the token table once nodes and edges are stored."""
        from ..sources.files import open_root

        system, base = open_root(self.scratch)
        system.delete_dir(base)


def extract(files: DataFrame) -> Extracted:
    """Nodes and raw edges of ``files`` (path, content).

    The searchable body of a definition is whole.
    """
    from . import wiring

    # Token rows outweigh their files, so they are kept in compressed columns of
    # which each rule reads a few, and split by language.
    toks, scratch = store_table(_linked(tokens(files)), "lang")
    by_lang = {lang: toks.where(F.col("lang") == lang) for lang in LEXERS}
    finders = {"typescript": _ts_definitions, "python": _py_definitions, "go": _go_definitions}
    found = None
    for lang, find in finders.items():
        part = find(by_lang[lang], _ends(by_lang[lang])).withColumn("lang", F.lit(lang))
        found = part if found is None else found.unionByName(part)
    found = materialize(found.withColumn("id_name", F.when(F.col("receiver").isNotNull(), F.concat_ws(".", "receiver", "name")).otherwise(F.col("name"))))
    placed = enclosing(found.withColumn("at", F.col("seq") * 2 - 1), found)
    outer = scope_names(F.col("around"))
    parent_kind = F.try_element_at("around", F.lit(-1))["kind"]
    placed = materialize(placed.select(
        "path", "lang", "seq", "end_seq", "line", "end_line", "start_off", "end_off", "header_off", "name", "id_name",
        F.when((F.col("lang") == "python") & (F.col("kind") == "function") & (parent_kind == "class"), "method")
        .otherwise(F.col("kind")).alias("kind"),
        "receiver", "receiver_var", outer.alias("scope"),
        make_id(F.col("path"), F.array_append(outer, F.col("id_name"))).alias("id"),
        make_id(F.col("path"), outer).alias("parent"),
    ))
    exported = wiring.exports(toks, placed)
    return Extracted(_nodes(files, placed, exported), wiring.raw_edges(toks, placed), scratch)


def _nodes(files: DataFrame, placed: DataFrame, exported: DataFrame) -> DataFrame:
    defs = placed.join(exported, ["path", "seq"], "left")
    packed = defs.groupBy("path").agg(F.collect_list(F.struct(
        "seq", "id", "name", "kind", F.col("line").alias("start_line"), "end_line", "start_off", "end_off", "header_off",
        F.coalesce("exported", F.lit(False)).alias("exported"))).alias("defs"))
    supported = files.where(X.language_of(F.col("path")).isNotNull())
    joined = supported.select("path", "content").join(packed, "path", "left")
    one = joined.select("path", "content", F.explode("defs").alias("d")).select(
        F.col("d.id").alias("id"), F.col("d.name").alias("name"), F.col("d.kind").alias("kind"), "path",
        F.col("d.start_line").alias("start_line"), F.col("d.end_line").alias("end_line"),
        X.clean_signature(F.substring("content", F.col("d.start_off").cast("int"),
                                      (F.col("d.header_off") - F.col("d.start_off")).cast("int"))).alias("signature"),
        F.col("d.exported").alias("exported"),
        F.substring("content", F.col("d.start_off").cast("int"), (F.col("d.end_off") - F.col("d.start_off") + 1).cast("int")).alias("body"),
        (F.col("d.seq") + 1).cast("bigint").alias("ord"))
    symbols = one.select(
        "id", "name", "kind", "path", "start_line", "end_line", "signature", "exported", F.lit("ast").alias("origin"),
        X.content_hash(F.col("body")).alias("body_hash"), F.lit(None).cast("bigint").alias("chars"),
        X.collapse(F.col("body")).alias("body_text"), "ord")
    rest = file_residual(supported, symbols).select("path", "residual")
    file_rows = supported.join(rest, "path", "left").select(
        F.col("path").alias("id"), X.basename(F.col("path")).alias("name"), F.lit("file").alias("kind"), "path",
        F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), F.lit(None).cast("string").alias("signature"),
        F.lit(True).alias("exported"), F.lit("ast").alias("origin"), X.content_hash(F.col("content")).alias("body_hash"),
        F.length("content").cast("bigint").alias("chars"), F.coalesce("residual", F.lit("")).alias("body_text"),
        F.lit(0).cast("bigint").alias("ord"))
    none = F.lit(None)
    return file_rows.unionByName(symbols).withColumns({
        "summary_state": F.lit("pending"), "summary": none.cast("string"), "crux": none.cast("struct<code:string,span:string>")})


def file_residual(files: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines of each file outside every span, joined: (path, n_lines, residual).

    A line is covered when the running count of opened spans exceeds that of
    closed ones, so spans add two marks each and no line meets a span.
    """
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select(
        "path", (F.col("pos") + 1).alias("line"), "text", F.lit(0).alias("mark"))
    none = F.lit(None).cast("string")
    starts = spans.select("path", F.col("start_line").alias("line"), none.alias("text"), F.lit(1).alias("mark"))
    stops = spans.select("path", (F.col("end_line") + 1).alias("line"), none.alias("text"), F.lit(-1).alias("mark"))
    marks = lines.unionAll(starts).unionAll(stops)
    w = Window.partitionBy("path").orderBy("line", F.abs("mark").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_spans = marks.withColumn("open", F.sum("mark").over(w)).where(F.col("text").isNotNull() & (F.col("open") == 0))
    joined = open_spans.groupBy("path").agg(
        F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return joined.select("path", "n_lines", X.collapse(F.array_join(F.transform("l", lambda x: x["text"]), " ")).alias("residual"))
