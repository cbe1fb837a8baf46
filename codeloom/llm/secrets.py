"""Secret scans: fixed patterns, and Markov models of random strings and ordinary words.

The base patterns give spans of kinds ``assign``, ``access`` and ``hex``.  For
the rest, two first-order character models are counted: one from the values
that base spans hold, mixed half and half with a uniform choice, one from the
words of documents.  A long token whose log-likelihood ratio is high enough is
a span of kind ``random``, unless it touches a base span.

All of it is DataFrame functions inside the row, but for the two counts, which
read bounded samples: the values and the words of ``SAMPLE`` documents each,
those with the smallest hashes.  Null texts are empty.  Without secrets to
learn from, random strings are uniform; an empty table gives no rows.  Repeated
rows are scanned each.  Spans that begin together come in the order of their
kinds.  Work on one very long text grows almost as its length: running sums go
by pieces of the square root of the number of matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE = 2000
# Nats: of a whole token, and of each of its steps.
MIN_RATIO, MIN_STEP = 12.0, 0.5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, start: Column, op) -> Column:
    """``start`` and what ``op`` makes of it value by value; appending copies, so for short arrays only."""
    return F.aggregate(values, F.array(start), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))


def _scan(values: Column, op, zero: int) -> Column:
    """For every place of an integer array, ``op`` over the values up to it."""
    def pieces(v):
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(v) - 1, width), lambda i: F.slice(v, i + 1, width))

    def join(p):
        starts = _running(F.transform(p, lambda c: F.aggregate(c, F.lit(zero), lambda a, x: op(a, x))), F.lit(zero), op)
        return F.flatten(F.zip_with(p, F.slice(starts, 1, F.size(p)), lambda c, o: F.slice(_running(c, o, op), 2, F.size(c))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(pieces(v), join)).otherwise(v))


def _spans(pattern: str, value_group: int = 0) -> Column:
    """Start, end and value of the matches of ``pattern`` in ``t``, in code points."""
    # pieces between matches and matches alternate, so their lengths give the places
    zipped = F.arrays_zip(
        F.split("t", pattern, -1).alias("gap"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all("t", F.lit(pattern), F.lit(value_group)).alias("value"))
    short = F.transform(F.filter(zipped, lambda z: z["hit"].isNotNull()), lambda z: F.struct(
        F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("hit"), z["value"].alias("v")))
    found = _let(short, lambda h: F.zip_with(
        h, _scan(F.transform(h, lambda z: z["gap"] + z["hit"]), lambda a, x: a + x, 0),
        lambda z, e: F.struct((e - z["hit"]).alias("s"), e.alias("e"), z["v"].alias("v"))))
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")
    return F.when(F.col("t").rlike(pattern), found).otherwise(none)


def _with_base(documents: DataFrame) -> DataFrame:
    df = C.spread(C.only(documents, "doc_id", "text")).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return df.withColumns({
        "assign": F.filter(_spans(ASSIGN, 2), lambda x: F.length(x["v"]) >= 8),
        "access": _spans(ACCESS), "hex": _spans(HEX)})


def _steps(tokens: DataFrame) -> DataFrame:
    """How often one letter of the alphabet follows another: at most 67 * 67 rows."""
    pairs = tokens.select(F.explode(_let(F.split("v", ""), lambda c: F.transform(
        F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.get(c, i - 1).alias("a"), F.get(c, i).alias("b"))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").count()


def learn(documents: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios of every step, random against ordinary, row by row."""
    spans = F.concat("assign", "access", "hex").alias("spans")
    key = F.xxhash64("doc_id", "t")
    base = _with_base(documents).where(F.col("t").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")).select(key.alias("key"), spans)
    secret = C.smallest(base.where(F.size("spans") > 0).select(F.lit(0).alias("all"), "key", "spans.v"), ["all"], [F.col("key"), F.col("v")], sample)
    secret = secret.select(F.explode("v").alias("v"))
    thin = C.thinned(_with_base(documents), key, documents.count(), sample).select("t", key.alias("key"), spans)
    plain = thin.where(F.size("spans") == 0).orderBy("key", "t").limit(sample).select(
        F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("v"))
    size = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    tables = []
    for frame in (secret, plain):
        counts = [[0.5] * size for _ in range(size)]
        for a, b, n in _steps(frame.where(F.length("v") > 1)).collect():  # at most 67 * 67 rows
            if a in at and b in at:
                counts[at[a]][at[b]] += n
        tables.append([[x / sum(row) for x in row] for row in counts])
    return [math.log((0.5 * tables[0][i][j] + 0.5 / size) / tables[1][i][j]) for i in range(size) for j in range(size)]


def _ratio(token: Column, table: Column) -> Column:
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return _let(places, lambda p: F.aggregate(
        F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda a, i: a + F.get(table, F.get(p, i - 1) * len(ALPHABET) + F.get(p, i))))


def _untouched(tokens: Column, base: Column) -> Column:
    """The tokens that share no place with a base span: one sorted line of both, scanned from either end."""
    far = (1 << 31) - 1
    span = lambda x, k, v: F.struct(x["s"].alias("s"), k.alias("k"), x["e"].alias("e"), v.alias("v"))
    line = F.array_sort(F.concat(
        F.transform(base, lambda x: span(x, F.lit(0), F.lit(""))), F.transform(tokens, lambda x: span(x, F.lit(1), x["v"]))))

    def free(events):
        ends = F.transform(events, lambda x: F.when(x["k"] == 0, x["e"]).otherwise(F.lit(0)))
        starts = F.transform(events, lambda x: F.when(x["k"] == 0, x["s"]).otherwise(F.lit(far)))
        before, after = _scan(ends, F.greatest, 0), F.reverse(_scan(F.reverse(starts), F.least, far))
        found = F.filter(F.arrays_zip(events.alias("x"), before.alias("b"), after.alias("a")),
                         lambda z: (z["x"]["k"] == 1) & (z["b"] <= z["x"]["s"]) & (z["a"] >= z["x"]["e"]))
        return F.transform(found, lambda z: F.struct(z["x"]["s"].alias("s"), z["x"]["e"].alias("e"), z["x"]["v"].alias("v")))

    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(_let(line, free))


def scan(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    ratios = learn(documents, sample)
    table = F.expr("cast(split('" + ",".join(f"{x:.6f}" for x in ratios) + "', ',') as array<double>)")
    df = _with_base(documents).withColumn("tokens", _spans(TOKEN))

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(
            x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"),
            F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")).alias("name")))

    df = df.withColumn("base", F.array_sort(F.concat(*[tagged(k) for k in KINDS[:3]])))
    df = df.withColumn("free", _untouched(F.col("tokens"), F.col("base")))
    df = df.withColumn("free", F.transform("free", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _ratio(x["v"], table).alias("r"))))
    df = df.withColumn("random", F.filter("free", lambda x: (x["r"] >= MIN_RATIO) & (x["r"] >= MIN_STEP * (x["e"] - x["s"] - 1))))
    names = lambda a: F.array_join(F.transform(a, lambda x: x["name"]), ",")
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return df.select(
        "doc_id", size("assign"), size("access"), size("hex"), F.sha2(names(F.col("base")), 256).alias("base_sha256"),
        names(F.array_sort(F.concat("base", tagged("random")))).alias("spans"), size("random"))
