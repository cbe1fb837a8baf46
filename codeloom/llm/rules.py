"""Quality rules with risk-controlled thresholds.

Each rule is a share between 0 and 1 that junk drives up.  Cutoffs are not set
by hand.  Labelled good documents are halved by a checksum of their id.  In
each stratum (language) the first half gives a ladder of candidates: for each
strictness ``q`` and rule, the value that a share ``q`` of good documents
exceeds.  The second half judges a whole rung, all rules together: with ``k``
of ``n`` good documents rejected, the rung is safe if an exact binomial test
refutes a false-rejection rate above ``RISK`` at level ``LEVEL``, divided by
the number of strata and rungs tested.  The strictest safe rung is used.  A
stratum without a safe rung rejects nothing beyond the base rules.

All of it is DataFrame functions.  A null text has no words; a null language is
a stratum of its own; rows without id or label take no part in the
calibration; of several labels of an id the best counts.  Equal rows get equal
verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store_table
from . import common as C

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RISK = 0.05
SALTS = 16
LEVEL = 0.05
LADDER = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02)
RULES = ("symbol_share", "dup_line_share", "repeat_share", "capital_share", "bang_share")
MIN_WORDS = 50


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(documents: DataFrame, *keep: str) -> DataFrame:
    """The kept columns plus counts and rule values of every row, inside the row."""
    df = C.only(documents, *keep, *([] if "text" in keep else ["text"])).withColumn("t", F.coalesce("text", F.lit("")))
    df = df.withColumn("words", F.filter(F.split("t", SPACE + "+"), lambda w: w != ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.length(_without(x, SPACES)) > 0))
    grams = F.when(F.size("words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    df = df.select(
        *keep, F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(_without(F.col("t"), CAPITALS))).alias("n_capitals"),
        (F.length("t") - F.length(_without(F.col("t"), "!"))).alias("n_bangs"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("grams"))
    # only texts that repeat a window need to know where
    repeats = F.size("grams") > F.size(F.array_distinct("grams"))
    df = df.withColumn("sorted", F.when(repeats, F.sort_array(
        F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, j: F.coalesce(F.get("sorted", j)["h"] == x["h"], F.lit(False))
    df = df.withColumn("at", F.sort_array(F.transform(
        F.filter("sorted", lambda x, j: twin(x, j + 1) | ((j > 0) & twin(x, F.greatest(j - 1, F.lit(0))))), lambda x: x["i"])))
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    share = lambda a, b: F.coalesce(F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4), F.lit(0.0))
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_capitals", "word_chars").alias("capital_share"),
        share("n_bangs", "word_chars").alias("bang_share"))


def tail_probability(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X with ``n`` trials of chance ``p``; 1 when k is beyond n * p."""
    first = n * F.log(F.lit(1 - p))
    more = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))),
        F.struct(first.alias("l"), F.exp(first).alias("s")),
        lambda a, i: F.struct(
            (a["l"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))).alias("l"),
            (a["s"] + F.exp(a["l"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p))))).alias("s")),
        lambda a: a["s"])
    return F.when(k > n * p, 1.0).when(k == 0, F.exp(first)).otherwise(more)


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per stratum with a safe rung: stratum, q, one cutoff per rule."""
    best = C.only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = measured.where(~F.col("base_failed")).join(best.where("quality = 1"), "doc_id").select(
        F.coalesce("lang", F.lit("und")).alias("stratum"), "doc_id", *RULES,
        F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)).alias("half"))
    # shares have four places, so a percentile keeps at most 10,001 counts
    at = F.array(*[F.lit(1 - q) for q in LADDER])
    rungs = good.where("half = 0").groupBy("stratum").agg(*[F.percentile(r, at).alias(r) for r in RULES])
    rungs = rungs.select("stratum", F.posexplode(F.arrays_zip(*RULES)).alias("rung", "c")).select(
        "stratum", "rung", *[F.col(f"c.{r}").alias(f"cut_{r}") for r in RULES])
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (F.col(r) > F.col(f"cut_{r}"))
    # a language may hold most rows, so its rungs are dealt to several tasks
    dealt = good.where("half = 1").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    rungs = rungs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = dealt.join(rungs, ["stratum", "salt"]).groupBy("stratum", "rung").agg(
        F.count("*").alias("n"), F.sum(rejected.cast("long")).alias("k"),
        *[F.first(f"cut_{r}").alias(f"cut_{r}") for r in RULES])
    tests = judged.agg(F.count("*").alias("tests")).first()["tests"]
    safe = judged.withColumn("p", tail_probability(F.col("k"), F.col("n"), risk)).where(F.col("p") <= level / max(1, tests))
    last = Window.partitionBy("stratum").orderBy(F.desc("rung"))  # as many rows as there are rungs
    return safe.withColumn("r", F.row_number().over(last)).where("r = 1").select("stratum", "rung", *[f"cut_{r}" for r in RULES])


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept, and the rung that was used, for every row."""
    measured, _ = store_table(measure(C.spread(C.only(documents, "doc_id", "text", "lang")), "doc_id", "lang"))
    cuts = calibrate(measured, labels)
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return measured.withColumn("stratum", F.coalesce("lang", F.lit("und"))).join(cuts, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"), "rung")
