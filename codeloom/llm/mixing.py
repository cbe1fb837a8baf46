"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power of an exponent between 0
(all sources alike) and 1 (as they come), normalised.  The exponent is found by
bisection, several points a round: the smallest one at which no source would
be repeated more than ``MAX_REPEATS`` times, or, when an entropy is asked for,
the largest one that reaches it, if repetition allows.

Weights become rows by block permutations.  The tokens that a source shall
give are whole passes over it plus a rest.  For the rest the source is cut into
blocks by a hash of the row, so that a large source is many blocks; blocks come
in the order of another hash, and whole blocks are taken while they fit.  In the
one block that does not fit, rows are taken in the order of their hash while
they fit.  So no task ever holds a source.

All of it is DataFrame functions; a round of the bisection sums one row per
source.  A null source is a source of its own, apart from the empty one.  Null
and empty texts have no tokens and come once a pass.  Equal rows are counted
and their copies numbered, so each copy is scheduled on its own; the numbers
are dealt in runs of ``RUN`` copies to many tasks.  Very long texts count whole
and are never cut: one that does not fit in what is left is passed over.  Rows
of one hash are ordered by id, key and number.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import ordered_prefix
from ..session import store_table
from . import common as C

WORDS = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 4.0
ENTROPY = 0.95  # of the largest possible one
BLOCK_TOKENS = 200_000
RUN = 1024
POINTS, ROUNDS = 32, 6
SEED = 17


def _row_hashes(df: DataFrame) -> list[Column]:
    """``k1`` and ``k2`` over all columns; nulls and empty values differ."""
    at = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in df.dtypes]
    null = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in df.columns])
    return [F.xxhash64(null, *at).alias("k1"), F.hash(null, *at).alias("k2")]


def count_tokens(documents: DataFrame, whole: bool = False) -> DataFrame:
    """One narrow row per document: k1, k2, copy, doc_id, source, tokens.

    Rows that agree in id, source and text, or with ``whole`` in every column,
    share k1 and k2 and are told apart by ``copy``, from 0.
    """
    doc_id, source, text = (f"_c{documents.columns.index(c)}" for c in ("doc_id", "source", "text"))
    df = C.numbered(documents)
    df = C.spread(df if whole else df.select(doc_id, source, text))
    rows = df.select(
        *_row_hashes(df), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long").alias("tokens"))
    # equal rows combine before the shuffle; runs of their copies are then dealt out
    met, _ = store_table(rows.groupBy("k1", "k2", "doc_id", "source", "tokens").agg(F.count("*").alias("copies")))
    runs = met.withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {RUN})")))
    many = runs.where(f"copies > {RUN}").repartition("k1", "run")
    copy = F.explode(F.expr(f"sequence(run * {RUN}, least(copies, (run + 1) * {RUN}) - 1)")).alias("copy")
    return runs.where(f"copies <= {RUN}").unionByName(many).select("k1", "k2", copy, "doc_id", "source", "tokens")


def find_exponent(shares: DataFrame, budget: float, max_repeats: float = MAX_REPEATS, entropy: float | None = ENTROPY) -> float:
    """The exponent for one row per source of (tokens); only scalars reach the driver."""
    total = shares.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total["t"] or total["n"] < 2:
        return 1.0

    def measure(points: list[float]) -> list:
        """Per exponent: most passes over any source, and entropy as a part of the largest."""
        at = shares.select("tokens", F.explode(F.array(*[F.lit(x) for x in points])).alias("x")).withColumn(
            "w", F.pow(F.col("tokens") / F.lit(float(total["t"])), F.col("x")))
        sums = at.groupBy("x").agg(
            F.sum("w").alias("z"), F.max(F.col("w") / F.col("tokens")).alias("most"), F.sum(F.col("w") * F.log("w")).alias("wl"))
        return sums.select(
            "x", (F.col("most") / F.col("z") * F.lit(float(budget))).alias("repeats"),
            ((F.log("z") - F.col("wl") / F.col("z")) / F.log(F.lit(float(total["n"])))).alias("entropy")).orderBy("x").collect()

    def bisect(good) -> tuple[float, float]:
        """Where ``good``, which holds from some exponent on, begins."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            points = [lo + (hi - lo) * i / POINTS for i in range(POINTS + 1)]
            rows = measure(points)
            yes = [r["x"] for r in rows if good(r)]
            no = [r["x"] for r in rows if not good(r)]
            if not yes:
                return 1.0, 1.0
            if not no:
                return lo, lo
            lo, hi = max(no), min(yes)
        return lo, hi

    least = bisect(lambda r: r["repeats"] <= max_repeats)[1]
    if entropy is None:
        return least
    # entropy falls as the exponent grows
    return max(least, bisect(lambda r: r["entropy"] < entropy)[0])


def plan_weights(rows: DataFrame, budget: float | None, max_repeats: float, entropy: float | None) -> tuple[DataFrame, float]:
    """(source, source_tokens, weight, quota, passes, rest), exponent."""
    by_source = rows.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("source_rows"))
    by_source, _ = store_table(by_source)
    total = by_source.agg(F.sum("source_tokens").alias("t")).first()["t"] or 0
    budget = float(total if budget is None else budget)
    alive = by_source.where("source_tokens > 0").select(F.col("source_tokens").alias("tokens"))
    x = find_exponent(alive, budget, max_repeats, entropy)
    raw = F.when(F.col("source_tokens") > 0, F.pow(F.col("source_tokens") / F.lit(float(max(total, 1))), F.lit(x))).otherwise(0.0)
    weighed = by_source.withColumn("w", raw)
    z = weighed.agg(F.sum("w").alias("z")).first()["z"] or 1.0
    quota = F.least(F.col("w") / F.lit(z) * F.lit(budget), F.col("source_tokens") * F.lit(max_repeats))
    passes = F.when(F.col("source_tokens") > 0, F.floor(F.col("quota") / F.col("source_tokens") + F.lit(1e-9)).cast("int")).otherwise(1)
    return weighed.withColumn("quota", quota).withColumn("passes", passes).select(
        "source", "source_tokens", (F.col("w") / F.lit(z)).alias("weight"), "quota", "passes",
        F.greatest(F.lit(0.0), F.col("quota") - F.col("passes") * F.col("source_tokens")).alias("rest"),
        F.ceil(F.col("source_tokens") / F.lit(BLOCK_TOKENS)).cast("long").alias("blocks")), x


def _hash(seed: int) -> Column:
    return F.xxhash64("k1", "k2", "copy", "doc_id", F.lit(seed))


def schedule(documents: DataFrame, budget: float | None = None, max_repeats: float = MAX_REPEATS,
             entropy: float | None = ENTROPY, whole: bool = False) -> DataFrame:
    """One row per document and pass that it is taken in: doc_id, source, tokens, epoch, block, place, weight, k1, k2, copy.

    ``epoch`` counts passes from 0, ``block`` and ``place`` order the rows of a pass.
    """
    rows, _ = store_table(count_tokens(documents, whole))
    sources, _ = store_table(plan_weights(rows, budget, max_repeats, entropy)[0])
    df = rows.alias("r").join(sources.alias("s"), F.expr("r.source <=> s.source")).drop(F.col("s.source"))
    df = df.withColumn("block", F.pmod(_hash(SEED), F.greatest(F.col("blocks"), F.lit(1))))
    out = ["doc_id", "source", "tokens", "epoch", "block", "weight", "k1", "k2", "copy"]
    passes = df.where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).select(*out)
    # blocks of the last, partial pass in the order of their hash; one row per block, no task holds a source's
    rest = df.where("rest > 0")
    blocks = rest.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"), F.first("rest").alias("rest"))
    order = [F.col("source"), F.xxhash64("source", "block", F.lit(SEED + 1)), F.col("block")]
    blocks = ordered_prefix(blocks, order, "block_tokens").drop("pos")
    before = blocks.groupBy(F.col("source").alias("of")).agg(F.min(F.col("run") - F.col("block_tokens")).alias("before"))
    blocks = blocks.join(before, F.expr("source <=> of")).withColumn(
        "room", F.col("rest") - (F.col("run") - F.col("before") - F.col("block_tokens"))).where("room > 0")
    blocks = blocks.select(F.col("source").alias("of"), F.col("block").alias("b"), "block_tokens", "room")
    part = rest.join(blocks, F.expr("source <=> of AND block = b")).withColumn("epoch", F.col("passes"))
    full = part.where("block_tokens <= room").select(*out)
    inside = Window.partitionBy("source", "block").orderBy(_hash(SEED + 2), "doc_id", "k1", "k2", "copy").rowsBetween(
        Window.unboundedPreceding, 0)
    cut = part.where("block_tokens > room").withColumn("upto", F.sum("tokens").over(inside)).where("upto <= room").select(*out)
    return passes.unionByName(full).unionByName(cut).withColumn(
        "place", F.xxhash64("k1", "k2", "copy", "doc_id", "epoch", F.lit(SEED + 3)))


def report(documents: DataFrame) -> DataFrame:
    return schedule(documents).drop("k1", "k2", "copy")


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The scheduled rows with all columns of their documents, plus mix_epoch, mix_block and mix_place.

    Columns of these names in the input give way.  Rows that are equal in every
    column stand for each other: one of them meets the places of all.
    """
    mix = {"epoch": "mix_epoch", "block": "mix_block", "place": "mix_place"}
    plan = schedule(documents, whole=True, **how).select("k1", "k2", *[F.col(c).alias(m) for c, m in mix.items()])
    keep = [i for i, c in enumerate(documents.columns) if c not in mix.values()]
    rows = C.numbered(documents)
    once = rows.select("*", *_row_hashes(rows)).dropDuplicates(["k1", "k2"])
    found = once.join(plan, ["k1", "k2"])
    return found.select(*[f"_c{i}" for i in keep], *mix.values()).toDF(*[documents.columns[i] for i in keep], *mix.values())
