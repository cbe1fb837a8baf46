"""Conversation prefix trie: which conversations begin with the same turns.

A node is a distinct sequence of first turns; its members are the conversations
that begin so.  Texts never leave the task that reads them: a turn travels as
two 64-bit hashes of its role and text and the length of its text.

1. Turns are put in order by range partitions, so one conversation of any length
   spreads over blocks.  The digest of a prefix is the exclusive or of its turns,
   each hashed with its place: first inside blocks, then over blocks.
2. Screening.  A count-min sketch of four rows counts the digests of all
   prefixes.  Its estimate is never too small, so a prefix with estimate one
   belongs to one conversation; such tails are finished where they are.  Only
   whether a counter passed one is kept, a bit each.  The sketch has four or
   more counters for each prefix and row up to ``SKETCH_BITS``; beyond that more
   prefixes are grouped exactly than need be, and nothing else changes.
3. Only prefixes that may be shared are shuffled and grouped by their digest.
4. Sums over subtrees.  Every node is charged to its smallest member.  A
   conversation is the smallest member of its prefixes from some depth on, so it
   gives one total to the prefixes above that depth, and running sums below it.

Nulls in role or text are empty; rows without ``conv_id`` are ignored; an empty
table has no nodes.  Turns come in the order of (turn, role, text), null turns
first; equal rows are turns of their own.  Long texts are hashed whole.  Digests
are equal for equal sequences; others differ up to 128-bit collisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, store_table
from . import common as C
from .components import stored

# Counters in a row of the sketch: four rows of at most these, a bit each, are broadcast, 16 megabytes.
SKETCH_ROWS, SKETCH_BITS, LEAST_BITS = 4, 1 << 25, 1 << 16
# Ids that are joined to one string before they reach the task that hashes them.
CHUNK_BITS = 12
NOTHING = hashlib.sha256(b"").hexdigest()


# --------------------------------------------------------------------------
# order


def _keep_tied_texts(tied):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = tied.value
        for batch in batches:
            maybe = pa.array(C.in_bitmap(bits, np.asarray(batch.column("key")).astype(C.U)))
            text = pc.if_else(maybe, batch.column("text"), pa.scalar(None, batch.column("text").type))
            names = ["conv_id", "turn", "role", "t1", "t2", "size"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), text], names=[*names, "text"])

    return run


def _blocks_of_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, mono, t1, t2, size): turns in order of ``mono``; a block is one range partition.

    A text travels only where turn and role do not decide the order.
    """
    spark = conversations.sparkSession
    turns = C.only(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null").withColumns({
        "role": F.coalesce(F.col("role"), F.lit("")), "text": F.coalesce(F.col("text"), F.lit(""))})
    slim = turns.select(
        "conv_id", "turn", "role", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"),
        F.length("text").cast("long").alias("size"), "text", F.xxhash64("conv_id", "turn", "role").alias("key"))
    tied = slim.groupBy("key").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).where("lo <> hi")
    kinds = dict(slim.dtypes)
    kept = slim.mapInArrow(
        _keep_tied_texts(C.broadcast(spark, C.bitmap_of(tied, "key"))),
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, t1 long, t2 long, size long, text string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "t1", "nth"]  # equal rows are told apart by a number
    return materialize(
        kept.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select("conv_id", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("mono"), "t1", "t2", "size"))


def _running(rows: DataFrame, value: list[str], combine: str, backwards: bool = False) -> DataFrame:
    """Running sums or exclusive ors of ``value`` along ``r`` within a conversation, this row included."""
    sign = -1 if backwards else 1
    agg = {"xor": F.bit_xor, "sum": F.sum}[combine]
    inside = Window.partitionBy("conv_id", "block").orderBy(sign * F.col("r"))
    before = Window.partitionBy("conv_id").orderBy(sign * F.col("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy("conv_id", "block").agg(*[agg(v).alias(v) for v in value])
    shift = total.select("conv_id", "block", *[F.coalesce(agg(v).over(before), F.lit(0)).alias(f"{v}_0") for v in value])
    local = rows.withColumns({v: agg(v).over(inside) for v in value}).join(shift, ["conv_id", "block"])
    both = {v: F.col(v).bitwiseXOR(F.col(f"{v}_0")) if combine == "xor" else F.col(v) + F.col(f"{v}_0") for v in value}
    return local.withColumns(both).drop(*[f"{v}_0" for v in value])


def in_order(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, block, r, t1, t2, size), numbered from 1, and conversations (conv_id, total)."""
    placed = _blocks_of_turns(conversations)
    count = placed.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.min("mono").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = stored(count.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    turns = placed.join(start, ["conv_id", "block"]).select(
        "conv_id", "block", (F.col("before") + F.col("mono") - F.col("first") + 1).alias("r"), "t1", "t2", "size")
    return turns, start.groupBy("conv_id").agg(F.sum("n").alias("total"))


def rebuilt(conversations: DataFrame, every: int = 100, up_to: int = 5) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations whose first turns are those of another one.

    Conversation c takes the first h turns of c - c % ``every``, all if it has
    fewer and none if it is absent, and goes on with its own after its first h;
    h is the checksum of c's digits modulo ``up_to + 1``.
    """
    turns, convs = in_order(conversations)
    turns = stored(turns)
    head = turns.where((F.col("conv_id") % every == 0) & (F.col("r") <= up_to)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("r", "t1", "t2", "size"))).alias("head"))  # ``up_to`` turns at most
    own = convs.select(
        "conv_id", F.col("total").alias("n"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % (up_to + 1)).cast("int").alias("h"))
    facts = stored(
        own.join(head, "base", "left").withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))))
        .withColumn("m", F.coalesce(F.array_size("head"), F.lit(0)))
        .select("conv_id", "h", "m", "head", (F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("total")))
    copied = facts.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.lit(-1).alias("block"), "t.*")
    rest = turns.join(facts.drop("head"), "conv_id").where("r > h").select(
        "conv_id", "block", (F.col("r") - F.col("h") + F.col("m")).alias("r"), "t1", "t2", "size")
    return copied.union(rest), facts.select("conv_id", "total")


# --------------------------------------------------------------------------
# screening


def _cells(d1: Column, d2: Column, width: int) -> list[Column]:
    """The counters of a digest: a stretch of its bits for every row of the sketch."""
    pieces = [d1, F.shiftrightunsigned(d1, 32), d2, F.shiftrightunsigned(d2, 32)]
    return [p.bitwiseAND(width - 1) + j * width for j, p in enumerate(pieces)]


def _estimate_passes_one(bits: np.ndarray, width: int, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    out = np.ones(len(d1), dtype=bool)
    for j, p in enumerate((d1, d1 >> C.U(32), d2, d2 >> C.U(32))):
        out &= C.in_bitmap(bits, (p & C.U(width - 1)) + C.U(j * width))
    return out


def _screen(sketch, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        for batch in batches:
            col = {c: np.asarray(batch.column(c)).view(C.U) for c in ("d1", "d2", "p1", "p2")}
            shared = _estimate_passes_one(bits, width, col["d1"], col["d2"])
            above = _estimate_passes_one(bits, width, col["p1"], col["p2"]) | (np.asarray(batch.column("r")) == 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(above), pa.array(shared)], names=[*batch.schema.names, "shared_above", "shared"])

    return run


def _screened(turns: DataFrame, convs: DataFrame, bits: int) -> DataFrame:
    """A row for every prefix of every conversation with its digest, its parent's, and whether each may be shared."""
    spark = turns.sparkSession
    own = turns.withColumns({"g1": F.xxhash64("r", "t1", "t2"), "g2": F.xxhash64("t2", "t1", "r")}).withColumns({"d1": F.col("g1"), "d2": F.col("g2")})
    rows = _running(stored(own.drop("t1", "t2")), ["d1", "d2"], "xor").join(convs, "conv_id")
    rows = stored(rows.select(
        "conv_id", "block", "r", "d1", "d2", F.col("d1").bitwiseXOR(F.col("g1")).alias("p1"),
        F.col("d2").bitwiseXOR(F.col("g2")).alias("p2"), "size", "total"))
    n, width = rows.count(), LEAST_BITS
    while width < min(4 * n, bits):
        width *= 2
    cells = rows.select(F.explode(F.array(*_cells(F.col("d1"), F.col("d2"), width))).alias("cell"))
    twice = cells.groupBy("cell").count().where("count > 1")
    sketch = C.broadcast(spark, C.bitmap_of(twice, "cell", SKETCH_ROWS * width))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return store_table(rows.mapInArrow(_screen(sketch, width), f"{schema}, shared_above boolean, shared boolean"), "shared")[0]


# --------------------------------------------------------------------------
# nodes


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined parts of every digest, from rows in order; holds one state at a time."""
    key, state = None, None
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for d1, d2, part in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "part"))):
            if key != (d1, d2):
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (d1, d2), hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
        yield _hashes(out)
    if key is not None:
        yield _hashes([(*key, state.hexdigest())])


def _hashes(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["d1", "d2", "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of the conversations that end in each prefix, in numeric order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["d1", "d2", "conv_id"]
    placed = materialize(rows.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)))
    joined = placed.groupBy("d1", "d2", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("part"))
    return joined.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "chunk").mapInArrow(
        _hash_runs, "d1 long, d2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Nodes of ``turns(conv_id, block, r, t1, t2, size)`` and ``convs(conv_id, total)``.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    rows = _screened(turns, convs, sketch_bits)
    tails = rows.where("not shared")
    roots = convs.select(
        "conv_id", F.lit(-2).alias("block"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), F.lit(0).cast("long").alias("size"), "total")
    members = rows.where("shared").select(*roots.columns).union(roots)
    nodes = stored(
        members.groupBy("d1", "d2").agg(
            F.min(F.struct("conv_id", "block")).alias("least"), F.count("*").alias("n_convs"), F.max("total").alias("deepest"),
            *[F.min(c).alias(c) for c in ("r", "p1", "p2", "size")])
        .select("d1", "d2", "p1", "p2", "least.*", "r", "n_convs", (F.col("deepest") == F.col("r")).alias("leaf"),
                ((F.col("n_convs") - 1) * F.col("size")).alias("gain")))
    # of every conversation: from which depth on it is the smallest member, what its nodes gain, whether it stands for a leaf
    facts = (
        nodes.select("conv_id", "r", "gain", F.col("leaf").cast("long").alias("leaf"))
        .union(tails.select("conv_id", "r", F.lit(0).cast("long"), (F.col("r") == F.col("total")).cast("long")))
        .groupBy("conv_id").agg(F.min("r").alias("own"), F.sum("gain").alias("all_gain"), F.max("leaf").alias("is_leaf")))
    under = members.select("conv_id", "r", "d1", "d2").join(facts, "conv_id").groupBy("d1", "d2").agg(
        F.sum("is_leaf").alias("n_leaves"), F.sum(F.when(F.col("r") < F.col("own"), F.col("all_gain")).otherwise(0)).alias("below"))
    along = _running(nodes.select("d1", "d2", "conv_id", "block", "r", "gain"), ["gain"], "sum", backwards=True).select("d1", "d2", F.col("gain").alias("along"))
    ends = _ends(members.where("r = total"))
    heads = tails.where("shared_above").select("p1", "p2")
    children = nodes.where("p1 is not null").select("p1", "p2").union(heads).groupBy("p1", "p2").count().select(
        F.col("p1").alias("d1"), F.col("p2").alias("d2"), F.col("count").alias("n_children"))
    parent = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent"))
    shared = (
        nodes.join(under, ["d1", "d2"]).join(along, ["d1", "d2"]).join(ends, ["d1", "d2"], "left").join(children, ["d1", "d2"], "left")
        .join(parent, ["p1", "p2"], "left")
        .select(
            "conv_id", F.col("r").alias("depth"), F.when(F.col("r") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", (F.col("along") + F.col("below")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")))

    def tail(df: DataFrame, parent_id: str) -> DataFrame:
        last = F.col("r") == F.col("total")
        one = F.lit(1).cast("long")
        return df.select(
            "conv_id", F.col("r").alias("depth"), F.col(parent_id).alias("parent_conv_id"), one.alias("n_convs"),
            F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
            F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"))

    first = tails.where("shared_above").join(parent, ["p1", "p2"])
    return shared.union(tail(tails.where("not shared_above"), "conv_id")).union(tail(first, "parent"))


def report(conversations: DataFrame) -> DataFrame:
    return trie(*rebuilt(conversations))
