"""Personalized PageRank over links that are packed in square blocks.

Nodes are dealt over blocks by a hash.  All links of a block's nodes lie in one
bucket of a table, as arrays of positions, one row per block at the other end.
A step sends one array of numbers from block to block: a sum for each node there
that has at least as many links between the two blocks as its neighbour, and else
the neighbour's own value.  Both ends know which, so numbers move without a key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import walk_edges
from ..session import checkpoint_dir, drop_files, dropping_shuffles
from .adjacency import write_bucketed

# Links of one block, each counted at both of its ends.
LINKS_PER_BLOCK = 6_000_000
# Below that, links for which a further block is worth a task.
LINKS_PER_TASK = 200_000
# Rounds in which all blocks are packed, so that their links are not all in shuffle files at once.
ROUNDS = 4

POSITIONS = ["out_src", "out_rank", "send", "in_push", "in_dst", "in_rank"]
# Numbers, one per end of a link and step at most, that steps may leave on disk before these are stored and the others dropped.
NUMBERS_KEPT = 20_000_000

ASCENDING = {"out_src", "send", "in_push", "in_dst"}  # stored as differences, which are small
PACKED = "key long, block int, other int, nodes binary, degree binary, out_n int, " + ", ".join(f"{c} binary" for c in POSITIONS)
SENT = "key long, other int, n long, w double, q double, values binary"
SEED, KEPT, OWN = -1, -2, -1


@dataclass
class Blocks:
    ids: DataFrame      # id, n, group columns
    packed: DataFrame   # see ``PACKED``, in buckets of the key
    keys: list[int]     # the key of each block, which falls into the bucket of the same number
    seed: int           # of the numbers
    by: list[str]       # no link leaves a group of these
    ends: int           # links, each counted at both of its ends

    def linked(self) -> DataFrame:
        """(n) of all nodes with links."""
        return self.packed.where(F.col("other") == OWN).select("nodes").mapInArrow(_numbers, "n long")


def _numbers(batches):
    for batch in batches:
        for nodes in batch.column("nodes"):
            yield pa.RecordBatch.from_arrays([pa.array(_array(nodes, np.int64))], ["n"])


def _array(cell, dtype) -> np.ndarray:
    buffer = cell.as_buffer()
    return np.frombuffer(buffer, dtype) if buffer is not None and buffer.size else np.empty(0, dtype)


def id_hash(id_: Column, seed: int) -> Column:
    return F.when(id_.isNotNull(), F.xxhash64(F.lit(seed), id_))


def hashed(nodes: DataFrame, at: str, by: list[str]) -> tuple[DataFrame, int]:
    """(id, n, group columns) of distinct nodes, stored, and the seed of a hash ``n`` that tells all of them apart."""
    spark, seed, rest = nodes.sparkSession, 0, [F.min(c).alias(c) for c in by]
    while True:
        ids = nodes.where("id IS NOT NULL").select(id_hash(F.col("id"), seed).alias("n"), "id", *by)
        (ids.groupBy("n", "id").agg(*rest) if by else ids.distinct()).write.mode("overwrite").parquet(at)
        ids = spark.read.parquet(at)
        if ids.groupBy("n").count().where("count > 1").isEmpty():
            return ids, seed
        seed += 1


def _block(n: Column, parts: int) -> Column:
    return F.pmod(F.hash(n), F.lit(parts))


def _keys(spark: SparkSession, parts: int) -> list[int]:
    """For each bucket the smallest number that falls into it."""
    found = {r["b"]: r["key"] for r in spark.range(parts * 40).groupBy(_block(F.col("id"), parts).alias("b")).agg(F.min("id").alias("key")).collect()}
    return [found[b] for b in range(parts)]


def _key(n: Column, keys: list[int]) -> Column:
    return F.get(F.array(*[F.lit(k).cast("long") for k in keys]), _block(n, len(keys)))


def build(nodes: DataFrame, edges: DataFrame, at: str, by: list[str] | None = None) -> Blocks | None:
    """Pack the walk edges between ``nodes`` below ``at``; None if so many meet in a node that its block would not be bounded."""
    with dropping_shuffles(nodes.sparkSession):
        return _build(nodes, edges, at, by or [])


def _build(nodes: DataFrame, edges: DataFrame, at: str, by: list[str]) -> Blocks | None:
    spark = nodes.sparkSession
    ids, seed = hashed(nodes, f"{at}/ids", by)
    inside = walk_edges(edges).select(id_hash(F.col("source"), seed).alias("a"), id_hash(F.col("target"), seed).alias("b"))
    for end in ("b", "a"):
        last, before = end == "a", f"{at}/known_b"
        inside = inside.join(ids.select(F.col("n").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in by]), end, "inner" if by else "left_semi")
        for c in by if last else []:
            inside = inside.where(F.col(f"a_{c}") == F.col(f"b_{c}"))
        to = f"{at}/inside" if last else before
        (inside.select("a", "b") if last else inside).write.mode("overwrite").parquet(to)
        inside = spark.read.parquet(to)
    drop_files(spark, before)

    cores, ends = spark.sparkContext.defaultParallelism, 2 * inside.count()
    parts = min(cores, ends // LINKS_PER_TASK + 1)
    if ends > cores * LINKS_PER_BLOCK:
        parts = cores * -(-ends // (cores * LINKS_PER_BLOCK))
    both = inside.select(F.inline(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))
    most = both.groupBy(_block(F.col("src"), parts).alias("block")).count().agg(F.max("count")).first()[0] or 0
    if most > 2 * LINKS_PER_BLOCK:
        drop_files(spark, f"{at}/inside")
        return None
    keys = _keys(spark, parts)
    rounds = max(1, min(ROUNDS, parts // cores))
    for i in range(rounds):
        now = both.where(_block(F.col("src"), parts) % rounds == i)
        rows = now.select(_key(F.col("src"), keys).alias("key"), "src", "dst", _block(F.col("dst"), parts).alias("other"))
        packed = rows.repartition(parts, "key").groupBy("key").applyInArrow(_packer(keys), PACKED)
        table = write_bucketed(packed, f"{at}/blocks", ["key"], parts, "append" if i else "overwrite")
    drop_files(spark, f"{at}/inside")
    return Blocks(ids, table, keys, seed, by, ends)


def _packer(keys: list[int]):
    place = {k: b for b, k in enumerate(keys)}

    def pack(key, links):
        """The rows of one block: its nodes, then its links with each other block."""
        own, far, other = (links[c].to_numpy() for c in ("src", "dst", "other"))
        nodes, own = np.unique(own, return_inverse=True)
        me = {"key": key[0].as_py(), "block": place[key[0].as_py()]}
        rows = [{**me, "other": OWN, "nodes": nodes.tobytes(), "degree": np.bincount(own).astype(np.int32).tobytes()}]
        order = np.lexsort((far, own, other))
        found, starts = np.unique(other[order], return_index=True)
        for j, at in zip(found.tolist(), np.split(order, starts[1:])):
            mine, u = np.unique(own[at], return_inverse=True)
            _, v = np.unique(far[at], return_inverse=True)
            here, there = np.bincount(u)[u], np.bincount(v)[v]  # links of both ends of each link
            summed, fetched = there >= here, here < there  # the sum is made before it is sent; the far value is taken in
            targets, out_rank = np.unique(v[summed], return_inverse=True)
            _, in_rank = np.unique(v[fetched], return_inverse=True)
            arrays = {
                "out_src": mine[u[summed]], "out_rank": out_rank, "send": mine[np.unique(u[~summed])],
                "in_push": mine[np.unique(u[~fetched])], "in_dst": mine[u[fetched]], "in_rank": in_rank}
            rows.append({**me, "other": j, "out_n": len(targets), **{c: _coded(c, a) for c, a in arrays.items()}})
        return pa.Table.from_pylist(rows, schema=_schema(PACKED))

    return pack


def _coded(name: str, a: np.ndarray) -> bytes:
    return (np.diff(a, prepend=0) if name in ASCENDING else a).astype(np.int32).tobytes()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def teleport(q, step: int, alpha: float):
    """Share of the seed weights that returns to the seeds at ``step``; a number or an array."""
    power = q ** float(step + 1)
    return alpha * (1 - power) / (1 - q) + power


def _stepper(keys: list[int], step: int, last: int, alpha: float, q: float | None):
    """One step in one block.

    With one ``q`` for all seeds their weight walks alone and each step's share of
    the outcome is kept in the block; so in a graph of two sides only one side has
    numbers to send.  With a ``q`` per group the seeds are fed again in each step.
    """

    def walk(key, mine, come):
        at = {j: i for i, j in enumerate(mine["other"].to_pylist())}

        def part(name, j, dtype=np.int32):
            a = _array(mine[name][at[j]], dtype)
            return np.cumsum(a, dtype=dtype) if name in ASCENDING else a

        nodes = part("nodes", OWN, np.int64)
        x, kept, to, values = np.zeros(len(nodes)), np.zeros(len(nodes)), [], []
        sender = come["other"].to_numpy()
        seeds = come.filter(pa.array(sender == SEED))
        if seeds.num_rows:
            home = seeds["w"].to_numpy()
            if step and q is None:
                home = home * teleport(seeds["q"].to_numpy(), step - 1, alpha)
            x[np.searchsorted(nodes, seeds["n"].to_numpy())] += home
        for i in np.flatnonzero(sender != SEED).tolist():
            j, sent = int(sender[i]), _array(come["values"][i], np.float64)
            if j == KEPT:
                kept = sent
                continue
            pushed = part("in_push", j)
            to += [pushed, part("in_dst", j)]
            values += [sent[:len(pushed)], sent[len(pushed):][part("in_rank", j)]]
        if to:
            x += np.bincount(np.concatenate(to), np.concatenate(values), minlength=len(nodes))
        if q is not None:
            kept = kept + x * (1.0 if step == last else teleport(q, last - 1 - step, alpha))
        if step == last:
            r = x if q is None else kept
            some = np.flatnonzero(r)
            return pa.table({"n": nodes[some], "r": r[some]})
        out = []
        me = mine["block"][0].as_py()
        if q is not None and kept.any():
            out.append({"key": key[0].as_py(), "other": KEPT, "values": kept.tobytes()})
        if x.any():
            x = (1 - alpha) * x / part("degree", OWN)
            for j in at:
                if j != OWN:
                    summed = np.bincount(part("out_rank", j), x[part("out_src", j)], minlength=mine["out_n"][at[j]].as_py())
                    sent = np.concatenate([summed, x[part("send", j)]])
                    if sent.any():
                        out.append({"key": keys[j], "other": me, "values": sent.tobytes()})
        return pa.Table.from_pylist(out, schema=_schema(SENT))

    return walk


def ranks(blocks: Blocks, start: DataFrame, alpha: float, iterations: int, q: float | None, at: str | None = None) -> DataFrame:
    """(n, r) of all nodes that the walk reaches from ``start`` (n, w, q); with one ``q`` for all, as a number.

    Where links are many, what a step sends is stored below ``at`` until a later
    step is stored, so disk holds the numbers of a few steps and not of all.
    The result reads those stored last.
    """
    spark, every, before = start.sparkSession, max(1, NUMBERS_KEPT // max(blocks.ends, 1)), None
    at = at or f"{checkpoint_dir(spark)}/steps/{uuid.uuid4().hex}"
    seeds = start.select(
        _key(F.col("n"), blocks.keys).alias("key"), F.lit(SEED).alias("other"), "n", "w", "q", F.lit(None).cast("binary").alias("values"))
    come = seeds
    for step in range(iterations + 1):
        walk = _stepper(blocks.keys, step, iterations, alpha, q)
        met = blocks.packed.groupBy("key").cogroup(come.groupBy("key"))
        come = met.applyInArrow(walk, SENT if step < iterations else "n long, r double")
        if (step + 1) % every == 0 and step < iterations:
            to = f"{at}/{step}"
            with dropping_shuffles(spark):
                come.write.mode("overwrite").parquet(to)
            come = spark.read.schema(SENT).parquet(to)
            if before:
                drop_files(spark, before)
            before = to
        if q is None and step < iterations:
            come = come.unionAll(seeds)
    return come
