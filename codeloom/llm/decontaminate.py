"""Benchmark decontamination by winnowing.

Every text is cut into words; every run of ``K`` words is hashed, and of each
``WINDOW - K + 1`` neighbouring hashes the smallest (the last one of equals) is
a fingerprint.  Two texts that share ``WINDOW`` words choose the same hash
inside them, so joining fingerprints finds every shared window; a hit is then
extended word by word, and counts when it reaches ``WINDOW`` words.  Items that
are shorter than a window are looked up whole.

A document's fingerprint leaves its task only if a bitmap of fixed size says
that the benchmark may have it, and takes along the few words around it.  So
texts are read once and never shuffled.

Nulls and empty texts have no words.  Benchmark rows without an id or without
words are ignored.  Equal rows of documents get equal results, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, store_table
from . import common as C

WINDOW = 10
K = 5
SALTS = 8

_PRINT = "array<struct<h:long,m:int,pos:int,lead:int,ctx:string>>"


def _prints(w: C.Words, short: list[int], bitmap, whole_short: bool) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, hash, short length or 0, word, words before it, words of context)."""
    doc_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    found = []
    g = C.grams(w.hash, K)
    span = WINDOW - K + 1
    if len(w.hash) >= WINDOW:
        view = np.lib.stride_tricks.sliding_window_view(g[::-1], span)
        last = (span - 1 - view.argmin(axis=1))[::-1]
        at = np.arange(len(last))
        inside = doc_of[at] == doc_of[at + WINDOW - 1]
        pos = np.unique((at + last)[inside])
        found.append((pos, g[pos], 0))
    size = np.diff(w.first)
    for m in short:
        h = C.grams(w.hash, m) + C.U(m)
        at = np.arange(len(h))
        keep = doc_of[at] == doc_of[at + m - 1]
        if whole_short:
            keep &= size[doc_of[at]] == m
        found.append((at[keep], h[keep], m))
    for pos, h, m in found:
        if bitmap is not None:
            maybe = C.in_bitmap(bitmap, h)
            pos, h = pos[maybe], h[maybe]
        for p, x in zip(pos.tolist(), h.astype(np.int64).tolist()):
            d = int(doc_of[p])
            if m:
                yield d, x, m, p, 0, m
            else:
                lo = max(int(w.first[d]), p - (WINDOW - K))
                hi = min(int(w.first[d + 1]), p + WINDOW)
                yield d, x, 0, p, p - lo, hi - lo


def _scan(keys: list[str], short: list[int], bitmap=None, whole_short: bool = False):
    """A function over batches: each row's keys, its number of words and its fingerprints."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("m", pa.int32()), ("pos", pa.int32()), ("lead", pa.int32()), ("ctx", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap is not None else None
        for batch in batches:
            raw, offs = C.binary_column(batch, "text")
            counts, prints = [], []
            for i, j, data, o in C.groups(raw, offs):
                w = C.words_of(data, o, C.WORD)
                counts.append(np.diff(w.first))
                mine: list[list] = [[] for _ in range(j - i)]
                for d, h, m, p, lead, n in _prints(w, short, bits, whole_short):
                    lo = p - lead
                    ctx = b" ".join(w.data[w.start[q]: w.end[q]].tobytes() for q in range(lo, lo + n)).decode("utf-8", "replace")
                    mine[d].append({"h": h, "m": m, "pos": p - int(w.first[d]), "lead": lead, "ctx": ctx})
                prints.extend(mine)
            n_words = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array(n_words, pa.int64()), pa.array(prints, kind)],
                names=[*keys, "n_words", "prints"])

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ranges of documents that an item covers."""
    for batch in batches:
        rows = batch.to_pydict()
        out: dict[str, list] = {c: [] for c in ("k1", "k2", "item_id", "lo", "hi")}
        for k1, k2, item, m, pos, lead, ctx, ilead, ictx in zip(*(rows[c] for c in (
                "k1", "k2", "item_id", "m", "pos", "lead", "ctx", "item_lead", "item_ctx"))):
            a, b = ctx.split(" "), ictx.split(" ")
            if m:
                left, right, ok = 0, m, a == b
            else:
                left = 0
                while left < min(lead, ilead) and a[lead - left - 1] == b[ilead - left - 1]:
                    left += 1
                right = 0
                while lead + right < len(a) and ilead + right < len(b) and a[lead + right] == b[ilead + right]:
                    right += 1
                ok = left + right >= WINDOW and right >= K
            if ok:
                for c, v in zip(out, (k1, k2, item, pos - left, pos + right)):
                    out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("k1", pa.int64()), ("k2", pa.int32()), ("item_id", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))


def find_overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, k1, k2."""
    spark = documents.sparkSession
    bench = C.only(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text")
    # which lengths below a window occur: at most WINDOW - 1 numbers
    sized = bench.where("item_id is not null").mapInArrow(_scan(["item_id", "text"], []), f"item_id string, text string, n_words long, prints {_PRINT}")
    short = sorted(r[0] for r in sized.where((F.col("n_words") > 0) & (F.col("n_words") < WINDOW)).select("n_words").distinct().collect())
    prints = materialize(
        bench.where("item_id is not null")
        .mapInArrow(_scan(["item_id"], short, None, True), f"item_id string, n_words long, prints {_PRINT}")
        .select("item_id", F.explode("prints").alias("p"))
        .select("item_id", "p.h", "p.m", F.col("p.lead").alias("item_lead"), F.col("p.ctx").alias("item_ctx"))
        .distinct())
    bitmap = C.broadcast(spark, C.bitmap_of(prints, "h"))
    docs = C.only(documents, "doc_id", "text").select("doc_id", "text", *C.row_key())
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, k1 long, k2 int, n_words long, prints {_PRINT}"
    seen, _ = store_table(docs.mapInArrow(_scan(["doc_id", "k1", "k2"], short, bitmap), schema))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    found = seen.where(F.size("prints") > 0).select("k1", "k2", F.explode("prints").alias("p")).select(
        "k1", "k2", F.pmod("k1", F.lit(SALTS)).cast("int").alias("salt"), "p.*")
    ranges = (
        found.join(prints.withColumn("salt", salts), ["h", "m", "salt"])
        .select("k1", "k2", "item_id", "m", "pos", "lead", "ctx", "item_lead", "item_ctx")
        .mapInArrow(_extend, "k1 long, k2 int, item_id string, lo int, hi int")
    )
    # ranges of one row of documents, so no more than its words allow
    per_row = ranges.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ranges"),
        F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate(
        "ranges", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, r: F.struct(
            (a.n + F.greatest(F.lit(0).cast("long"), r.hi - F.greatest(a.upto, r.lo.cast("long")))).alias("n"),
            F.greatest(a.upto, r.hi.cast("long")).alias("upto")),
        lambda a: a.n)
    hits = per_row.select("k1", "k2", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                          F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return seen.drop("prints").join(hits, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), "k1", "k2")


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_overlaps(documents, benchmark).drop("k1", "k2")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that share no window with the benchmark."""
    bad = find_overlaps(documents, benchmark).where("contaminated").select("k1", "k2").distinct()
    return C.named(C.keyed(documents).join(bad, ["k1", "k2"], "left_anti"), documents)
