"""Repeated passages, found with a logarithmic family of sparse suffix indexes.

A byte is removed when it lies in a string of 100 bytes that also starts
earlier: in a document with a smaller id, or before in the same document.

Suffixes are sampled at anchors (``anchors.py``), which depend only on the bytes
around them, so equal strings are sampled alike.  A suffix is known by the hash
of its first 24 bytes and by the hash of its run, the bytes of all windows that
it is the anchor of.  Since only equality counts, entries are sorted by these
hashes and not by the bytes themselves.

1. Documents come in batches, by id.  A batch is one sorted table of entries,
   bucketed by anchor; this is the only shuffle of entries.
2. The batch is merge-scanned against every level of the index by joins of
   equally bucketed tables.  An anchor that always had the same run is settled:
   all its entries but the first are removed runs.  An anchor with different
   runs is mixed, and its entries are put aside.
3. The batch's new anchors become a level.  Before the next batch, levels of
   equal rank are merged into one of the next rank, again without a shuffle.
4. Entries put aside stand where a repeated passage begins or ends.  They fetch
   the up to 176 bytes of their run from the text, and the windows in them are
   compared one by one.  An anchor with more than ``CROWD`` such entries is not
   gathered; its windows are compared as rows.
5. Removed ranges meet their texts once, where they are cut out.

A text's own repeats of a run are settled before anything is shuffled, so a text
that repeats itself all the way is a few rows.  Null texts are empty.  Rows with
equal id and text are one document; texts of one id are told apart and ordered
by a 64-bit hash; rows without id come before all others.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import store_table
from . import common as C
from .anchors import MATCH, runs

BATCHES = 4
CROWD = 20_000
_START, _LEN = 14, 7  # where the parts of a place begin: start | length | anchor
_NO_ID = -(1 << 63)


def place_parts(w: str = "w") -> dict:
    """Columns of a packed place."""
    return {"s": F.expr(f"shiftright({w}, {_START}) & {(1 << 31) - 1}"),
            "len": F.expr(f"shiftright({w}, {_LEN}) & 127")}


def _texts(documents: DataFrame) -> DataFrame:
    """doc_id, d, sub, text: ``sub`` tells texts of one id apart, and is 0 where ids are unique."""
    docs = C.only(documents, "doc_id", "text")
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"), "text")
    repeated = docs.groupBy("d").count().where("count > 1").limit(1).count() > 0
    sub = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    return docs.select("doc_id", "d", sub.alias("sub"), "text")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (h, g, d, sub, w); w < 0 marks a range that the text itself repeats: g is its length."""
    for batch in batches:
        raw, offs = C.binary_column(batch, "text")
        d, sub = np.asarray(batch.column("d")), np.asarray(batch.column("sub"))
        for i, _, data, o in C.groups(raw, offs):
            text, s, e, a, h, g = runs(data, o)
            if not len(text):
                continue
            w = (s << _START) | ((e - s) << _LEN) | (a - s)
            order = np.lexsort((s, g, text))
            again = np.zeros(len(text), dtype=bool)
            again[order[1:]] = (text[order][1:] == text[order][:-1]) & (g[order][1:] == g[order][:-1])
            keep = ~again
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[keep].view(np.int64)), pa.array(g[keep].view(np.int64)), pa.array(d[i + text][keep]), pa.array(sub[i + text][keep]), pa.array(w[keep])],
                names=["h", "g", "d", "sub", "w"])
            r = np.flatnonzero(again)
            if len(r):  # runs that follow each other are one range
                new = np.ones(len(r), dtype=bool)
                new[1:] = (text[r][1:] != text[r][:-1]) | (s[r][1:] != e[r][:-1] + 1)
                at = np.flatnonzero(new)
                stop = np.append(at[1:], len(r)) - 1
                size = e[r][stop] + MATCH - s[r][at]
                mark = (s[r][at] << _START) | np.int64(_NO_ID)
                of, tag = d[i + text[r]][at], sub[i + text[r]][at]
                spread = C.mix(mark.view(C.U) ^ C.mix(of.astype(C.U) ^ C.mix(tag.astype(C.U))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread.view(np.int64)), pa.array(size.astype(np.int64)), pa.array(of), pa.array(tag), pa.array(mark)], names=["h", "g", "d", "sub", "w"])


# --------------------------------------------------------------------------
# the index


@dataclass
class Level:
    rank: int
    table: str


class Index:
    """Levels of (h, g, d, sub, w, mixed), each anchor once per level, bucketed by anchor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[Level] = []
        self.tables: set[str] = set()

    def write(self, df: DataFrame) -> str:
        name = f"codeloom_suffixes_{uuid.uuid4().hex}"
        self.tables.add(name)
        df.write.bucketBy(self.parts, "h").sortBy("h").option("compression", "zstd").saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.discard(name)

    def close(self) -> None:
        for name in list(self.tables):
            self.drop(name)

    def level(self, at: Level) -> DataFrame:
        return self.spark.table(at.table).where("mixed or not known").select("h", "g", "d", "sub", "w", "mixed")

    def merge_equal(self) -> None:
        """Two last levels of one rank become one of the next rank."""
        while len(self.levels) > 1 and self.levels[-1].rank == self.levels[-2].rank:
            new, old = self.levels.pop(), self.levels.pop()
            b = self.level(new).toDF("h", *(f"{c}2" for c in ("g", "d", "sub", "w", "mixed")))
            both = self.level(old).join(b, "h", "full_outer").select(
                "h", *[F.coalesce(c, f"{c}2").alias(c) for c in ("g", "d", "sub", "w")],
                (F.coalesce("mixed", F.lit(False)) | F.coalesce("mixed2", F.lit(False))).alias("mixed"), F.lit(False).alias("known"))
            self.levels.append(Level(old.rank + 1, self.write(both)))
            self.drop(new.table)
            self.drop(old.table)

    def add(self, entries: DataFrame) -> DataFrame:
        """Scan a batch against the levels and make it one: marks (kind, h, g, d, sub, w).

        Kinds: 0 a removed run, 1 an entry of a mixed anchor, 2 a range that a text repeats.
        """
        self.merge_equal()
        batch = self.write(entries.repartition(self.parts, "h"))
        rows = self.spark.table(batch)
        own = rows.where("w >= 0").groupBy("h").agg(F.min("g").alias("g"), F.max("g").alias("g1"), F.min(F.struct("d", "sub", "w")).alias("f"))
        seen, mixed = F.lit(False), F.col("g") != F.col("g1")
        turned = [F.lit(None).cast("struct<g:long,d:long,sub:long,w:long>")]
        for i, at in enumerate(self.levels):
            own = own.join(self.level(at).select("h", F.struct("g", "d", "sub", "w", "mixed").alias(f"l{i}")), "h", "left")
            here = F.col(f"l{i}")
            seen = seen | here.isNotNull()
            mixed = mixed | F.coalesce(here["mixed"] | (here["g"] != F.col("g")), F.lit(False))
            turned.append(F.when(~here["mixed"], F.struct(*[here[c].alias(c) for c in ("g", "d", "sub", "w")])))
        own = own.withColumns({"mixed": mixed, "known": seen})
        # a settled entry that has just become mixed is put aside with the others
        own = own.withColumn("old", F.when(F.col("mixed"), F.coalesce(*turned)))
        state = self.write(own.select("h", "g", "f.d", "f.sub", "f.w", "mixed", "known", "old"))
        st = self.spark.table(state).select("h", *[F.col(c).alias(f"{c}0") for c in ("d", "sub", "w")], "mixed", "known")
        judged = rows.where("w >= 0").join(st, "h").where("mixed or known or d <> d0 or sub <> sub0 or w <> w0").select(
            F.when(F.col("mixed"), 1).otherwise(0).alias("kind"), "h", "g", "d", "sub", "w")
        old = self.spark.table(state).where("old is not null").select(F.lit(1).alias("kind"), "h", "old.g", "old.d", "old.sub", "old.w")
        own_repeats = rows.where("w < 0").select(F.lit(2).alias("kind"), "h", "g", "d", "sub", "w")
        marks, _ = store_table(judged.union(old).union(own_repeats))
        self.drop(batch)
        self.levels.append(Level(0, state))
        return marks


# --------------------------------------------------------------------------
# the ends of passages


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per entry put aside, with the bytes of its run."""
    for batch in batches:
        h, d, sub, w, ctx, crowd = [], [], [], [], [], []
        for doc, tag, text, entries in zip(*(batch.column(c).to_pylist() for c in ("d", "sub", "text", "entries"))):
            data = (text or "").encode("utf-8", "surrogatepass")
            for x in entries:
                s, n = (x["w"] >> _START) & ((1 << 31) - 1), (x["w"] >> _LEN) & 127
                h.append(x["h"])
                d.append(doc)
                sub.append(tag)
                w.append(x["w"])
                ctx.append(data[s: s + n + MATCH])
                crowd.append(x["crowd"])
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in (h, d, sub, w)), pa.array(ctx, pa.binary()), pa.array(crowd, pa.bool_())],
            names=["h", "d", "sub", "w", "ctx", "crowd"])


def _windows(cols: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window start in the run, key) of every window of some entries; equal windows of an anchor have equal keys."""
    h, w = np.asarray(cols["h"]).view(C.U), np.asarray(cols["w"])
    n, a = ((w >> _LEN) & 127) + 1, w & 127
    raw = cols["ctx"].cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[raw.offset: raw.offset + len(raw) + 1]
    body = np.frombuffer(data, dtype=np.uint8)[offs[0]: offs[-1]] if data is not None else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offs[row] - offs[0] + at
    key = C.range_hash(C.prefix_hash(body), start, start + MATCH)
    return row, at, C.mix(key ^ C.mix(h[row] + (at - a[row] + 128).astype(C.U)))


def _ranges(d: np.ndarray, sub: np.ndarray, w: np.ndarray, row: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Removed windows of entries, neighbours joined: (d, sub, lo, hi)."""
    if not len(row):
        z = pa.array([], pa.int64())
        return pa.RecordBatch.from_arrays([z, z, z, z], names=["d", "sub", "lo", "hi"])
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    s = (w >> _START) & ((1 << 31) - 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(d[row[first]]), pa.array(sub[row[first]]), pa.array(s[row[first]] + at[first]), pa.array(s[row[last]] + at[last] + MATCH)],
        names=["d", "sub", "lo", "hi"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that an earlier entry of the same anchor has too; rows come sorted by anchor and place."""
    held: pa.Table | None = None

    def settle(table: pa.Table) -> pa.RecordBatch:
        cols = {c: table.column(c).combine_chunks() for c in table.column_names}
        cols = {c: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for c, v in cols.items()}
        row, at, key = _windows(cols)
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), dtype=bool)
        again[order[1:]] = key[order][1:] == key[order][:-1]
        return _ranges(*(np.asarray(cols[c]) for c in ("d", "sub", "w")), row[again], at[again])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, t]) if held is not None else t
        h = np.asarray(held.column("h"))
        if len(h) < 4000:
            continue
        cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
        lo = 0
        while lo < cut:
            hi = min(cut, lo + 20_000)
            hi = int(np.searchsorted(h, h[hi - 1], side="right")) if hi < cut else cut
            yield settle(held.slice(lo, hi - lo))
            lo = hi
        held = held.slice(cut)
    if held is not None and held.num_rows:
        yield settle(held)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 5000):
            part = batch.slice(lo, 5000)
            row, at, key = _windows({c: part.column(c) for c in part.schema.names})
            w = np.asarray(part.column("w"))[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), *(pa.array(np.asarray(part.column(c))[row]) for c in ("d", "sub")), pa.array(((w >> _START) & ((1 << 31) - 1)) + at)],
                names=["key", "d", "sub", "lo"])


def _ends(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """Removed ranges (d, sub, lo, hi) in the runs of ``firsts(h, d, sub, w)``: entries of mixed anchors, each run once."""
    crowded = firsts.groupBy("h").count().where(F.col("count") > CROWD).select("h", F.lit(True).alias("crowd"))
    flagged = firsts.join(crowded, "h", "left").select("h", "d", "sub", "w", F.coalesce("crowd", F.lit(False)).alias("crowd"))
    per_text = flagged.groupBy("d", "sub").agg(F.collect_list(F.struct("h", "w", "crowd")).alias("entries"))
    kind = "h long, d long, sub long, w long, ctx binary, crowd boolean"
    found = texts.select("d", "sub", "text").join(per_text, ["d", "sub"]).mapInArrow(_contexts, kind).dropDuplicates(["h", "d", "sub", "w"])
    ctx, _ = store_table(found, "crowd")
    few = ctx.where("not crowd").drop("crowd").repartition("h").sortWithinPartitions("h", "d", "sub", "w")
    ranges = few.mapInArrow(_compare, "d long, sub long, lo long, hi long")
    rows = ctx.where("crowd").drop("crowd").mapInArrow(_window_rows, "key long, d long, sub long, lo long")
    line = Window.partitionBy("key").orderBy("d", "sub", "lo")
    many = rows.withColumn("nth", F.row_number().over(line)).where("nth > 1").select("d", "sub", "lo", (F.col("lo") + MATCH).alias("hi"))
    return ranges.union(many)


# --------------------------------------------------------------------------
# the whole


def removed_ranges(documents: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(texts of ``_texts``, their removed ranges (d, sub, lo, hi), which may overlap)."""
    spark = documents.sparkSession
    texts = _texts(documents)
    cuts = texts.approxQuantile("d", [i / batches for i in range(1, batches)], 0.001)
    index, marks = Index(spark), []
    try:
        low = None
        for high in [*sorted({int(c) for c in cuts}), None]:
            part = texts
            if low is not None:
                part = part.where(F.col("d") > low)
            if high is not None:
                part = part.where(F.col("d") <= high)
            low = high
            marks.append(index.add(C.spread(part.select("d", "sub", "text")).mapInArrow(_scan, "h long, g long, d long, sub long, w long")))
    finally:
        index.close()
    all_marks = marks[0]
    for m in marks[1:]:
        all_marks = all_marks.union(m)
    line = Window.partitionBy("h", "g").orderBy("d", "sub", "w")
    aside = all_marks.where("kind = 1").select("h", "g", "d", "sub", "w").distinct().withColumn("nth", F.row_number().over(line))
    aside, _ = store_table(aside.drop("g"))
    whole = all_marks.where("kind = 0").select("d", "sub", "w").union(aside.where("nth > 1").select("d", "sub", "w")).withColumns(place_parts())
    whole = whole.select("d", "sub", F.col("s").alias("lo"), (F.col("s") + F.col("len") + MATCH).alias("hi"))
    own = all_marks.where("kind = 2").select(
        "d", "sub", place_parts()["s"].alias("lo"), (place_parts()["s"] + F.col("g")).alias("hi"))
    ends = _ends(texts, aside.where("nth = 1").select("h", "d", "sub", "w"))
    return texts, whole.union(own).union(ends)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges")):
            data = (text or "").encode("utf-8", "surrogatepass")
            kept = data
            removed = spans = 0
            if ranges.is_valid and len(ranges.values):
                lo, hi = (np.asarray(ranges.values.field(c)) for c in ("lo", "hi"))
                step = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(step, lo, 1)
                np.add.at(step, hi, -1)
                gone = np.cumsum(step[:-1]) > 0
                removed = int(gone.sum())
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
            for c, v in zip(out, (len(data), removed, spans, hashlib.sha256(kept).hexdigest())):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_ranges(documents: DataFrame, batches: int) -> DataFrame:
    texts, ranges = removed_ranges(documents, batches)
    per_text = ranges.groupBy("d", "sub").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))  # ranges of one text
    return texts.join(per_text, ["d", "sub"], "left").select("doc_id", "text", "ranges")


def report(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    df = _with_ranges(documents, batches)
    kind = dict(df.dtypes)["doc_id"]
    return df.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
