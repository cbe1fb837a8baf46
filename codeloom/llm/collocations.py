"""Phrase collocations by Toivonen's method: sample, count exactly, widen until closed.

Phrases are runs of up to ``LONGEST`` words inside a piece of text between marks
or line ends, counted per language.  A phrase is frequent from ``SUPPORT``
occurrences on; then so are all phrases inside it.

1. A sample of documents proposes phrases, level by level: those that occur
   there as often as half the support leads one to expect.
2. One full pass counts the proposed phrases exactly, and with them the negative
   border: phrases that were not proposed although all phrases inside them were.
   Which these are a task sees by itself, from a bitmap of the proposed ones.
3. If a phrase of the border is frequent, something longer may be as well: it
   joins the proposed ones, and another pass counts only what the wider border
   adds.  This ends when no frequent phrase is outside; whatever the sample
   missed has been found by then.
4. Last the frequent phrases are named, most of them by one document in sixteen and
   the rest by all; scores are joins of these names.

The bitmap lets some phrases through that were not proposed; they are counted as
well, which changes no result.  It has thirty-two bits or more a phrase up to
``BITMAP_BITS``; beyond that more is counted than need be.  Counts are added up
inside each task before they are shuffled; texts never are.

Null texts are empty, null languages are ``und``.  Texts are read whole, however
long, rows that repeat count again, and an empty table gives no rows.  Equal
phrases have equal hashes; others differ up to 64-bit collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_per_group
from . import common as C
from .components import stored

SUPPORT = 30
LONGEST = 4
FIRST = 2000
# One document in so many is in the sample.
SAMPLE = 4
LEAST_BITS, BITMAP_BITS = 1 << 20, 1 << 28
# Phrases that a task counts before it hands counts on.
HELD = 1 << 20
# Rows that are handed to Spark, or taken from a batch, at once.
ROWS_OUT, ROWS_IN = 1 << 16, 512
# One document in so many is asked for the names of phrases before all are asked for the rest.
NAMED_FIRST = 16
SEEN = 1 << 20
# Bytes of text whose phrases are hashed at once; a longer text is a group of its own.
GROUP = 1 << 19

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_INSIDE = ~_BREAKS
_INSIDE[[0x20, 0x09]] = False


class _Phrases:
    """The phrases of a group of texts: hashes by length, and where their words are."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lang: np.ndarray):
        w = C.words_of(data, offs, _INSIDE)
        self.data, self.start, self.end = w.data, w.start, w.end
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(w.first))
        # a number that changes with every mark and every text
        piece = np.cumsum(_BREAKS[w.data])[w.start] + self.row if len(w.start) else np.zeros(0, dtype=np.int64)
        word = C.mix(w.hash + lang[self.row])
        self.hash, self.valid = [word], [np.ones(len(word), dtype=bool)]
        for k in range(2, LONGEST + 1):
            h = C.grams(word, k)
            self.hash.append(h)
            self.valid.append(piece[k - 1:] == piece[: len(h)] if len(h) else np.zeros(0, dtype=bool))

    def proposed(self, k: int, bits: np.ndarray) -> np.ndarray:
        """Which phrases of ``k`` words have only proposed ones inside."""
        known = C.in_bitmap(bits, self.hash[k - 2])
        n = len(self.hash[k - 1])
        return self.valid[k - 1] & known[:n] & known[1: n + 1]

    def words(self, i: int, k: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i: i + k].tolist(), self.end[i: i + k].tolist())).decode()


def _phrases(whole: pa.RecordBatch) -> Iterator[tuple[int, _Phrases]]:
    for lo in range(0, whole.num_rows, ROWS_IN):
        batch = whole.slice(lo, ROWS_IN)
        raw, offs = C.binary_column(batch, "text")
        lang = np.asarray(batch.column("lang_hash")).view(C.U)
        for i, j, data, o in C.groups(raw, offs, GROUP):
            yield lo + i, _Phrases(data, o, lang[i:j])


def _count(levels: tuple[int, ...], now, before):
    """Counts of phrases whose inner ones are proposed now but were not all before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, old = now.value, before.value
        held: list[np.ndarray] = []
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, C.U), np.zeros(0, np.int64))
            for lo in range(0, len(h), ROWS_OUT):
                part = slice(lo, lo + ROWS_OUT)
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(c[part].astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for _, p in _phrases(batch):
                for k in levels:
                    if k == 1:
                        take = p.valid[0]
                    else:
                        take = p.proposed(k, bits)
                        if old is not None:
                            take &= ~p.proposed(k, old)
                    held.append(p.hash[k - 1][take])
                    size += len(held[-1])
                if size >= HELD:
                    yield from summed()
                    held, size = [], 0
        yield from summed()

    return run


def _counted(docs: DataFrame, levels: tuple[int, ...], bits: np.ndarray | None, before: np.ndarray | None, least: int) -> DataFrame:
    """(h, a) of phrases with ``least`` occurrences or more."""
    spark = docs.sparkSession
    rows = docs.mapInArrow(_count(levels, C.broadcast(spark, bits), C.broadcast(spark, before)), "h long, c long")
    return stored(rows.groupBy("h").agg(F.sum("c").alias("a")).where(F.col("a") >= least))


def _bitmap(found: list[DataFrame], bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, dtype=np.uint8)
    for f in found:
        out |= C.bitmap_of(f, "h", bits)
    return out


def _width(n: int) -> int:
    bits = LEAST_BITS
    while bits < min(32 * n, BITMAP_BITS):
        bits *= 2
    return bits


def _outside(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            yield batch.filter(pa.array(~C.in_bitmap(known, np.asarray(batch.column("h")).view(C.U))))

    return run


def proposals(docs: DataFrame, support: int = SUPPORT, sample: int = SAMPLE) -> np.ndarray:
    """A bitmap of the phrases that a sample of one document in ``sample`` proposes."""
    some = docs.where(F.pmod(F.col("key"), F.lit(sample)) == 0)
    least = max(1, support // (2 * sample))
    found, bits = [], None
    for k in range(1, LONGEST + 1):
        found.append(_counted(some, (k,), bits, None, least))
        bits = _bitmap(found[-1:], _width(found[-1].count()))  # a level looks up the one below only
    return _bitmap(found, _width(sum(f.count() for f in found)))


def frequent(docs: DataFrame, support: int = SUPPORT, sample: int = SAMPLE) -> DataFrame:
    """(h, a): the hash and the exact count of every frequent phrase of ``docs(key, lang_hash, text)``."""
    spark = docs.sparkSession
    bits = proposals(docs, support, sample)
    found = [_counted(docs, tuple(range(1, LONGEST + 1)), bits, None, support)]
    while True:
        missed = stored(found[-1].mapInArrow(_outside(C.broadcast(spark, bits)), "h long, a long"))
        if missed.limit(1).count() == 0:
            break
        wider = bits | C.bitmap_of(missed, "h", 8 * len(bits))
        found.append(_counted(docs, tuple(range(2, LONGEST + 1)), wider, bits, support))
        bits = wider
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _name(wanted):
    """Each wanted phrase once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        seen = np.zeros(0, dtype=C.U)  # forgetting one costs a row only
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, p in _phrases(batch):
                rows: list[tuple] = []
                new = []
                for k in range(1, LONGEST + 1):
                    at = np.flatnonzero(p.valid[k - 1] & C.in_bitmap(bits, p.hash[k - 1]))
                    h, where = np.unique(p.hash[k - 1][at], return_index=True)
                    fresh = ~np.isin(h, seen, assume_unique=True)
                    new.append(h[fresh])
                    rows += [(x, langs[first + p.row[i]], p.words(i, k), k) for x, i in zip(h[fresh].view(np.int64).tolist(), at[where[fresh]].tolist())]
                seen = np.concatenate([seen, *new]) if len(seen) < SEEN else np.concatenate(new)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["h", "lang", "phrase", "k"])

    return run


def _named(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(h, a, lang, phrase, k) of those of ``found`` (h, a) that occur in ``docs``."""
    wanted = C.broadcast(docs.sparkSession, _bitmap([found], _width(found.count())))
    rows = docs.mapInArrow(_name(wanted), "h long, lang string, phrase string, k int")
    once = rows.groupBy("h").agg(F.min(F.struct("lang", "phrase", "k")).alias("p"))
    return stored(found.join(once, "h").select("h", "a", "p.*"))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words each text has."""
    for batch in batches:
        raw, offs = C.binary_column(batch, "text")
        parts = [np.diff(C.words_of(data, o, _INSIDE).first) for _, _, data, o in C.groups(raw, offs, GROUP)]
        n = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n.astype(np.int64))], names=["lang", "n"])


def _part(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def phrases(documents: DataFrame, support: int = SUPPORT, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, k, a) of up to ``LONGEST`` words, and (lang, n), the words of a language."""
    docs = C.spread(C.only(documents, "doc_id", "lang", "text")).select(
        F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"
    ).withColumn("lang_hash", F.xxhash64("lang"))
    found = stored(frequent(docs, support, sample))
    # most frequent phrases occur in few documents already, which spares every task from naming them
    early = _named(docs.where(F.pmod(F.col("key"), F.lit(NAMED_FIRST)) == 0), found)
    late = _named(docs, stored(found.join(early.select("h"), "h", "left_anti")))
    words = docs.select("lang", "text").mapInArrow(_lengths, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    return stored(early.union(late).select("lang", "phrase", "k", "a")), words


def collocations(documents: DataFrame, support: int = SUPPORT, first: int = FIRST, sample: int = SAMPLE) -> DataFrame:
    """The first phrases of each language by how firmly their weakest cut holds together.

    Columns: lang, rank, phrase, a, l, r, n, score.
    """
    all_found, words = phrases(documents, support, sample)
    spread_out = all_found.where("k > 1").select("lang", "phrase", "k", "a", F.split("phrase", " ").alias("w"))
    cuts = spread_out.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).select(
        "lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    part = all_found.select("lang", "phrase", "a")
    scored = (
        cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
        .join(part.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
        .withColumn("score", F.expr("(2000000BD * a) div (cast(l as decimal(20, 0)) + r)")))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    # of every phrase inside a longer one the largest count of such
    inner = spread_out.where("k > 2").withColumn("m", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, k - m + 1)")))
    covered = inner.select("lang", _part(F.col("at"), F.col("m")).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(covered, ["lang", "phrase"], "left").where("longer is null or 100BD * longer < 80BD * a").select(
        "lang", "phrase", "a", "c.l", "c.r", F.col("c.score").cast("long").alias("score"))
    best = top_per_group(kept, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], first)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
