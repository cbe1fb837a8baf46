"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A document's fingerprint has 64 bits: bit i is set if it is set in over half of
the hashes of its ``K``-word shingles, repeats included.  Fingerprints link when
at most ``BITS_APART`` bits differ.

1. Distinct fingerprints are classes; documents never meet, only classes do.
2. Three differing bits touch three of the eight bytes at most, so linked
   fingerprints agree in five bytes at their places.  Lists of the index hold the
   classes that agree in four given places.  Fourteen choices of four places (a
   Steiner system) leave none of the sets of five without one, so every pair to
   be found meets in a list.  Lists of one place alone would hold a 256th of
   all classes each, and their pairs would grow with the square of the corpus.
3. In a list the shared positional bytes of each pair are tallied; pairs with
   five or more are verified by counting differing bits.
4. A list of more than ``LONG`` classes is split by a fifth place, once for each
   of the four others, since a pair that reaches the count shares one of them.
   Such a list agrees in forty bits, so it has at most 2**24 classes; in it the
   few thousand ways to change three of the other bits are looked up, which is
   linear in its length.
5. A list reports no more links than connect its classes as all its links do.

Null and empty texts have no shingles and the fingerprint zero, which links like
any other.  A text of fewer than ``K`` words is one shingle.  Long texts are
hashed in pieces.  Every row is a document of its own, also where ids repeat; a
row without id takes the smallest id in its component, null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components, stored

K = 3
SEED = 42
BITS_APART = 3
LEAST_BYTES = 8 - BITS_APART
# Classes of a list up to which its pairs are compared one by one, and how many rows of pairs at once.
LONG, ROWS = 2048, 256
PIECE = 1 << 15

_BYTES = [0xFF << (8 * i) for i in range(8)]


def _quads() -> list[tuple[int, ...]]:
    """Fourteen sets of four places: each three places lie in exactly one of them."""
    sets: list[tuple[int, ...]] = []
    for q in combinations(range(8), 4):
        if all(len(set(q) & set(s)) <= 2 for s in sets):
            sets.append(q)
    return sets


QUADS = _quads()
FIVES = list(combinations(range(8), LEAST_BYTES))


def _mask(places: tuple[int, ...]) -> int:
    m = sum(_BYTES[i] for i in places)
    return m - (1 << 64) if m >= 1 << 63 else m


# --------------------------------------------------------------------------
# fingerprints


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: A-Z and the six ASCII spaces only
    n = max(1, len(words) - K + 1) if words else 0
    if n == 0:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    stop = end[-n:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, PIECE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(start[lo: lo + PIECE], stop[lo: lo + PIECE])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text").fill_null("").cast(pa.large_binary())
        found = np.array([fingerprint(t.as_py()) for t in text], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed number."""
    docs = C.spread(C.only(documents, "doc_id", "text"))
    return docs.mapInArrow(_fingerprints, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


# --------------------------------------------------------------------------
# links


class _Groups:
    """Which members of a list are connected."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Connects the pairs; as many of them are returned as that takes."""
        out: list[tuple[int, int]] = []
        while True:
            x, y = self.root[i], self.root[j]
            apart = x != y
            if not apart.any():
                return out
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            # every larger root moves below one smaller root, so no circle can close
            up, first = np.unique(np.maximum(x, y), return_index=True)
            self.root[up] = np.minimum(x, y)[first]
            while True:
                jumped = self.root[self.root]
                if (jumped == self.root).all():
                    break
                self.root = jumped
            out += zip(i[first].tolist(), j[first].tolist())


def _compare(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a list by tallying the positional bytes of its pairs."""
    groups, out = _Groups(len(fps)), []
    at_place = fps.view(np.uint8).reshape(-1, 8)
    for lo in range(0, len(fps) - 1, ROWS):
        rows = slice(lo, lo + ROWS)
        tally = np.zeros((len(fps[rows]), len(fps) - lo), dtype=np.uint8)
        for place in range(8):
            tally += at_place[rows, None, place] == at_place[None, lo:, place]
        i, j = np.nonzero(tally >= LEAST_BYTES)
        i, j = i[j > i] + lo, j[j > i] + lo
        near = np.bitwise_count(fps[i] ^ fps[j]) <= BITS_APART
        out += groups.join(i[near], j[near])
    return out


def _changes(free: int) -> np.ndarray:
    """All numbers of one to three bits among those of ``free``."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return np.array([sum(c) for n in range(1, BITS_APART + 1) for c in combinations(bits, n)], dtype=np.uint64)


def _look_up(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a list that agrees in forty bits, by looking up what is three changes or less away."""
    groups, out = _Groups(len(fps)), []
    fps_sorted = np.sort(fps)
    back = np.argsort(fps)
    same = ~np.bitwise_or.reduce(fps ^ fps[0])
    free = ((1 << 64) - 1) ^ int(same)
    for change in _changes(free):
        other = fps_sorted ^ change
        at = np.searchsorted(fps_sorted, other)
        at[at == len(fps)] = 0
        hit = (fps_sorted[at] == other) & (other > fps_sorted)
        out += groups.join(back[np.flatnonzero(hit)], back[at[hit]])
    return out


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The classes of each list, from rows sorted by list."""
    held: list[np.ndarray] = []
    now = None
    for batch in batches:
        place, key, fp = (np.asarray(batch.column(c)) for c in ("place", "key", "fp"))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(place) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            if a == b:
                continue
            if (place[a], key[a]) != now:
                if held:
                    yield np.concatenate(held)
                held, now = [], (place[a], key[a])
            held.append(fp[a:b].view(np.uint64))
    if held:
        yield np.concatenate(held)


def _links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for fps in _lists(batches):
        found = _compare(fps) if len(fps) <= LONG else _look_up(fps)
        if found:
            pairs = fps.view(np.int64)[np.array(found)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _entries(rows: DataFrame, masks: Column) -> DataFrame:
    """The index entries of classes: one for each mask, ``masks`` being an array of (place, mask)."""
    return rows.select("fp", F.explode(masks).alias("m")).select(
        F.col("m.place").alias("place"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp")


def _masks(sets: list[tuple[int, ...]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("place"), F.lit(_mask(s)).cast("long").alias("mask")) for i, s in enumerate(sets)])


def _in_lists(entries: DataFrame) -> DataFrame:
    return entries.repartition("place", "key").sortWithinPartitions("place", "key").mapInArrow(_links_of, "a long, b long")


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect ``classes(fp)`` as all links do."""
    entries = _entries(classes, _masks(QUADS))
    sizes = stored(entries.groupBy("place", "key").agg(F.count("*").alias("n")).where("n > 1"))
    met = stored(entries.join(sizes, ["place", "key"]))
    # what a long list asks of its members: agree in a fifth place
    five = F.array(*[
        F.array(*[F.struct(F.lit(FIVES.index(tuple(sorted((*q, i))))).alias("place"), F.lit(_mask((*q, i))).cast("long").alias("mask"))
                  for i in range(8) if i not in q]) for q in QUADS])
    long = met.where(F.col("n") > LONG)
    deeper = _entries(long.select("fp", "place"), F.element_at(five, F.col("place") + 1)).distinct()
    return stored(_in_lists(met.where(F.col("n") <= LONG).drop("n")).union(_in_lists(deeper)).distinct())


def similar_documents(documents: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    docs = stored(fingerprints(documents))
    classes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(classes.select("fp")))
    placed = stored(classes.join(label, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("comp")))
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    return docs.join(placed.join(least, "comp").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def report(documents: DataFrame) -> DataFrame:
    return similar_documents(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
