"""Quality by nearest-neighbour voting among labelled documents.

A text is counted by its shape and by its wording.  Shape is hashed triples of
character classes (letters, capitals, digits, spaces; every other sign is its
own class) and events of repetition: a word like the one before, a three-word
window or a word met before.  Wording is its hashed words and its hashed
stretches of ``GRAM`` bytes, A-Z lower-cased, which hold a whole character of
any script.  Counts are damped and weighted by how rare they are among the
labelled documents; shape and wording weigh the same in every text.  The
singular vectors of the labelled documents over both give ``RANK`` latent
dimensions.

Every document is projected, and its cosines with all labelled vectors are
computed in blocks, exactly.  The ``NEIGHBOURS`` closest vote with their labels,
weighted by similarity; the score is the share of the vote for good quality.

Labelled vectors are a bounded sample, ``SAMPLE`` rows with the smallest
hashes, so what is broadcast is at most two megabytes.  Null texts are empty.
An empty text is like no document and scores 0; without labels all score 0.5.
Rows of labels without id or label are ignored; of several labels the best counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C

SLOTS = 1024
EVENTS = 3
SHAPE = SLOTS + EVENTS
# Slots of words, and of stretches of GRAM bytes.
WORD_BITS, GRAM_BITS = 11, 11
GRAM = 5
WIDTH = SHAPE + (1 << WORD_BITS) + (1 << GRAM_BITS)
RANK = 48
NEIGHBOURS = 15
# Votes weigh the cosine to this power, so that a few close neighbours beat many distant ones.
SHARPNESS = 12
SAMPLE = 4000
CUT = 0.3
BLOCK = 256
ROUNDS = 16
ROWS = 512


def _classes() -> np.ndarray:
    b = np.arange(256)
    out = b.copy()
    out[(b >= 97) & (b <= 122) | (b >= 128)] = 97
    out[(b >= 65) & (b <= 90)] = 65
    out[(b >= 48) & (b <= 57)] = 48
    return out.astype(np.uint32)


CLASS = _classes()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """At most ``ROWS`` rows at once, as a row of counts is some twenty kilobytes."""
    for lo in range(0, batch.num_rows, ROWS):
        yield batch.slice(lo, ROWS)


def counts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Blocks of rows of term counts, square roots taken."""
    for part in _slices(batch):
        yield from _counts(part)


def _counts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    raw, offs = C.binary_column(batch, "text")
    for i, j, data, o in C.groups(raw, offs, 1 << 20):
        flat = np.zeros((j - i) * SLOTS, dtype=np.int64)
        gram = np.zeros((j - i) << GRAM_BITS, dtype=np.int64)
        for lo in range(0, len(data), 1 << 20):
            near = data[lo: lo + (1 << 20) + GRAM - 1]
            row = np.searchsorted(o, np.arange(lo, lo + len(near)), side="right") - 1
            m = min(1 << 20, len(near) - GRAM + 1)
            if m > 0:
                low = C.LOWER[near].astype(np.uint32)
                code = np.zeros(m, dtype=np.uint32)
                for k in range(GRAM):
                    code = code * np.uint32(0x01000193) + low[k: m + k]
                slot = (code ^ (code >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(32 - GRAM_BITS)
                same = row[:m] == row[GRAM - 1: m + GRAM - 1]
                gram += np.bincount(((row[:m] << GRAM_BITS) + slot)[same], minlength=len(gram))
            part = CLASS[near]
            m = min(1 << 20, len(part) - 2)
            if m <= 0:
                continue
            code = (part[:m] * np.uint32(257) + part[1: m + 1]) * np.uint32(263) + part[2: m + 2]
            slot = (code * np.uint32(2654435761)) >> np.uint32(22)
            same = row[:m] == row[2: m + 2]
            flat += np.bincount((row[:m] * SLOTS + slot)[same], minlength=len(flat))
        out = np.zeros((j - i, WIDTH), dtype=np.float32)
        out[:, :SLOTS] = flat.reshape(j - i, SLOTS)
        out[:, -(1 << GRAM_BITS):] = gram.reshape(j - i, -1)
        w = C.words_of(data, o, C.NOT_SPACE)
        row = np.repeat(np.arange(j - i), np.diff(w.first))
        slot = (row << WORD_BITS) + (w.hash >> C.U(64 - WORD_BITS)).astype(np.int64)
        out[:, SHAPE: SHAPE + (1 << WORD_BITS)] = np.bincount(slot, minlength=(j - i) << WORD_BITS).reshape(j - i, -1)
        triples = C.grams(w.hash, 3)
        for d, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            h = w.hash[a:b]
            if len(h) == 0:
                continue
            out[d, SLOTS] = 4 * (h[1:] == h[:-1]).sum()
            if len(h) >= 3:
                g = triples[a: b - 2]
                out[d, SLOTS + 1] = 4 * (len(g) - len(np.unique(g)))
            out[d, SLOTS + 2] = len(h) - len(np.unique(h))
        yield np.sqrt(out)


class Space:
    """Latent vectors of labelled rows, and how to project others next to them."""

    def __init__(self, x: np.ndarray, good: np.ndarray, rank: int = RANK):
        """``x`` is weighed in place: it is by far the largest thing that the driver holds."""
        self.idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 0.1
        for a in range(0, len(x), BLOCK):
            x[a: a + BLOCK] = self._weigh(x[a: a + BLOCK])
        self.basis = self._singular(x, min(rank, len(x)))
        self.points = self._unit(x @ self.basis)
        self.good = good.astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)

    @staticmethod
    def _singular(t: np.ndarray, rank: int) -> np.ndarray:
        """The first singular vectors, by subspace iteration from a fixed start."""
        q = np.random.default_rng(0).standard_normal((t.shape[1], min(2 * rank, *t.shape)), dtype=np.float32)
        for _ in range(ROUNDS):
            q, _ = np.linalg.qr(t.T @ (t @ q))
        y = (t @ q).astype(np.float64)
        _, vector = np.linalg.eigh(y.T @ y)
        return np.ascontiguousarray(q @ vector[:, ::-1][:, :rank], dtype=np.float32)

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        t = x * self.idf
        return self._unit(np.concatenate([self._unit(t[:, :SHAPE]), self._unit(t[:, SHAPE:])], axis=1))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._unit(self._weigh(x) @ self.basis)
        k = min(NEIGHBOURS, len(self.points))
        out = np.zeros(len(z))
        for a in range(0, len(z), BLOCK):
            sim = z[a: a + BLOCK] @ self.points.T
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(sim, near, axis=1), 0) ** SHARPNESS
            total = weight.sum(axis=1)
            out[a: a + BLOCK] = np.where(total > 0, (weight * self.good[near]).sum(axis=1) / np.maximum(total, 1e-12), 0.0)
        return np.clip(out, 0, 1)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in _slices(whole)):
        rows = [_pack(v) for x in counts(batch) for v in x]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), batch.column("quality"), pa.array(rows, pa.binary())], names=["doc_id", "rid", "quality", "x"])


def _pack(v: np.ndarray) -> bytes:
    """The terms that occur, then their counts."""
    at = np.flatnonzero(v)
    return at.astype(np.uint16).tobytes() + v[at].tobytes()


def _unpack(packed: bytes, out: np.ndarray) -> None:
    n = len(packed) // 6
    out[np.frombuffer(packed, dtype=np.uint16, count=n)] = np.frombuffer(packed[2 * n:], dtype=np.float32)


def learn(documents: DataFrame, labels: DataFrame, may_learn: Callable[[Column], Column], sample: int = SAMPLE) -> Space | None:
    best = C.only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").where(may_learn(F.col("doc_id")))
    best = best.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    key = F.xxhash64("doc_id")
    best = materialize(best)
    chosen = C.thinned(best, key, best.count(), sample).orderBy(key, "doc_id").limit(sample)
    chosen = materialize(chosen)  # at most ``sample`` short rows
    docs = C.only(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.col("quality").cast("int").alias("quality"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    # rows that repeat an id teach once
    rows = docs.mapInArrow(_vectors, f"doc_id {kind}, rid long, quality int, x binary").groupBy("doc_id").agg(F.min_by(F.struct("quality", "x"), "rid").alias("r"))
    found = rows.select("doc_id", "r.*").orderBy("doc_id").toArrow()  # at most ``sample`` rows of some kilobytes
    if found.num_rows == 0:
        return None
    x = np.zeros((found.num_rows, WIDTH), dtype=np.float32)
    for i, packed in enumerate(found.column("x")):
        _unpack(packed.as_py(), x[i])
    good = np.asarray(found.column("quality")) == 1
    del found
    return Space(x, good)


def _score(space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(_scores(s, batch), pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def _scores(space: Space | None, batch: pa.RecordBatch) -> np.ndarray:
    parts = [np.full(len(x), 0.5) if space is None else space.score(x) for x in counts(batch)]
    return np.concatenate(parts) if parts else np.zeros(0)


def classify(documents: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows that ``held_out`` marks teach nothing."""
    space = learn(documents, labels, lambda c: ~held_out(c), sample)
    docs = C.spread(C.only(documents, "doc_id", "text")).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.mapInArrow(_score(C.broadcast(documents.sparkSession, space)), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], sample: int = SAMPLE) -> DataFrame:
    """The rows of documents that are predicted to be good, with all their columns, in one pass over them."""
    space = C.broadcast(documents.sparkSession, learn(documents, labels, lambda c: ~held_out(c), sample))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            yield batch.filter(pa.array(_scores(s, text) >= CUT))

    plain = C.numbered(documents)
    return C.named(plain.mapInArrow(run, plain.schema), documents)
