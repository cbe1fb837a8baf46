"""Language identification by hierarchical discrimination.

A text is the vector of its hashed byte pairs and triples, lower-cased, square
roots of counts at length one.  Linear support vector machines with squared
hinge loss first choose the language family, one family against another, and
then the language inside it, one against one; votes decide, margins break ties.

Training reads ``PER_LANGUAGE`` documents of each language, those with the
smallest hashes, whole and in a few short pieces, so that short texts are
known as well.  Every document is scored whole, and none is shuffled.

A null text or one without a letter is ``und`` with score 0, and so is every
text when there is nothing to learn from.  Rows without language teach nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C

BITS = 10
PER_LANGUAGE = 600
PIECES, PIECE = 2, 60
# Languages of one family; a language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
}


def vectors(texts: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows: one unit vector of ``2 ** BITS`` per text; zero for a text of under two bytes."""
    size = 1 << BITS
    batch = pa.RecordBatch.from_arrays([pc.utf8_lower(texts.fill_null(""))], names=["text"])
    raw, offs = C.binary_column(batch, "text")
    for i, j, data, o in C.groups(raw, offs, 1 << 20):
        counts = np.zeros((j - i) * size, dtype=np.int64)
        # a long text is counted in stretches
        for lo in range(0, len(data), 1 << 20):
            part = data[lo: lo + (1 << 20) + 2].astype(np.uint32)
            row = np.searchsorted(o, np.arange(lo, lo + len(part)), side="right") - 1
            for n in (2, 3):
                m = min(1 << 20, len(part) - n + 1)
                if m <= 0:
                    continue
                code = part[:m] * np.uint32(257) + part[1: m + 1]
                if n == 3:
                    code = code * np.uint32(263) + part[2: m + 2]
                slot = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
                same = row[:m] == row[n - 1: m + n - 1]
                counts += np.bincount((row[:m] * size + slot)[same], minlength=len(counts))
        x = np.sqrt(counts.reshape(j - i, size).astype(np.float32))
        yield x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights and bias of a squared-hinge machine, by Newton steps on the violating rows."""
    xb = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # both sides weigh the same, however many examples they have
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(xb.shape[1], dtype=np.float64)
    reg = np.full(xb.shape[1], penalty)
    reg[-1] = 1e-6

    def loss(v):
        return 0.5 * (reg * v * v).sum() + (c * np.maximum(0, 1 - y * (xb @ v)) ** 2).sum()

    for _ in range(12):
        bad = y * (xb @ w) < 1
        a = xb[bad]
        h = 2 * (a.T * c[bad]) @ a + np.diag(reg)
        goal = np.linalg.solve(h, 2 * (a.T * c[bad]) @ y[bad])
        step = 1.0
        while step > 1e-3 and loss(w + step * (goal - w)) > loss(w):
            step /= 2
        if step <= 1e-3 or np.abs(goal - w).max() < 1e-6:
            break
        w = w + step * (goal - w)
    return w.astype(np.float32)


class Model:
    """One machine per pair of families, and per pair of languages of a family."""

    def __init__(self, x: np.ndarray, lang: np.ndarray, families: dict[str, str] = FAMILIES):
        family = np.array([families.get(v, v) for v in lang], dtype=object)
        self.top = self._pairs(x, family)
        self.inside = {f: self._pairs(x[family == f], lang[family == f]) for f in sorted(set(family))}

    @staticmethod
    def _pairs(x: np.ndarray, label: np.ndarray) -> tuple[list[str], list, np.ndarray]:
        names = sorted(set(label))
        pairs = list(combinations(range(len(names)), 2))
        weights = []
        for a, b in pairs:
            rows = (label == names[a]) | (label == names[b])
            weights.append(train_svm(x[rows], np.where(label[rows] == names[a], 1.0, -1.0)))
        return names, pairs, np.array(weights, dtype=np.float32).reshape(len(pairs), x.shape[1] + 1)

    @staticmethod
    def _vote(x: np.ndarray, machines) -> tuple[np.ndarray, np.ndarray]:
        """The winner of every row and how sure its closest duel was."""
        names, pairs, w = machines
        if len(names) == 1:
            return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
        margin = x @ w[:, :-1].T + w[:, -1]
        votes = np.zeros((len(x), len(names)))
        least = np.full((len(x), len(names)), np.inf)
        for (a, b), m in zip(pairs, margin.T):
            votes[:, a] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[:, b] += (m < 0) - 1e-3 * np.tanh(m)
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        win = votes.argmax(axis=1)
        return win, 1 / (1 + np.exp(-3.0 * np.clip(least[np.arange(len(x)), win], -10, 10)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        win, sure = self._vote(x, self.top)
        out, score = np.empty(len(x), dtype=object), sure.copy()
        for f, name in enumerate(self.top[0]):
            rows = np.flatnonzero(win == f)
            if len(rows):
                inner, s = self._vote(x[rows], self.inside[name])
                out[rows] = np.array(self.inside[name][0], dtype=object)[inner]
                score[rows] *= s
        return out, score


def _examples(chosen):
    """Feature rows of the texts that a bitmap lets through: whole, and in pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(C.in_bitmap(chosen.value, np.asarray(batch.column("rid")).astype(C.U))))
            texts, rids, nth = [], [], []
            for rid, text in zip(part.column("rid").to_pylist(), part.column("text").to_pylist()):
                text = text or ""
                rng = np.random.default_rng(rid & 0xFFFFFFFF)
                cuts = [text] + [text[a: a + PIECE] for a in rng.integers(0, max(1, len(text) - PIECE), PIECES)]
                for i, t in enumerate(cuts):
                    texts.append(t)
                    rids.append(rid)
                    nth.append(i)
            x = np.concatenate(list(vectors(pa.array(texts, pa.string())))) if texts else np.zeros((0, 1 << BITS), np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids, pa.int64()), pa.array(nth, pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], names=["rid", "nth", "x"])

    return run


def learn(documents: DataFrame, may_learn: Callable[[Column], Column], per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from a bounded sample; the driver sees ``per_language`` vectors and their pieces per language."""
    docs = C.only(documents, "doc_id", "text", "lang").where(may_learn(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text", F.col("lang").alias("lang"))
    ids = materialize(C.smallest(docs.select("rid", "lang"), ["lang"], [F.col("rid")], per_language).distinct())
    bitmap = C.broadcast(documents.sparkSession, C.bitmap_of(ids, "rid"))
    rows = docs.select("rid", "text").mapInArrow(_examples(bitmap), "rid long, nth int, x binary")
    found = rows.join(ids, "rid").dropDuplicates(["rid", "nth", "lang"]).orderBy("lang", "rid", "nth").toArrow()
    if found.num_rows == 0:
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), dtype=np.float32).reshape(found.num_rows, -1)
    return Model(x, np.array(found.column("lang").to_pylist(), dtype=object))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = batch.column("text")
            langs, scores = [], []
            for x in vectors(texts):
                if m is None:
                    langs.append(np.full(len(x), "und", dtype=object))
                    scores.append(np.zeros(len(x)))
                else:
                    a, b = m.predict(x)
                    langs.append(a)
                    scores.append(b)
            lang = np.concatenate(langs) if langs else np.zeros(0, dtype=object)
            score = np.concatenate(scores) if scores else np.zeros(0)
            none = ~np.asarray(pc.match_substring_regex(texts.fill_null(""), r"\p{L}"), dtype=bool)
            lang[none], score[none] = "und", 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(documents: DataFrame, held_out: Callable[[Column], Column], per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; rows that ``held_out`` marks teach nothing."""
    model = learn(documents, lambda c: ~F.coalesce(held_out(c), F.lit(True)), per_language)
    docs = C.spread(C.only(documents, "doc_id", "text")).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(_score(C.broadcast(documents.sparkSession, model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
