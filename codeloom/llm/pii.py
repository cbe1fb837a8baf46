"""Personal data: fixed patterns, and a character tagger that adds to them.

The base patterns find e-mail addresses, IP addresses, card and phone numbers.
Windows of text around such spans, and around digits that are none, train a
bidirectional LSTM over characters with a CRF on top, in numpy, on the driver;
``WINDOWS`` windows with the smallest hashes are used, whatever the corpus.

Every document is then tagged in overlapping windows.  A span of any kind holds
a digit or an at sign, so only windows that hold one can yield a span, and only
those are run.  Each window is decoded by Viterbi; a character takes the tag of
the window in whose middle it stands most nearly, and spans are read off the
whole text.  Tagged spans that touch a base span are dropped, base spans stay.

Null texts are empty.  Without spans to learn from only the patterns count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of every kind
LENGTH, STRIDE = 64, 32
WINDOWS = 2000
HIDDEN, STEPS, BATCH, RATE = 24, 300, 48, 0.015
RUN = 512

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")

Span = tuple[int, int, int]  # kind, start, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, by kind and start.  Time is linear in the text."""
    out: list[Span] = []
    if not _HINT.search(text):
        return out
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --------------------------------------------------------------------------
# the tagger

VOCAB = 100


def encode(text: str) -> np.ndarray:
    """Characters as small numbers: printable ASCII each, then line breaks, letters beyond, others; 0 pads."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.where((p >= 32) & (p < 127), p - 31, 97)
    out[p == 10] = 96
    out[(p >= 0xC0) & (p < 0x3000)] = 98
    return out.astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Parameters and passes of the LSTM and the CRF."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 5):
        r = np.random.default_rng(seed)
        n = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.h = hidden
        self.p = {"out": n(2 * hidden, TAGS, scale=0.2), "bias": np.zeros(TAGS, np.float32), "move": n(TAGS, TAGS, scale=0.1), "first": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": n(VOCAB, 4 * hidden, scale=0.3), f"u{d}": n(hidden, 4 * hidden, scale=0.2), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden: 2 * hidden] = 1  # remember at first

    def _lstm(self, ids: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        b, t = ids.shape
        n = self.h
        h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        out = np.empty((b, t, n), np.float32)
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = self.p[f"x{d}"][ids[:, s]] + h @ self.p[f"u{d}"] + self.p[f"c{d}"]
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n:])
            before, hb = c, h
            c = gates[:, n: 2 * n] * c + gates[:, :n] * g
            tc = np.tanh(c)
            h = gates[:, 2 * n:] * tc
            out[:, s] = h
            if keep is not None:
                keep.append((s, gates, g, before, tc, hb))
        return out

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        kept = {d: [] if keep is not None else None for d in "fb"}
        hs = np.concatenate([self._lstm(ids, d, kept[d]) for d in "fb"], axis=2)
        if keep is not None:
            keep |= {"kept": kept, "hs": hs}
        return hs @ self.p["out"] + self.p["bias"]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        e = self.emissions(ids)
        b, t, k = e.shape
        best, back = e[:, 0] + self.p["first"], np.empty((b, t, k), np.int64)
        for s in range(1, t):
            step = best[:, :, None] + self.p["move"]
            back[:, s] = step.argmax(axis=1)
            best = step.max(axis=1) + e[:, s]
        tags = np.empty((b, t), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for s in range(t - 1, 0, -1):
            tags[:, s - 1] = back[np.arange(b), s, tags[:, s]]
        return tags

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of windows and its gradients."""
        keep: dict = {}
        e = self.emissions(ids, keep)
        b, t, k = e.shape
        move, rows = self.p["move"], np.arange(b)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + self.p["first"]
        for s in range(1, t):
            alpha[:, s] = _lse(alpha[:, s - 1][:, :, None] + move, 1) + e[:, s]
        for s in range(t - 2, -1, -1):
            beta[:, s] = _lse(move + (e[:, s + 1] + beta[:, s + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        gold = self.p["first"][tags[:, 0]] + np.take_along_axis(e, tags[:, :, None], 2).sum((1, 2)) + move[tags[:, :-1], tags[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, None, None])
        g = {"first": (de[:, 0].sum(0) - np.bincount(tags[:, 0], minlength=k)) / b}
        pair = np.zeros((k, k))
        for s in range(1, t):
            pair += np.exp(alpha[:, s - 1][:, :, None] + move + (e[:, s] + beta[:, s] - z[:, None])[:, None, :]).sum(0)
        seen = np.bincount((tags[:, :-1] * k + tags[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
        g["move"] = (pair - seen) / b
        de[rows[:, None], np.arange(t), tags] -= 1
        de /= b
        g["out"] = keep["hs"].reshape(-1, 2 * self.h).T @ de.reshape(-1, k)
        g["bias"] = de.sum((0, 1))
        dh_all = de @ self.p["out"].T
        n = self.h
        for d, part in (("f", dh_all[:, :, :n]), ("b", dh_all[:, :, n:])):
            gx, gu, gc = (np.zeros_like(self.p[f"{x}{d}"]) for x in "xuc")
            dh, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
            for s, gates, gg, before, tc, hb in reversed(keep["kept"][d]):
                i, f, o = gates[:, :n], gates[:, n: 2 * n], gates[:, 2 * n:]
                dh = dh + part[:, s]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                np.add.at(gx, ids[:, s], dz)
                gu += hb.T @ dz
                gc += dz.sum(0)
                dh, dc = dz @ self.p[f"u{d}"].T, dc * f
            g |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return float((z - gold).mean()), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 7) -> Tagger:
        """Adam over random batches, with the rate falling to zero."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            pick = r.integers(0, len(ids), BATCH)
            _, g = self.loss(ids[pick], tags[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = RATE * (1 - step / (steps + 1))
            for k, x in g.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


# --------------------------------------------------------------------------
# windows


def _window(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(LENGTH, dtype=np.int64)
    part = codes[start: start + LENGTH]
    out[: len(part)] = part
    return out


def _tags_of(n: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(n, dtype=np.int64)
    for kind, a, b in spans:
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def _lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with tags: around base spans, around other digits, and anywhere."""
    for batch in batches:
        rids, nth, ids, tags = [], [], [], []
        for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist()):
            text = text or ""
            hints = [m.start() for m in _HINT.finditer(text)]
            if not hints:
                continue
            spans = base_spans(text)
            codes, gold = encode(text), _tags_of(len(text), spans)
            r = np.random.default_rng(rid & 0xFFFFFFFF)
            places = [a for _, a, _ in spans for _ in range(2)] + [hints[int(r.integers(len(hints)))], int(r.integers(len(text)))]
            for i, p in enumerate(places[:64]):
                start = max(0, min(p - int(r.integers(4, LENGTH - 8)), len(text) - LENGTH))
                rids.append(rid)
                nth.append(i)
                ids.append(_window(codes, start).astype(np.uint8).tobytes())
                tags.append(_window(gold, start).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(nth, pa.int32()), pa.array(ids, pa.binary()), pa.array(tags, pa.binary())], names=["rid", "nth", "ids", "tags"])


def learn(documents: DataFrame, windows: int = WINDOWS) -> Tagger | None:
    """A tagger from at most ``windows`` windows."""
    docs = C.only(documents, "doc_id", "text").select(F.xxhash64("doc_id", "text").alias("rid"), "text").where(F.col("text").rlike("[0-9@]"))
    # a text with a hint gives two windows or more
    docs = C.thinned(docs, F.col("rid"), docs.count(), windows)
    found = (
        C.spread(docs).mapInArrow(_lessons, "rid long, nth int, ids binary, tags binary")
        .orderBy(F.xxhash64("rid", "nth"), "rid", "nth").limit(windows).toArrow())
    if found.num_rows == 0:
        return None
    ids, tags = (np.frombuffer(b"".join(found.column(c).to_pylist()), dtype=np.uint8).reshape(-1, LENGTH).astype(np.int64) for c in ("ids", "tags"))
    return Tagger().fit(ids, tags) if tags.any() else None


def window_starts(text: str) -> list[int]:
    """Starts of overlapping windows that hold a digit or an at sign, on one grid."""
    last = max(0, len(text) - LENGTH)
    out: set[int] = set()
    for m in _HINT.finditer(text):
        k = m.start() // STRIDE
        out.update(min(x * STRIDE, last) for x in range(max(0, k - LENGTH // STRIDE + 1), k + 1))
    return sorted(out)


def read_spans(tags: dict[int, int]) -> list[Span]:
    """Spans of a text from the tags of its tagged characters."""
    out: list[Span] = []
    kind, start, end = -1, 0, 0
    for p in sorted(tags):
        t = tags[p]
        mine = (t - 1) // 2 if t else -1
        goes_on = kind >= 0 and p == end and mine == kind and t % 2 == 0
        if goes_on:
            end += 1
            continue
        if kind >= 0:
            out.append((kind, start, end))
        kind, start, end = mine, p, p + 1
    if kind >= 0:
        out.append((kind, start, end))
    return out


def _valid(text: str, s: Span) -> bool:
    part = text[s[1]: s[2]]
    if len(part) < 5 or not _HINT.search(part):
        return False
    return "@" in part if s[0] == 0 else sum(c.isdigit() for c in part) >= 4


def add_spans(tagger: Tagger | None, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """For each text the tagged spans that touch no base span."""
    out: list[list[Span]] = [[] for _ in texts]
    if tagger is None:
        return out
    for d, text in enumerate(texts):
        starts = window_starts(text)
        if not starts:
            continue
        codes = encode(text)
        best: dict[int, tuple[int, int]] = {}
        for a in range(0, len(starts), RUN):
            part = starts[a: a + RUN]
            tags = tagger.decode(np.stack([_window(codes, s) for s in part]))
            for s, row in zip(part, tags):
                for q in range(min(LENGTH, len(text) - s)):
                    margin = min(q, LENGTH - 1 - q)
                    if (s + q) not in best or margin > best[s + q][0]:
                        best[s + q] = (margin, int(row[q]))
        for s in read_spans({p: t for p, (_, t) in best.items()}):
            if _valid(text, s) and not any(s[1] < b[2] and b[1] < s[2] for b in base[d]):
                out[d].append(s)
    return out


def _names(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _spans_of(tagger: Tagger | None, texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    base = [base_spans(t) for t in texts]
    return base, add_spans(tagger, texts, base)


def find(documents: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """Per row of documents: doc_id, base (names of base spans), spans (names of all), n_email, n_ip, n_card, n_phone."""
    tagger = C.broadcast(documents.sparkSession, learn(documents, windows))
    docs = C.spread(C.only(documents, "doc_id", "text"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = _spans_of(tagger.value, [t or "" for t in batch.column("text").to_pylist()])
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([_names(b) for b in base], pa.string()), pa.array([_names(b + m) for b, m in zip(base, more)], pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def report(documents: DataFrame) -> DataFrame:
    return find(documents).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def _masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out.append(text[at:max(at, a)])
        if a >= at:
            out.append(f"[{KINDS[kind]}]")
        at = b
    return "".join(out) + text[at:]


def mask(documents: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """The same rows with every span replaced by its kind in brackets; ``n_chars``, if there, follows the text."""
    tagger = C.broadcast(documents.sparkSession, learn(documents, windows))
    at = documents.columns.index("text")
    n_at = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            base, more = _spans_of(tagger.value, [t or "" for t in texts])
            after = [t if not (b or m) else _masked(t, b + m) for t, b, m in zip(texts, base, more)]
            cols = list(batch.columns)
            cols[at] = pa.array(after, batch.schema.field(at).type)
            if n_at is not None:
                sizes = [n if t == u else len(u) for n, t, u in zip(batch.column(n_at).to_pylist(), texts, after)]
                cols[n_at] = pa.array(sizes, batch.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    plain = C.numbered(documents)
    return C.named(plain.mapInArrow(run, plain.schema), documents)
