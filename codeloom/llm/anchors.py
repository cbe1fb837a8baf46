"""Anchors: places in a text that depend only on the bytes around them.

Every stretch of ``MATCH`` bytes, a window, has one anchor: of its ``GRAM``-byte
grams the one with the smallest hash, the last one of equals.  Equal windows
have their anchor at the same place, wherever they stand.  Neighbouring windows
mostly share an anchor and form a run, so a text has a run for some forty bytes.
"""

from __future__ import annotations

import numpy as np

from . import common as C

MATCH = 100
GRAM = 24
_SPAN = MATCH - GRAM + 1  # grams in a window
_AT = 22  # low bits that hold a place within a stretch
STRETCH = 1 << 21


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` neighbours, by doubling."""
    size = 1
    m = x
    while size * 2 <= n:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = n - size
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, last start, anchor, anchor hash, hash of the run's bytes) of every run in some texts.

    A run is cut where a stretch ends; so is its hash, and nothing else depends on it.
    """
    n = len(data) - MATCH + 1
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, max(0, n), STRETCH):
        part = data[lo: lo + STRETCH + MATCH - 1]
        m = len(part) - MATCH + 1
        if m <= 0:
            continue
        prefix = C.prefix_hash(part)
        _, down = C.powers(len(prefix))
        g = C.mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(prefix) - GRAM])
        # of equal hashes the later place is the smaller number
        low = C.U((1 << _AT) - 1)
        best = _sliding_min((g & ~low) | (low - np.arange(len(g), dtype=C.U)), _SPAN)[:m]
        anchor = (low - (best & low)).astype(np.int64)
        start = np.arange(m)
        text = np.searchsorted(offs, start + lo, side="right") - 1
        ok = start + lo + MATCH <= offs[text + 1]
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        a = anchor[s]
        whole = C.range_hash(prefix, s, e + MATCH) ^ C.mix((a - s).astype(C.U) + C.U(77))
        out.append((text[s], s + lo - offs[text[s]], e + lo - offs[text[s]], a + lo - offs[text[s]], g[a], whole))
    if not out:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z.astype(C.U), z.astype(C.U)
    return tuple(np.concatenate(x) for x in zip(*out))
