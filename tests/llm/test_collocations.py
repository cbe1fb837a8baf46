"""Phrases against a plain count of everything."""

import random
import re
from collections import Counter

import odd
import pytest

from codeloom.llm import collocations


def plain(rows, support, first):
    """rows: (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i: i + k])] += 1
    cand = {p: a for p, a in f.items() if a >= support and len(p[1]) > 1}
    out = []
    for (lang, w), a in cand.items():
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(m == lang and len(x) > len(w) and 100 * b >= 80 * a and any(x[i: i + len(w)] == w for i in range(len(x)))
                     for (m, x), b in cand.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    ranked, place = [], Counter()
    for lang, s, a, phrase, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= first:
            ranked.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -s))
    return ranked


@pytest.mark.parametrize("sample", [1, 3, 10**6])
def test_against_plain_counts(spark, odd_docs, sample, monkeypatch):
    """A sample of everything, of a third, and of next to nothing, where all is found by widening the border."""
    monkeypatch.setattr(collocations, "HELD", 500)
    rng = random.Random(4)
    words = ["new", "York", "ice", "cream", "é", "of", "the", "x"]
    extra = [" ".join(rng.choice(words) for _ in range(60)) + rng.choice([". ", ",\tNew york times: ", "\rice  cream"]) * 3 for _ in range(60)]
    docs = odd.documents(spark, extra)
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    support, first = 6, 150
    got = [tuple(r) for r in collocations.collocations(docs, support, first, sample).collect()]
    want = plain(rows, support, first)
    assert len(want) > 200 and any(len(w[2].split(" ")) == 4 for w in want)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_exact_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("4000000000000000000L AS a", "4100000000000000000L AS l", "9000000000000000000L AS r")
    assert row.selectExpr("(2000000BD * a) div (cast(l as decimal(20, 0)) + r) AS s").first().s == 2000000 * 4 * 10**18 // (131 * 10**17)


def test_nothing(spark):
    assert collocations.collocations(odd.empty(spark)).count() == 0
