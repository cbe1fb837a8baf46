"""SimHash near-duplicates against a plain version over all pairs."""

import random
import re

import odd
import pytest
import xxhash

from codeloom.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = max(1, len(words) - 2) if words else 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i: i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_components(fps):
    """The smallest member of each fingerprint's component."""
    comp = {f: f for f in fps}

    def root(f):
        while comp[f] != f:
            f = comp[f]
        return f

    todo = sorted(comp)
    for i, f in enumerate(todo):
        for g in todo[:i]:
            if (f ^ g).bit_count() <= 3 and root(f) != root(g):
                comp[max(root(f), root(g))] = min(root(f), root(g))
    return {f: root(f) for f in fps}


def test_odd_documents(spark, odd_docs):
    rng = random.Random(2)
    base = odd.words_of(rng, 300, 9000).split(" ")
    extra = []
    for i in range(30):
        base = [*base]
        base[rng.randrange(300)] = f"edit{i}"
        extra.append(" ".join(base))
    docs = odd.documents(spark, [*extra, "A b", "a B", "a\vb"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(set(fps))
    least = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            least[comp[f]] = min(d, least.get(comp[f], d))
    want = [(d, f"{f:016x}", least.get(comp[f])) for (d, _), f in zip(rows, fps)]
    got = [tuple(r) for r in simhash.report(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len(set(comp.values())) < len(set(fps))  # some are linked
    assert simhash.report(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("long", [simhash.LONG, 5])
def test_links(spark, monkeypatch, long):
    """Chains of one to four changed bits, in lists of the index that are long and short."""
    monkeypatch.setattr(simhash, "LONG", long)
    monkeypatch.setattr(simhash, "ROWS", 3)
    rng = random.Random(9)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 4])):
                f ^= 1 << b
    crowd = rng.getrandbits(64)
    fps |= {crowd ^ rng.getrandbits(64) & 0xFFFFFF0000000000 for _ in range(60)}
    fps |= {crowd ^ rng.getrandbits(12) << 20 for _ in range(60)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long").repartition(3)).collect()
    mask = (1 << 64) - 1
    joined = {f: f for f in fps}

    def root(f):
        while joined[f] != f:
            f = joined[f]
        return f

    for a, b in found:
        a, b = a & mask, b & mask
        assert 0 < (a ^ b).bit_count() <= 3
        joined[max(root(a), root(b))] = min(root(a), root(b))
    assert {f: root(f) for f in fps} == plain_components(fps)


def test_many_near_copies_report_few_links():
    import numpy as np

    fps = np.array([sum(1 << b for b in c) for c in simhash.combinations(range(14), 3)], dtype=np.uint64)
    for find in (simhash._compare, simhash._look_up):
        assert len(find(fps)) <= len(fps) - 1
    assert len(simhash._compare(fps)) == len(simhash._look_up(fps))
