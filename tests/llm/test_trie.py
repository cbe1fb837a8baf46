"""The conversation prefix trie against its plain version."""

import random

import plain_trie
import pytest

from codeloom.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n bigint, block int, d1 string, total string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, 7, "x", None) for r in rows], SCHEMA)


def odd_rows():
    rng = random.Random(5)
    rows = []
    for c in [*range(195, 330), -5, -100, -3, 0, 7]:
        opening = rng.choice([[], ["hi"], ["hi", "there"], ["hi", "there", "you"]])
        n = rng.randint(0, 7) or 1
        for t, text in enumerate([*opening, *[f"é{rng.randint(0, 2)}" for _ in range(n)]]):
            rows.append((c, t, ["user", "assistant"][t % 2], text))
    rows += [(None, 0, "user", "lost"), (203, None, None, None), (203, None, "user", "early"), (204, 3, "user", "tie b"), (204, 3, "user", "tie a")]
    rows += [(205, 1, "user", "again")] * 40 + [(c, 9, "user", "same end") for c in range(210, 260)]
    rows += [(c, t, "user", f"turn {t} " * 50) for c in (400, 401, 500) for t in range(300)]  # long ones, two of them alike
    return rows


def by_key(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("bits", [prefix_trie.SKETCH_BITS, 64])
def test_odd_conversations(spark, bits, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_BITS", min(bits, prefix_trie.LEAST_BITS))
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 3)
    rows = odd_rows()
    turns, convs = prefix_trie.rebuilt(frame(spark, rows))
    got = prefix_trie.trie(turns, convs, bits)
    assert by_key(tuple(r) for r in got.collect()) == by_key(plain_trie.nodes(rows))


def test_no_conversations(spark):
    assert prefix_trie.report(frame(spark, [])).count() == 0
    assert prefix_trie.report(frame(spark, [(None, 1, "user", "x")])).count() == 0
