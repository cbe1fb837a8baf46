"""A change of most documents is written once, and additions alone are read without sums."""

import os
import random

from pyspark.sql import functions as F

from codeloom.sources.token_index import TokenStore, entries
from test_index import contents, state


def test_most_documents_change(spark, tmp_path):
    first = {i: f"alpha beta{i % 3} word{i}" for i in range(20)}
    store = TokenStore(spark, str(tmp_path / "i")).update("v1", state(spark, first))
    second = {i: w + " more more" if i % 4 else w for i, w in first.items() if i != 3} | {50: "new"}
    after = store.update("v2", state(spark, second))
    assert [n for n, _ in after.live] == ["v2-merged"] and sorted(os.listdir(tmp_path / "i")) == ["v1", "v2-merged"]
    assert contents(after) == contents(TokenStore(spark, str(tmp_path / "j")).update("v1", state(spark, second)))
    assert contents(store) == contents(TokenStore(spark, str(tmp_path / "k")).update("v1", state(spark, first)))


def test_additions_are_read_without_sums(spark, tmp_path):
    first = {i: f"alpha beta{i % 3} word{i} " + "long " * 9 for i in range(40)}
    store = TokenStore(spark, str(tmp_path / "i")).update("v1", state(spark, first))
    added = store.update("v2", state(spark, first | {50: "alpha new"}))
    plan = added.index().postings._jdf.queryExecution().executedPlan().toString()
    assert len(added.live) == 2 and "Exchange" not in plan
    assert contents(added) == contents(TokenStore(spark, str(tmp_path / "j")).update("v1", state(spark, first | {50: "alpha new"})))
    taken = {i: w for i, w in first.items() if i != 7}
    gone = store.update("v2b", state(spark, taken))
    assert len(gone.live) == 2 and contents(gone) == contents(TokenStore(spark, str(tmp_path / "k")).update("v1", state(spark, taken)))


def test_a_token_counts_once_in_the_first_field_that_holds_it(spark):
    dice = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "the", "x", "omega"]

    def text(n):
        return " ".join(dice.choice(words) for _ in range(n))

    docs = [(f"d{i}", text(4), "/".join(text(2).split()), text(i % 9)) for i in range(30)] + [("e", None, None, None), (None, "alpha", "beta", "gamma")]
    df = spark.createDataFrame(docs, "id string, name string, path string, body_text string")
    got = sorted((r.id, r.field, r.token, r.fresh, r.tf) for r in entries(df).where("token <> ''").collect())
    want = []
    for id_, *fields in docs[:-2]:
        seen = set()
        for f, t in zip(("name", "path", "body"), fields):
            found = [w for w in t.replace("/", " ").split() if w not in ("the", "x")]
            want += [(id_, f, w, w not in seen, found.count(w)) for w in set(found)]
            seen |= set(found)
    assert got == sorted(want)
    lengths = {r.id: (r.tf, r.sign) for r in entries(df).where("token = ''").collect()}
    assert lengths["e"] == (0, 1) and len(lengths) == 31 and df.where(F.col("id").isNull()).count() == 1
