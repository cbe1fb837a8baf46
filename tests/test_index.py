"""The token index after changes equals one made afresh, and a change writes as little as it changes."""

import os

from graphs import nodes

from codeloom.operators import lexical as L
from codeloom.sources.token_index import TokenStore, entries


def state(spark, words):
    return nodes(spark, [(f"src/{i}.py#f{i}", "function", f"src/{i}.py", {"body_text": w}) for i, w in words.items()])


def contents(store):
    index = store.index()
    return (sorted(map(tuple, index.postings.collect())), sorted(map(tuple, index.body_lengths.collect())),
            sorted(map(tuple, index.frequencies.collect())), index.n_docs, round(index.avgdl, 9))


def test_texts_are_read_once(spark, tmp_path):
    """All fields come from one scan, and rows are written where they were grouped, not computed again to be spread."""
    at = str(tmp_path / "docs")
    state(spark, {1: "alpha beta", 2: "beta"}).write.parquet(at)
    plan = entries(spark.read.parquet(at))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    store = TokenStore(spark, str(tmp_path / "i")).update("v1", spark.read.parquet(at))
    for f in os.listdir(tmp_path / "i" / "v1" / "postings"):
        if f.endswith(".parquet"):
            tokens = [r[0] for r in spark.read.parquet(str(tmp_path / "i" / "v1" / "postings" / f)).select("token").collect()]
            assert tokens == sorted(tokens)
    assert store.index().n_docs == 2


def test_changes_add_up(spark, tmp_path):
    first = {i: f"alpha beta{i % 7} gamma gamma word{i}" for i in range(60)}
    store = TokenStore(spark, str(tmp_path / "i")).update("v1", state(spark, first))
    second = {**first, 3: "alpha alpha changed", 4: "", 99: "entirely new words"}
    del second[5]
    after = store.update("v2", state(spark, second))
    assert contents(after) == contents(TokenStore(spark, str(tmp_path / "j")).update("v1", state(spark, second)))
    # only the four documents that differ were written, and the old state is still readable
    assert [n for n, _ in after.live] == ["v1", "v2"] and after.live[1][1] < 40
    assert contents(store) == contents(TokenStore(spark, str(tmp_path / "k")).update("v1", state(spark, first)))

    ids = state(spark, {7: ""}).select("id")
    gone = after.update("v3", state(spark, {7: ""}).limit(0), ids)  # named as changed, and no longer there
    assert len(gone.live) == 2  # the two small changes are one by now
    third = {i: w for i, w in second.items() if i != 7}
    assert contents(gone) == contents(TokenStore(spark, str(tmp_path / "l")).update("v1", state(spark, third)))
    assert os.path.isdir(tmp_path / "i" / "v1")


def test_scores_from_stored_statistics(spark, tmp_path):
    docs = state(spark, {1: "token token other", 2: "other", 3: "tokens elsewhere", 4: "nothing"})
    index = TokenStore(spark, str(tmp_path / "i")).update("v1", docs).index()
    kept = ["id", "lex", "coverage", "coverage_strong"]
    want = sorted(map(tuple, L.score_corpus(docs, "token other", []).hits.select(*kept).collect()))
    scored = L.score_corpus(docs.drop("body_text"), "token other", [], index=index, whole=True)
    assert sorted(map(tuple, scored.hits.select(*kept).collect())) == want
    assert scored.matches.count() == 4  # what the rescue of unmatched nodes may ask for
