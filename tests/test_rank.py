import math

import pytest
from graphs import edges, nodes, simple
from pyspark.sql import functions as F

from codeloom.operators import ask as A
from codeloom.operators import lexical as L
from codeloom.operators.fuse import fuse_scopes
from codeloom.operators.pagerank import personalized_pagerank
from codeloom.sources import tables as S


def pr(spark, n, e, seeds, **kw):
    s = spark.createDataFrame(list(seeds.items()), "id string, weight double")
    return {r.id: r.pr for r in personalized_pagerank(n, e, s, **kw).collect()}


CHAIN = [("a", "b"), ("b", "c")]


def test_golden_values(spark):
    got = pr(spark, simple(spark, "abcde"), edges(spark, CHAIN), {"a": 2.0, "d": 1.0})
    want = {"a": 0.9577162737326514, "b": 1.0, "c": 0.37462976423958994, "d": 0.2915432547}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


@pytest.mark.parametrize("per_salt", [1, 10_000])
def test_splitting_hot_nodes_changes_nothing(spark, per_salt, monkeypatch):
    from codeloom.operators import adjacency as AD
    from codeloom.operators import pagerank as P

    spokes = [f"s{i}" for i in range(30)]
    n = simple(spark, ["hub", *spokes, "lone"])
    e = edges(spark, [("hub", s) for s in spokes] + [("s1", "s2", "imports"), ("s1", "s2")])
    want = pr(spark, n, e, {"s1": 1.0, "lone": 0.5})
    monkeypatch.setattr(P, "adjacency", lambda links, _per, fan=None: AD.adjacency(links, per_salt, 3, fan))
    got = pr(spark, n, e, {"s1": 1.0, "lone": 0.5})
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_connected_beats_isolated_and_multi_edges_count(spark):
    n = simple(spark, ["hub", "a", "b", "c", "lone"])
    e = edges(spark, [("hub", "a"), ("hub", "b"), ("hub", "c"), ("hub", "missing"), ("hub", "lone", "contains")])
    got = pr(spark, n, e, {"hub": 1.0, "lone": 1.0})
    assert got["hub"] == 1.0 and got["hub"] > got["lone"]
    assert "missing" not in got


def test_groups_are_walked_apart(spark):
    n = simple(spark, "abcxyz").withColumn("scope", F.when(F.col("id").isin("a", "b", "c"), "l").otherwise("r"))
    e = edges(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("c", "x")])
    got = pr(spark, n, e, {"a": 1.0, "x": 3.0, "y": 1.0}, by=["scope"])
    left = pr(spark, n.where("scope = 'l'"), e, {"a": 1.0})
    right = pr(spark, n.where("scope = 'r'"), e, {"x": 3.0, "y": 1.0})
    for k, v in {**left, **right}.items():
        assert got[k] == pytest.approx(v, abs=1e-12)


def test_no_seed_gives_nothing(spark):
    assert pr(spark, simple(spark, "ab"), edges(spark, [("a", "b")]), {"zz": 1.0}) == {}


def test_bm25_and_idf_by_hand(spark):
    docs = nodes(spark, [
        ("a#alpha", "function", "a/x.py", {"body_text": "token token other"}),
        ("b#beta", "function", "b/y.py", {"body_text": "other"}),
    ])
    hits = {r.id: r.lex for r in L.score_corpus(docs, "token", []).hits.collect()}
    idf = math.log(1 + 2 / (1 + 1))
    # "beta" has body length 1, "alpha" 3
    norm = 1.2 * (1 - 0.75 + 0.75 * 3 / 2.0)
    assert hits == {"a#alpha": pytest.approx(idf * 2 * 2.2 / (2 + norm))}


def test_index_and_text_give_the_same_scores(spark):
    sf = "/root/testdata/sf0.001"
    docs = S.document_nodes(spark, sf)
    post = L.postings(docs)
    index = L.TokenIndex(post, L.body_lengths(docs, post))
    query = "attion la elle mit src3"
    live = {r.id: (r.lex, r.coverage) for r in L.score_corpus(docs, query, []).hits.collect()}
    stored = {r.id: (r.lex, r.coverage) for r in L.score_corpus(docs, query, [], index=index).hits.collect()}
    assert live.keys() == stored.keys() and len(live) > 10
    for k in live:
        assert stored[k] == pytest.approx(live[k], abs=1e-12)


def test_tests_sink_below_the_source(spark):
    docs = nodes(spark, [
        ("s#download", "function", "src/download.py", {"body_text": "download stall"}),
        ("t#test_download", "function", "tests/test_download.py", {"body_text": "download stall stall"}),
    ])
    rows = {r.id: r.lex for r in L.score_corpus(docs, "download stall", []).hits.collect()}
    assert rows["s#download"] > rows["t#test_download"]
    rows = {r.id: r.lex for r in L.score_corpus(docs, "download stall tests", []).hits.collect()}
    assert rows["t#test_download"] > rows["s#download"]


def test_rescue_brings_in_the_unnamed_neighbour(spark):
    n = nodes(spark, [("a#pack", "function", "a.py"), ("b#pack_all", "function", "b.py"), ("c#settings", "function", "c.py"), ("d#far", "function", "d.py")])
    e = edges(spark, [("a#pack", "c#settings"), ("b#pack_all", "c#settings")])
    ids = [r.id for r in A.rank_nodes(n, e, "pack").hits.collect()]
    assert "c#settings" in ids and "d#far" not in ids
    assert "c#settings" not in [r.id for r in A.rank_nodes(n, None, "pack").hits.collect()]


def test_ask_merges_concepts_and_scopes(spark):
    n = nodes(spark, [(f"front/m{i}.ts#login_{i}", "function", f"front/m{i}.ts") for i in range(6)]
              + [(f"back/m{i}.py#{'login_' if i == 0 else 'other_'}{i}", "function", f"back/m{i}.py") for i in range(30)])
    concepts = spark.createDataFrame(
        [("sign-in", "Login flow", ["front/m0.ts"], ["x"], "How login works", "Login flow How login works front/m0.ts")],
        "slug string, name string, sources array<string>, related array<string>, snippet string, text string")
    hits, ranking = A.ask(n, None, "login", 20, ["front", "back"], None, concepts)
    rows = hits.collect()
    assert {r.scope for r in rows if r.kind == "symbol"} == {"front", "back"}
    assert [r.title for r in rows if r.kind == "concept"] == ["Login flow"]
    assert {r.scope for r in ranking.federated.collect()} == {"front", "back"}
    narrowed, _ = A.ask(n, None, "login", 20, ["front", "back"], "back/")
    assert {r.pointer.split("/")[0] for r in narrowed.collect()} == {"back"}


# --------------------------------------------------------------------------
# fusion


def fused(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, scope string, score double")
    return fuse_scopes(df, **kw)


def test_single_scope_keeps_scores(spark):
    f = fused(spark, [("a", "s", 7.0), ("b", "s", 2.0), ("z", "s", 0.0)])
    assert {(r.id, r.score) for r in f.ranked.collect()} == {("a", 7.0), ("b", 2.0)}


def test_ranks_not_scores_decide_and_the_gate_is_inclusive(spark):
    f = fused(spark, [("a1", "a", 4.0), ("a2", "a", 3.9), ("b1", "b", 1.0), ("c1", "c", 0.99)])
    rows = sorted(((r.id, r.scope, r.score) for r in f.ranked.collect()), key=lambda r: (-r[2], r[1], r[0]))
    assert [r[0] for r in rows] == ["a1", "b1", "a2"]
    assert rows[0][2] == 1.0 and rows[2][2] == pytest.approx((1 / 62) / (1 / 61))
    assert [(r.scope, r.best_id) for r in f.also_matched.collect()] == [("c", "c1")]


def test_shared_ids_sum_and_belong_where_they_rank_best(spark):
    f = fused(spark, [("x", "a", 1.0), ("y", "a", 0.9), ("y", "b", 1.0), ("z", "b", 0.5)])
    rows = {r.id: (r.scope, r.score) for r in f.ranked.collect()}
    assert rows["y"] == ("b", 1.0)
    assert rows["x"][1] == pytest.approx((1 / 61) / (1 / 62 + 1 / 61))


def test_top_rows_of_disjoint_scopes_are_enough(spark):
    rows = [(f"{s}{i}", s, float(100 - i)) for s in "abc" for i in range(40)]
    whole = [(r.id, r.score) for r in fused(spark, rows).ranked.orderBy(F.col("score").desc(), "scope", "id").limit(9).collect()]
    cut = [(r.id, r.score) for r in fused(spark, rows, limit=9, disjoint=True).ranked.orderBy(
        F.col("score").desc(), "scope", "id").limit(9).collect()]
    assert whole == cut
