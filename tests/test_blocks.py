"""Links in square blocks: ranks equal those of the loop of joins, and no link moves in a step."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import blocks as BL
from codeloom.operators.pagerank import personalized_pagerank


@pytest.fixture(scope="module")
def graph(spark):
    dice = random.Random(1)
    ids = [*[(f"v{i}", f"g{i % 2}") for i in range(200)], ("hub", "g0"), ("lone", "g1")]
    pairs = [(f"v{dice.randrange(200)}", f"v{dice.randrange(210)}") for _ in range(600)]
    pairs += [("hub", f"v{i}") for i in range(150)] + [("v3", "v3"), ("v1", "v2"), ("v1", "v2")]
    n = spark.createDataFrame(ids, "id string, scope string")
    e = spark.createDataFrame([(s, t, "calls") for s, t in pairs] + [("v1", "lone", "contains")], "source string, target string, relation string")
    seeds = spark.createDataFrame([("v1", 2.0), ("v2", 1.0), ("lone", 1.0), ("nobody", 3.0)], "id string, weight double")
    return n, e, seeds


@pytest.mark.parametrize("by", [[], ["scope"]])
def test_blocks_give_the_same_ranks(graph, tmp_path, monkeypatch, by):
    n, e, seeds = graph
    monkeypatch.setattr(BL, "LINKS_PER_TASK", 300)
    blocks = BL.build(n, e, str(tmp_path / "b"), by)
    assert len(blocks.keys) > 1
    got = {r.id: r.pr for r in personalized_pagerank(None, None, seeds, by, links=blocks).collect()}
    want = {r.id: r.pr for r in personalized_pagerank(n, e, seeds, by).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_a_step_over_blocks_moves_no_link(graph, tmp_path, monkeypatch):
    n, e, _ = graph
    monkeypatch.setattr(BL, "LINKS_PER_TASK", 300)
    blocks = BL.build(n, e, str(tmp_path / "b"))
    start = blocks.linked().limit(1).select("n", F.lit(1.0).alias("w"), F.lit(0.0).alias("q"))
    plan = BL.ranks(blocks, start, 0.25, 1, 0.0)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scans = [i for i, line in enumerate(lines) if "out_rank" in line and "FileScan" in line]
    assert len(scans) == 2 and plan.count("FlatMapCoGroups") == 2
    for i in scans:
        last = max(j for j in range(i) if "FlatMapCoGroups" in lines[j])
        assert "Bucketed: true" in lines[i] and "Exchange" not in "".join(lines[last + 1:i])


def test_a_node_with_too_many_links_stays_out_of_blocks(graph, tmp_path, monkeypatch):
    n, e, _ = graph
    monkeypatch.setattr(BL, "LINKS_PER_BLOCK", 20)
    assert BL.build(n, e, str(tmp_path / "b")) is None


def test_rows_without_an_id_are_no_node(spark, tmp_path):
    n = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    e = spark.createDataFrame([("a", "b", "calls"), ("a", None, "calls"), (None, "b", "calls")], "source string, target string, relation string")
    blocks = BL.build(n, e, str(tmp_path / "b"))
    assert sorted(r.id for r in blocks.ids.collect()) == ["a", "b"] and blocks.linked().count() == 2
    assert blocks.packed.where(F.col("other") == BL.OWN).select(F.length("nodes")).first()[0] == 16
