"""What the making of blocks and the steps over them leave on disk."""

import os
import random

import pytest

from codeloom.operators import blocks as BL
from codeloom.operators.pagerank import personalized_pagerank
from codeloom.session import checkpoint_dir


@pytest.fixture(scope="module")
def graph(spark):
    dice = random.Random(2)
    pairs = [(f"v{dice.randrange(300)}", f"v{dice.randrange(310)}", "calls") for _ in range(700)]
    n = spark.createDataFrame([(f"v{i}", f"g{i % 2}") for i in range(300)], "id string, scope string")
    e = spark.createDataFrame(pairs, "source string, target string, relation string")
    return n, e, spark.createDataFrame([("v1", 2.0), ("v2", 1.0)], "id string, weight double")


def ranked(*args, **kw):
    return {r.id: r.pr for r in personalized_pagerank(*args, iterations=5, **kw).collect()}


@pytest.mark.parametrize("by", [[], ["scope"]])
def test_blocks_packed_in_rounds_and_stored_steps_give_the_same_ranks(spark, graph, tmp_path, monkeypatch, by):
    n, e, seeds = graph
    for name, value in (("LINKS_PER_TASK", 10), ("LINKS_PER_BLOCK", 60), ("NUMBERS_KEPT", 1)):
        monkeypatch.setattr(BL, name, value)
    blocks = BL.build(n, e, str(tmp_path / "b"), by)
    assert by or len(blocks.keys) >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(f for f in os.listdir(tmp_path / "b")) == ["blocks", "ids"]
    got, want = ranked(None, None, seeds, by=by, links=blocks), ranked(n, e, seeds, by=by)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_disk_holds_the_last_step_only(spark, graph, tmp_path, monkeypatch):
    n, e, seeds = graph
    monkeypatch.setattr(BL, "NUMBERS_KEPT", 1)
    blocks = BL.build(n, e, str(tmp_path / "b"))
    start = blocks.linked().limit(3).selectExpr("n", "1.0D as w", "0.0D as q").localCheckpoint()
    BL.ranks(blocks, start, 0.25, 4, 0.0, str(tmp_path / "s")).collect()
    assert os.listdir(tmp_path / "s") == ["3"]
    ranked(None, None, seeds, links=blocks)
    left = f"{checkpoint_dir(spark).removeprefix('file:')}/steps"
    assert not os.path.exists(left) or not os.listdir(left)
