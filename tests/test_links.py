"""Stored link tables: equal to walks over the edges, and only read by questions."""

import pytest
from graphs import edges, simple
from pyspark.sql import functions as F

from codeloom.operators import links as LN
from codeloom.operators import walk as W
from codeloom.operators.pagerank import personalized_pagerank

WIRES = [("a", "b"), ("b", "c"), ("c", "a", "imports"), ("c", "d"), ("d", "d"), ("hub", "a"), ("gone", "b"), ("e", "gone", "imports"), ("a", "x", "contains")]
SPOKES = [(f"s{i}", "hub") for i in range(40)]


@pytest.fixture(scope="module", params=[(1, 1000), (3, 4)])
def stored(request, spark, tmp_path_factory):
    """Sources of one row and of many rows over many salts."""
    from codeloom.operators import adjacency as AD

    per_salt, per_row = request.param
    n = simple(spark, ["a", "b", "c", "d", "e", "hub", "lone", *[s for s, _ in SPOKES]])
    e = edges(spark, [*WIRES, *SPOKES])
    at = str(tmp_path_factory.mktemp("links") / "v")
    links, rows = LN.number(n, e, at), AD.LINKS_PER_ROW
    AD.pack.__defaults__ = (per_salt, per_row)
    AD.adjacency.__defaults__ = (per_salt, per_row, None)
    try:
        for way in LN.WAYS:
            links = LN.add(links, way, e, at, per_salt if per_row > 100 else 3)
    finally:
        AD.pack.__defaults__ = (AD.LINKS_PER_SALT, rows)
        AD.adjacency.__defaults__ = (AD.LINKS_PER_SALT, rows, None)
    return n, e, links, at


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("direction", ["in", "out"])
def test_walks_are_the_same(spark, stored, direction):
    n, e, links, _ = stored
    seeds = n.where("id in ('b', 'hub')").select("id", F.col("id").alias("symbol"))
    for depth in (1, None):
        assert rows(W.impact(None, seeds, depth, direction, links=links)) == rows(W.impact(e, seeds, depth, direction))


def test_ranks_are_the_same(spark, stored):
    n, e, links, _ = stored
    seeds = spark.createDataFrame([("a", 1.0), ("lone", 2.0), ("nobody", 3.0)], "id string, weight double")
    got = {r.id: r.pr for r in personalized_pagerank(None, None, seeds, links=links).collect()}
    want = {r.id: r.pr for r in personalized_pagerank(n, e, seeds).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_a_later_session_reads_the_same_tables(spark, stored):
    from codeloom.operators import adjacency as AD

    n, e, links, at = stored
    for way in LN.WAYS:
        spark.sql(f"DROP TABLE {AD._table_name(f'{at}/{way}')}")  # as unknown as to a new session; the files stay
    again = LN.read(spark, at, dict.fromkeys(LN.WAYS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    seeds = n.where("id = 'b'").select("id")
    assert rows(W.impact(None, seeds, None, links=again)) == rows(W.impact(e, seeds, None))


def test_a_step_moves_and_sorts_no_link(spark, stored):
    _, _, links, _ = stored
    if links.walk.hot is not None:
        pytest.skip("the frontier of hot sources is spread first")
    rank = links.walk.salts.select(F.col("src").alias("id"), F.lit(1.0).alias("r"))
    step = links.walk.expand(rank, everywhere=True)
    step.collect()
    plan = step._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    scan = plan.index(links.walk.packed._jdf.queryExecution().analyzed().toString().split("links_")[1][:10])
    join = plan.index("ShuffledHashJoin")
    assert "Bucketed: true" in plan[scan:]
    below = plan[join:scan].split("FileScan")[-1] if "FileScan" in plan[join:scan] else plan[join:scan]
    assert plan.count("Exchange") <= 1 and "Sort " not in below and "Aggregate" not in plan
