"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import compare, duck

from codeloom.plans import all_queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    q = all_queries()[name]
    verdict, _, _, detail = compare(spark, con, name, q.plan, q.sql, SF)
    if verdict == "EMPTY":  # equal, but without rows: the next larger tables must give some
        verdict, _, _, detail = compare(spark, duck(LARGER), name, q.plan, q.sql, LARGER)
    assert verdict in ("same", "rows"), detail
