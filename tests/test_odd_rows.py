"""Rows of unusual content, held against the SQL twins."""

import duckdb
import pytest

from codeloom.plans import all_queries


@pytest.mark.parametrize("empty", [0, 1, 2])
def test_empty_texts_are_the_shortest_of_all(spark, tmp_path, empty):
    texts = ["attion la mer", "la elle mit\nder attion", "le chat", "", ""][: 3 + empty] + [None]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    q = all_queries()["fuse_all_ranks"]
    got = sorted(map(tuple, q.plan(spark, str(tmp_path)).select("id", "scope", "score").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT id, scope, score FROM ({q.sql})").fetchall())
    assert got == want and len(got) == 3 + empty
