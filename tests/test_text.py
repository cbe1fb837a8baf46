from pyspark.sql import functions as F

from codeloom.functions import text as X


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("v")).first()["v"]


def test_tokenize_splits_identifiers_and_drops_stop_words(spark):
    got = one(spark, X.tokenize(F.col("t")), t="getUserName of the HTTP_server2Go a-b éclair")
    assert got == ["user", "name", "http", "server2", "go", "clair"]
    assert X.query_terms("getUserName of users users") == ["user", "name", "users"]


def test_test_paths(spark):
    yes = ["a_test.go", "src/x.test.ts", "src/y.spec.tsx", "tests/a.py", "test_a.py", "x/conftest.py", "a/__tests__/b.js", "spec/a.rb"]
    no = ["src/latest.py", "contest.py", "src/testing.ts", "attest/a.py", "protest_a.go"]
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    got = {r.p: r.t for r in df.select("p", X.is_test_path(F.col("p")).alias("t")).collect()}
    assert all(got[p] for p in yes) and not any(got[p] for p in no)


def test_test_factor_is_lifted_when_tests_are_asked_for(spark):
    assert one(spark, X.test_factor(F.col("p"), "find the bug"), p="tests/a.py") == 0.35
    assert one(spark, X.test_factor(F.col("p"), "which tests cover it"), p="tests/a.py") == 1.0


def test_languages(spark):
    want = {"a.TSX": "tsx", "b.jsx": "tsx", "c.mts": "typescript", "d.cjs": "typescript", "e.pyi": "python", "f.go": "go", "g.rs": None}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.l for r in df.select("p", X.language_of(F.col("p")).alias("l")).collect()} == want


def test_small_functions(spark):
    assert one(spark, X.slugify(F.col("t")), t="  Hello,  Big World! ") == "hello-big-world"
    assert one(spark, X.slugify(F.col("t")), t="***") == "node"
    assert one(spark, X.clean_signature(F.col("t")), t="def  f(\n a):") == "def f( a)"
    assert one(spark, X.clean_signature(F.col("t")), t="const f = (a) =>") == "const f = (a)"
    assert one(spark, X.first_prose(F.col("t")), t="# T\n\n- item\n<!-- c -->\n text \nmore") == "text"
    assert one(spark, X.to_tokens(F.col("t")), t=6) == 2
    assert one(spark, X.qualified_name(F.col("i"), F.col("n")), i="a.py#B.c", n="c") == "B.c"
    assert one(spark, X.under_prefix(F.col("p"), "front"), p="frontend/a") is False
    assert X.literal_pattern("a.b(c)") == r"a\.b\(c\)"


def test_distributed_rank_and_prefix_match_brute_force(spark):
    import random

    from codeloom.functions.ranking import distributed_rank, ordered_prefix

    rnd = random.Random(3)
    # one group holds most rows
    rows = [("big" if rnd.random() < 0.8 else f"g{i % 3}", rnd.randint(0, 20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, score int, id int")
    got = {r.id: r["rank"] for r in distributed_rank(df, ["g"], [F.col("score").desc(), F.col("id")]).collect()}
    for g in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))
    run = 0
    pos = {r.id: (r.pos, r.run) for r in ordered_prefix(df, [F.col("id")], "score").collect()}
    for i, r in enumerate(sorted(rows, key=lambda r: r[2]), 1):
        run += r[1]
        assert pos[r[2]] == (i, run)
