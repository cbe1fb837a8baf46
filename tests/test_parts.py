"""Search, roll-ups, scopes, drift, enrichment, concepts and sessions."""

import random
import re

from graphs import edges, nodes
from pyspark.sql import functions as F

from codeloom import session
from codeloom.operators import concepts as C
from codeloom.operators import drift as D
from codeloom.operators import enrich as E
from codeloom.operators import grep as G
from codeloom.operators import repomap as M
from codeloom.operators import savings as SV
from codeloom.operators import scopes as SC
from codeloom.operators import viz as V
from codeloom.sources import tables as S
from codeloom.sources.files import workspace_globs
from codeloom.streaming import sessions as SS


def test_grep_attributes_to_the_innermost_span_and_ranks_by_use(spark):
    n = nodes(spark, [
        ("a.py#Outer", "class", "a.py", {"start_line": 2, "end_line": 200}), ("a.py#Outer.hot", "method", "a.py", {"start_line": 100, "end_line": 150}),
        ("b.py#cold", "function", "b.py", {"start_line": 1, "end_line": 3})])
    e = edges(spark, [("x", "a.py#Outer.hot"), ("x", "a.py#Outer.hot", "references"), ("x", "a.py#Outer.hot", "contains")])
    text = "\n".join("needle (1)" if i in (1, 50, 120, 199) else "hay" for i in range(1, 201))
    files = spark.createDataFrame([("a.py", text), ("b.py", "needle (1)\n" + "z" * 300 + " NEEDLE")], "path string, content string")
    res = G.grep(n, e, files, "needle (1)", fixed=True)
    rows = [(r.span_id, r.in_degree, r.n_hits) for r in G.rank_groups(res.groups).collect()]
    assert rows == [("a.py#Outer.hot", 2, 1), (None, 0, 1), ("a.py#Outer", 0, 2), ("b.py#cold", 0, 1)]
    assert (res.total, res.dropped) == (5, 0)
    capped = G.grep(n, e, files, "needle", ignore_case=True, max_hits=2)
    assert (capped.total, capped.dropped) == (2, 4)
    assert G.grep(n, e, files, "needle", within="b.").total == 1
    wide = [h.text for g in G.grep(n, e, files, "NEEDLE").groups.collect() for h in g.hits]
    assert wide[0].endswith("NEEDLE") and len(wide[0]) > 300  # lines are shown whole


def test_map_splits_the_big_directory_and_caps(spark):
    rows = [(f"src/{'core' if i < 5 else 'ui'}/f{i}.ts", "file", f"src/{'core' if i < 5 else 'ui'}/f{i}.ts") for i in range(8)]
    rows += [("src/top.py", "file", "src/top.py"), ("lib/z.go", "file", "lib/z.go")]
    rows += [(f"src/core/f0.ts#s{i}", "function", "src/core/f0.ts") for i in range(4)] + [("lib/z.go#g", "function", "lib/z.go")]
    n = nodes(spark, rows)
    e = edges(spark, [("lib/z.go#g", "src/core/f0.ts#s1"), ("src/top.py", "src/core/f0.ts#s1", "imports"), ("src/top.py", "lib/z.go#g")])
    rm = M.repo_map(n, e, max_dirs=3)
    got = [(r.path, r.files, r.symbols, r.is_file) for r in rm.dirs.orderBy("rank").collect()]
    assert got == [("src/core", 5, 4, False), ("lib", 1, 1, False), ("src/top.py", 1, 0, True)]
    assert rm.dropped.first()["dropped"] == 1
    assert [(r.name, r.in_degree) for r in rm.hotspots.collect()] == [("s1", 2), ("g", 1)]
    assert rm.totals.first()["languages"] == ["go", "python", "typescript"]
    scoped = M.repo_map(n, e, ["src", "lib"])
    assert {(r.scope, r.path, r.files) for r in scoped.dirs.collect()} == {
        ("src", "src/core", 5), ("src", "src/ui", 3), ("src", "src/top.py", 1), ("lib", "lib/z.go", 1)}


def test_scope_discovery(spark):
    names = ["front", "back", "back/sub", "deep/er/est", "packages/a", "packages/b", "packages/a/x"]
    dirs = spark.createDataFrame([(d,) for d in names], "dir string")
    marks = spark.createDataFrame(
        [("front", "package.json"), ("back", "go.mod"), ("back/sub", "setup.py"), ("deep/er/est", "go.mod")], "dir string, marker string")

    def found(globs, dirs=dirs, marks=marks):
        return sorted(r.prefix for r in SC.discover(dirs, marks, globs).collect())

    assert found(None) == ["back", "front"]
    assert found(["packages/*"]) == ["back", "packages/a", "packages/b"]
    assert found(["packages/**"]) == ["back", "packages/a", "packages/b"]
    assert found(["packages/a/*"]) == ["back", "packages/a/x"]
    assert found(["front", "packages/*/x"]) == ["back", "front"]
    assert found(None, dirs.limit(0), marks.limit(0)) == [""]
    # a listed scope replaces an unlisted one right above it
    above = marks.union(spark.createDataFrame([("packages", "go.mod"), ("packages/a", "setup.py")], marks.schema))
    assert found(["packages/a"], dirs, above) == ["back", "packages/a"]
    rows = {r.prefix: r.markers for r in SC.discover(dirs, above, None).collect()}
    assert rows == {"front": ["package.json"], "back": ["go.mod"], "packages": ["go.mod"]}
    assert workspace_globs("packages:\n  - 'apps/*'\n\n  - docs\nother: 1\n", None) == ["apps/*", "docs"]
    assert workspace_globs(None, '{"workspaces": {"packages": ["p/*"]}}') == ["p/*"]
    assert workspace_globs(None, "{broken") is None


def test_small_scopes_fold_into_the_root(spark):
    n = nodes(spark, [(f"a/f.py#x{i}", "function", "a/f.py") for i in range(5)] + [("b/g.py#y", "function", "b/g.py")])
    assert SC.substantial(n, ["a", "b"]) == ["a"]
    got = {r.path: r.scope for r in SC.with_scope(n, ["a", "a/f.py"]).collect()}
    assert got == {"a/f.py": "a/f.py", "b/g.py": ""}


def test_drift_reports(spark):
    old = nodes(spark, [("a", "function", "p", {"body_hash": "1"}), ("a", "function", "p", {"body_hash": "2"}),
                        ("b", "function", "p", {"summary_state": "stale"}), ("c", "function", "p")])
    new = nodes(spark, [("a", "function", "p", {"body_hash": "2"}), ("b", "function", "p", {"body_hash": "z"}), ("d", "function", "p")])
    assert {tuple(r) for r in D.check_graph(old, new).collect()} == {("b", "changed"), ("b", "stale"), ("c", "removed"), ("d", "added")}
    v = D.graph_verdict(old, old).first()
    assert (v.ok, v.stale, v.pending) == (False, 1, 2)
    assert D.graph_verdict(old.where("id <> 'b'"), old.where("id <> 'b'")).first().ok


def test_enrichment_calls_once_more_for_missing_and_clamps_the_crux(spark):
    n = nodes(spark, [("f#a", "function", "f", {"start_line": 2, "end_line": 30, "body_hash": "1"}), ("f#b", "function", "f", {"start_line": 31, "end_line": 32}),
                      ("g#c", "function", "g"), ("f#d", "function", "f", {"body_hash": "9"})]).withColumn(
        "crux", F.lit(None).cast("struct<code:string,span:string>"))
    prior = n.where("id = 'f#d'").withColumn("summary_state", F.lit("ready")).withColumn("summary", F.lit("known"))
    files = spark.createDataFrame([("f", "\n".join(f"line {i}" for i in range(1, 41))), ("g", "x")], "path string, content string")

    def describe(path, source, refs):
        if path == "g":
            raise RuntimeError("no answer")
        first = refs[0]
        return [{"id": first["id"], "summary": "about " + first["id"], "crux_start": 1, "crux_end": 40}]

    out, errors = E.enrich(n, prior, files, describe)
    rows = {r.id: r for r in out.collect()}
    assert rows["f#a"].summary_state == rows["f#b"].summary_state == "ready"
    assert rows["f#a"].crux.span == "L2-L13" and rows["f#a"].crux.code.startswith("line 2\n")
    assert rows["g#c"].summary_state == "pending" and rows["f#d"].summary == "known"
    assert [tuple(r) for r in errors.collect()] == [("g", "no answer")]


def test_batches_equal_the_greedy_fold(spark):
    rnd = random.Random(5)
    for case in range(2):
        sizes = [rnd.choice([9, 40, 100, 350, 1200]) for _ in range(120)]
        df = spark.createDataFrame([(f"{i:04d}", s) for i, s in enumerate(sizes)], "path string, size bigint")
        want, used, batch = {}, 0, 1
        for i, s in enumerate(sizes, 1):
            if i > 1 and used + s > 500:
                batch, used = i, 0
            used += s
            want[f"{i - 1:04d}"] = batch
        assert {r.path: r.batch for r in C.batch_by_size(df, 500).collect()} == want


def test_concepts_merge_link_and_inherit(spark):
    schema = "ord int, name string, type string, summary string, sources array<string>, links array<struct<to:string,relation:string,description:string>>"
    drafts = spark.createDataFrame([
        (1, "Auth Flow", "concept", "short", ["a.py", "gone.py"], [("Billing", "uses", "first"), ("auth flow", "uses", None), ("?", "uses", None)]),
        (2, "Billing", "", "b", ["b.py"], []),
        (3, "auth  flow", "service", "a longer one", [], [("BILLING", "uses", "second"), ("billing", "part_of", None)]),
        (4, "Idea", "concept", None, [], [("Auth Flow", "uses", None), ("Later", "uses", None)]),
        (5, "Later", "concept", "", [], [("Idea", "uses", None)]),
    ], schema)
    files = spark.createDataFrame([("a.py", "ha"), ("b.py", "hb")], "path string, hash string")
    got = {r.slug: r for r in C.build_concepts(drafts, files).collect()}
    assert (got["auth-flow"].name, got["auth-flow"].type, got["auth-flow"].summary) == ("Auth Flow", "service", "a longer one")
    assert [(x.to, x.relation, x.description) for x in got["auth-flow"].links] == [("billing", "uses", "first"), ("billing", "part_of", None)]
    assert [s.path for s in got["auth-flow"].sources] == ["a.py"]
    assert [s.path for s in got["idea"].sources] == ["a.py"] and [s.path for s in got["later"].sources] == ["a.py"]


def test_inherited_sources_are_attached_once(spark, monkeypatch):
    """A hub of many files below many bare concepts: what is stored grows with the concepts, not with concepts times files."""
    hub = [("hub", f"f{i}", f"h{i}") for i in range(200)] + [("twin", f"f{i}", f"h{i}") for i in range(190, 210)]
    own = spark.createDataFrame(hub, "slug string, path string, hash string")
    bare = [f"b{i:02d}" for i in range(30)]
    concepts = spark.createDataFrame([(s, i) for i, s in enumerate(["hub", "twin", *bare])], "slug string, ord int")
    links = spark.createDataFrame([(bare[0], "hub"), (bare[0], "twin")] + [(bare[i], bare[i - 1]) for i in range(1, 30)], "slug string, to string")
    stored = []
    keep = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: (lambda kept: stored.append(kept.count()) or kept)(keep(df)))
    got = [(r.slug, r.path) for r in C.inherit_sources(concepts, own, links).collect()]
    assert len(got) == len(set(got)) == 220 + 30 * 210
    assert max(stored) <= 2 * 30


def test_tasks_hold_no_more_of_larger_tables(spark, monkeypatch):
    """Edges of the catalog are dealt over partitions that follow their rows, however many the session's setting names."""
    sf = "/root/testdata/sf0.001"
    rows = S.table(spark, sf, "lineitem").count()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for per_task in (300, 200):
        monkeypatch.setattr(session, "TASK_ROWS", per_task)
        parts = S.catalog_parts(spark, sf)
        assert parts == rows // per_task + 1
        g = S.catalog(spark, sf)
        assert len(re.findall(rf"hashpartitioning\([^)]*, {parts}\)", plan(G.in_degree(g.edges)))) == 1
        assert len(re.findall(rf"hashpartitioning\([^)]*, {parts}\)", plan(V.real_edges(g.nodes, g.edges, parts)))) >= 4


def test_viz_counts_what_it_drops(spark):
    notes = spark.createDataFrame([
        ("a", "A", "concept", f"{V.GENERATED_START}\n## Summary\n\nHello\n\n## Related\n- x\n{V.GENERATED_END}\n", [("p", "h")], [("b", "supports", None), ("zz", "uses", None)], False),
        ("b", None, None, "plain", [], [], False), ("c", None, None, "", [], [], True)],
        "slug string, name string, type string, body string, sources array<struct<path:string,hash:string>>, "
        "links array<struct<to:string,relation:string,description:string>>, broken boolean")
    n, e, meta = V.assemble(notes)
    assert {(r.id, r.name, r.summary) for r in n.collect()} == {("a", "A", "Hello"), ("b", "b", "plain")}
    assert [(r.source, r.target, r.relation) for r in e.collect()] == [("a", "b", "validates")]
    m = meta.first()
    assert (m.node_count, m.edge_count, m.skipped_files, m.dropped_edges) == (2, 1, 1, 1)


def test_savings(spark):
    n = nodes(spark, [("a", "file", "a", {"chars": 100}), ("b", "file", "b", {"chars": 50}), ("c", "file", "c")])
    hits = spark.createDataFrame([("a:L1-L2",), ("a:L3-L4",), ("b, c",), ("no such thing",)], "pointer string")
    assert tuple(SV.savings_for(n, SV.pointer_paths(hits)).first()) == (2, 150)
    assert tuple(SV.savings_for(n, hits.select(F.lit("c").alias("path"))).first()) == (None, None)
    assert SV.footer(hits, n, "x" * 1000, "t") == ""
    assert "2 whole files" in SV.footer(hits, n, "x" * 20, "t")


def test_novelty_equals_the_replay(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice(["busy"] * 6 + ["calm"]), i, f"p{rnd.randint(0, 9)}") for i in range(300)]
    rows = [(s, i, "p0" if s == "calm" and p > "p3" else p) for s, i, p in rows]
    want, seen = set(), {}
    for s, i, p in rows:
        mem = seen.setdefault(s, [])
        if p not in mem:
            want.add((s, i, p))
            seen[s] = (mem + [p])[-5:]
    df = spark.createDataFrame(rows, "session string, step bigint, pointer string")
    assert {tuple(r) for r in SS.fresh_pointers(df, 5).collect()} == want
    prompts = spark.createDataFrame([(None, None), (0.05, 0.4), (0.1, 0.0), (0.0, 0.5)], "coverage_strong double, coverage double")
    assert SS.strong_prompts(prompts).count() == 3
