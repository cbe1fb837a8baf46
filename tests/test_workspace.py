"""Splitting a mixed graph, and a folder of repositories on disk."""

import os

import pytest

from codeloom.operators.workspace import coverage, coverage_note, split_graph
from codeloom.workspace import Workspace
from tests import graphs as G

A = "def helper():\n    return 1\n\n\ndef main():\n    return helper()  # license\n"
B = "class Store:\n    def save(self):\n        return helper()\n\n\ndef helper():\n    pass\n"


@pytest.fixture
def folder(tmp_path):
    for repo, name, text in (("alpha", "a.py", A), ("beta", "b.py", B)):
        os.makedirs(tmp_path / repo / ".git")
        (tmp_path / repo / name).write_text(text)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "c.py").write_text(A)
    return tmp_path


def test_split_keeps_every_node_and_link(spark):
    nodes = G.nodes(spark, [("x", "function", "r/x.py"), ("y", "function", "r/in/y.py"), ("z", "function", "z.py")])
    edges = G.edges(spark, [("x", "y"), ("y", "y"), ("z", "outside")])
    got = split_graph(nodes, edges, spark.createDataFrame([("r",), ("r/in",)], "prefix string"))
    assert {(r.id, r.repo) for r in got.nodes.collect()} == {("x", "r"), ("y", "r/in"), ("z", "")}
    assert {(r.source, r.target, r.repo) for r in got.edges.collect()} == {("y", "y", "r/in"), ("z", "outside", "")}
    assert [(r.source, r.target, r.repo, r.target_repo) for r in got.crossing.collect()] == [("x", "y", "r", "r/in")]


def test_coverage_lists_what_is_not_built(spark):
    nodes = G.nodes(spark, [("f", "file", "a/f.py"), ("g", "function", "a/f.py")]).selectExpr("*", "'a' AS repo")
    rows = coverage(spark.createDataFrame([("a",), ("b",)], "repo string"), nodes).collect()
    assert {tuple(r) for r in rows} == {("a", True, 1), ("b", False, 0)}
    assert coverage_note(3, ["b", "c"]) == "1 of 3 repositories are built; not covered: b, c"
    assert coverage_note(3, []) == ""


def test_folder_of_repositories(spark, folder):
    ws = Workspace(spark, str(folder))
    assert ws.is_workspace() and ws.repositories() == ["alpha", "beta"] and ws.missing() == ["alpha", "beta"]
    with pytest.raises(LookupError):
        ws.nodes()
    ws.engine("alpha").build()
    assert ws.note() == "1 of 2 repositories are built; not covered: beta"
    assert {(r.repo, r.built, r.ok) for r in ws.check().collect()} == {("alpha", True, True), ("beta", False, True)}
    heard = []
    assert ws.split(lambda repos, mixed: heard.append((repos, mixed))) == ["alpha", "beta"]
    assert heard == [(["alpha", "beta"], False)]
    assert Workspace(spark, str(folder)).listed() == ["alpha", "beta"] and ws.note() == ""

    # each graph is the one its repository has on its own, under its name
    own = {f"alpha/{r.id}" for r in ws.engine("alpha").nodes().collect()}
    assert own == {r.id for r in ws.nodes().where("repo = 'alpha'").collect()}
    hits = {(r.repo, r.symbol, r.id) for r in ws.callers("helper").collect()}
    assert hits == {("alpha", "alpha/a.py#helper", "alpha/a.py#main"), ("beta", "beta/b.py#helper", "beta/b.py#Store.save")}
    groups, counts = ws.grep("helper", max_hits=2)
    assert {(r.repo, r.total_hits, r.dropped) for r in counts.collect()} == {("alpha", 2, 0), ("beta", 2, 0)}
    assert sum(r.n_hits for r in groups.collect()) == 4
    assert {r.scope for r in ws.ask("save store helper").ranked.collect()} <= {"alpha", "beta"}
    with pytest.raises(ValueError):
        ws.ask("save", only="plain")

    # a moved repository is rebuilt, the other keeps its version
    assert ws.refresh().rebuilt == []
    still = ws.engine("beta").store.current()
    (folder / "alpha" / "a.py").write_text(A + "\n\ndef added():\n    pass\n")
    assert {(r.repo, r.ok) for r in ws.check().collect()} == {("alpha", False), ("beta", True)}
    done = ws.refresh()
    assert done.rebuilt == ["alpha"] and done.failed == [] and ws.engine("beta").store.current() == still


def test_commands(spark, folder, capsys):
    from codeloom.cli import main

    assert main(["check", str(folder)]) == 1
    assert main(["build", str(folder)]) == 0
    assert "2 repositories" in capsys.readouterr().out
    assert main(["grep", str(folder), "license"]) == 0
    assert "1 in alpha" in capsys.readouterr().out
    assert main(["callers", str(folder), "helper", "--depth", "all"]) == 0
    assert "beta/b.py#helper ← beta/b.py#Store.save" in capsys.readouterr().out
    assert main(["ask", str(folder), "save store"]) == 0
    assert "beta/" in capsys.readouterr().out
    assert main(["skeleton", str(folder), "beta/b.py"]) == 0
    assert "save" in capsys.readouterr().out
    assert main(["map", str(folder)]) == 0 and "alpha" in capsys.readouterr().out
    assert main(["check", str(folder)]) == 0


def test_a_repository_is_no_workspace(spark, folder):
    os.makedirs(folder / ".git")
    assert not Workspace(spark, str(folder)).is_workspace()
    (folder / ".codeloom").mkdir()
    (folder / ".codeloom" / "workspace.json").write_text("[broken")
    assert Workspace(spark, str(folder)).listed() is None
