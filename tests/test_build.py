"""Extraction, resolution and the engine over small source trees."""

import os

import pytest
from pyspark.sql import functions as F

from codeloom.operators import extract as EX
from codeloom.operators import resolve as R

TREE = {
    "a/one.py": '''import os
import numpy as np
from .two import Helper as H, run
from __future__ import annotations

LIMIT = 3  # a "quote


class Base(object):
    """Doc with def fake(): inside"""

    def __init__(self, h: Helper):
        self.h = H()
        self.go()
        self.h.work()

    def go(self):
        def inner(x):
            return run(x)
        return inner(
            1,
        )

class Child(Base, mixins.M):
    async def other(self):
        self.go()


def _private(
    a,
    b,
):
    c = Child()
    c.go()
    helper(a)
''',
    "a/two.py": '''class Helper:
    def work(self):
        return 1

def run(x):
    return x
''',
    "web/app.ts": '''import { Store as S, other } from "./store";
import "./side.css";
// comment function nope() {
export abstract class App extends Base implements Runnable, Other {
  private store: Store;
  list = new Map();
  constructor(s: Store) {
    this.store = s;
    if (s) { boot(); }
  }
  async run(x: number): Promise<void> {
    const t = new Timer();
    t.start();
    this.store.save(x);
    this.list.set(1);
    this.stop();
  }
  stop() { return `a ${b} {`; }
}
export const add = (a: number, b: number) => a + b;
const sub = async (a) => {
  return add(a, 1);
};
export function boot(): void {
  const st: S = make();
  st.save();
}
interface Runnable { run(): void }
type Id = string | number;
enum Color { Red, Blue }
''',
    "web/store.ts": '''export class Store {
  save(v) { return v; }
}
export class Timer { start() {} }
''',
    "go/main.go": '''package main

import (
	"fmt"
	u "example.com/app/pkg/util"
)

type User struct {
	Name string
}

type (
	ID int
	Saver interface {
		Save() error
	}
)

func (u *User) Save() error {
	u.check()
	return nil
}

func (u User) check() {}

func NewUser() *User { return &User{} }

func main() {
	x := NewUser()
	x.Save()
	y := &User{}
	y.check()
	fmt.Println("hi")
}
''',
    "go/pkg/util/util.go": "package util\n\nfunc helper() {}\n",
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame(list(TREE.items()), "path string, content string")
    ex = EX.extract(files)
    modules = spark.createDataFrame([("example.com/app", "go")], "module string, dir string")
    nodes = {r.id: r for r in ex.nodes.collect()}
    raw = {(r.source, r.relation, r.target_id or r.specifier or r.name, r.recv_type) for r in ex.raw_edges.collect()}
    edges = {(r.source, r.relation, r.target): r.confidence for r in R.resolve_edges(ex.nodes, ex.raw_edges, modules).collect()}
    return nodes, raw, edges


def test_definitions(found):
    nodes, _, _ = found
    want = {
        "a/one.py#Base": ("class", 9, 22), "a/one.py#Base.__init__": ("method", 12, 15), "a/one.py#Base.go.inner": ("function", 18, 19),
        "a/one.py#Child.other": ("method", 25, 26), "a/one.py#_private": ("function", 29, 35),
        "web/app.ts#App": ("class", 4, 19), "web/app.ts#App.run": ("method", 11, 17), "web/app.ts#add": ("function", 20, 20),
        "web/app.ts#sub": ("function", 21, 23), "web/app.ts#Id": ("type", 29, 29), "web/app.ts#Color": ("enum", 30, 30),
        "web/app.ts#Runnable": ("interface", 28, 28), "go/main.go#User": ("struct", 8, 10), "go/main.go#ID": ("type", 13, 13),
        "go/main.go#Saver": ("interface", 14, 16), "go/main.go#User.Save": ("method", 19, 22), "go/main.go#NewUser": ("function", 26, 26),
    }
    assert {k: (nodes[k].kind, nodes[k].start_line, nodes[k].end_line) for k in want} == want
    assert not any("fake" in k or "nope" in k for k in nodes)
    assert sum(n.kind == "file" for n in nodes.values()) == len(TREE)


def test_signatures_visibility_and_residual(found):
    nodes, _, _ = found
    assert nodes["a/one.py#_private"].signature == "def _private( a, b, )"
    assert nodes["web/app.ts#App"].signature == "abstract class App extends Base implements Runnable, Other"
    assert nodes["web/app.ts#sub"].signature == "sub = async (a)"
    assert nodes["go/main.go#User.Save"].signature == "func (u *User) Save() error"
    hidden = ["a/one.py#_private", "web/app.ts#sub", "go/main.go#User.check", "a/one.py#Base.__init__"]
    shown = ["a/one.py#Child", "web/app.ts#App.stop", "web/app.ts#add", "go/main.go#User.Save"]
    assert not any(nodes[k].exported for k in hidden) and all(nodes[k].exported for k in shown)
    assert "LIMIT = 3" in nodes["a/one.py"].body_text and "run(x)" not in nodes["a/one.py"].body_text


def test_raw_edges_know_their_receiver(found):
    _, raw, _ = found
    assert ("a/one.py#Base.__init__", "calls", "work", "Helper") in raw
    assert ("a/one.py#Child.other", "calls", "go", "Child") in raw
    assert ("a/one.py#_private", "calls", "go", "Child") in raw
    assert ("web/app.ts#App.run", "calls", "set", "Map") in raw
    assert ("web/app.ts#App.run", "calls", "save", "Store") in raw
    assert ("web/app.ts#boot", "calls", "save", "Store") in raw
    assert ("go/main.go#User.Save", "calls", "check", "User") in raw
    assert ("go/main.go#main", "calls", "Save", "User") in raw
    assert ("a/one.py", "imports", ".two", None) in raw
    assert not any(t == "__future__" for _, _, t, _ in raw)
    assert ("go/main.go#Saver", "calls", "Save", None) not in raw


def test_edges(found):
    _, _, edges = found
    assert edges[("a/one.py#Child.other", "calls", "a/one.py#Base.go")] == "extracted"
    assert edges[("a/one.py#Base.__init__", "calls", "a/two.py#Helper.work")] == "inferred"
    assert edges[("web/app.ts", "imports", "web/store.ts")] == "extracted"
    assert edges[("web/app.ts#App", "implements", "Other")] == "inferred"
    assert edges[("a/one.py#Base", "extends", "object")] == "inferred"
    assert edges[("go/main.go", "imports", "go/pkg/util/util.go")] == "extracted"
    assert edges[("go/main.go", "imports", "fmt")] == "extracted"
    assert not any(t.endswith("Map.set") for _, _, t in edges)
    assert not any(r == "calls" and t == "a/one.py#Child" for _, r, t in edges)


# --------------------------------------------------------------------------
# typed resolution on hand-made rows

RAW = "source string, relation string, file string, target_id string, specifier string, name string, via_member boolean, recv_type string, ord bigint"


def typed(spark, methods, parents, calls):
    nodes = spark.createDataFrame([(i, i.rsplit(".", 1)[1], "method", i.split("#")[0], n) for n, i in enumerate(methods)],
                                  "id string, name string, kind string, path string, ord bigint")
    raw = spark.createDataFrame(
        [(f"p.py#{c}", "extends", "p.py", None, None, p, None, None, n) for n, (c, p) in enumerate(parents)]
        + [(f"{f}#caller", "calls", f, None, None, name, True, recv, 100 + n) for n, (f, recv, name) in enumerate(calls)], RAW)
    return {(r.source, r.target): r.confidence for r in R.resolve_edges(nodes, raw).where("relation = 'calls'").collect()}


def test_typed_calls(spark):
    got = typed(
        spark,
        ["a.py#Cache.get", "b.py#Store.get", "b.py#Twin.put", "c.py#Twin.put", "d.py#Root.deep", "e.py#Only.set", "f.py#Far.far"],
        [("Mid", "Root"), ("Low", "Mid"), ("Lower", "Low"), ("Lowest", "Lower"), ("Loop", "Loop2"), ("Loop2", "Loop")],
        [("x.py", "Cache", "get"), ("a.py", "Cache", "get"), ("x.py", "Twin", "put"), ("c.py", "Twin", "put"),
         ("x.py", "Lower", "deep"), ("x.py", "Map", "set"), ("y.py", "Loop", "far"), ("x.py", "Nobody", "get")])
    assert got[("x.py#caller", "a.py#Cache.get")] == "inferred"
    assert got[("a.py#caller", "a.py#Cache.get")] == "extracted"
    assert got[("c.py#caller", "c.py#Twin.put")] == "extracted"
    assert ("x.py#caller", "b.py#Twin.put") not in got and ("x.py#caller", "c.py#Twin.put") not in got
    assert got[("x.py#caller", "d.py#Root.deep")] == "inferred"
    assert ("x.py#caller", "e.py#Only.set") not in got
    assert got[("y.py#caller", "f.py#Far.far")] == "inferred"


def test_import_suffix_order(spark):
    nodes = spark.createDataFrame([(p,) for p in ["src/a.ts", "src/a.js", "src/lib/index.tsx", "top.py", "src/x.py"]], "id string")
    asked = spark.createDataFrame([("src/m.ts", s) for s in ["./a.js", "./a", "./lib", "../top", "./none", "react", "././x.py"]], "file string, specifier string")
    got = {r.specifier: r.target for r in R.resolve_imports(asked, nodes).collect()}
    assert got == {"./a.js": "src/a.js", "./a": "src/a.ts", "./lib": "src/lib/index.tsx", "../top": "top.py", "./none": "./none",
                   "react": "react", "././x.py": "src/x.py"}


# --------------------------------------------------------------------------
# the engine


def put(root, tree):
    for p, text in tree.items():
        at = os.path.join(root, p)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w") as f:
            f.write(text)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    from codeloom.engine import Engine

    root = str(tmp_path_factory.mktemp("tree"))
    put(root, {**TREE, "go/go.mod": "module example.com/app\n", "a/__init__.py": "def setup():\n    return 1\n",
               "node_modules/x/y.ts": "export function hidden() {}\n"})
    e = Engine(spark, root)
    e.first = e.build()
    return e


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rebuild_replays_and_equals_a_cold_build(spark, engine, tmp_path):
    from codeloom.engine import Engine
    from codeloom.streaming.maintain import change_stream, maintain

    assert (engine.first.parsed, engine.first.replayed) == (7, 0)
    assert engine.drift().isEmpty()
    with open(os.path.join(engine.root, "a/two.py"), "a") as f:
        f.write("\ndef extra():\n    return run(1)\n")
    assert [tuple(r) for r in engine.drift().collect()] == [("a/two.py", "changed")]
    # the change arrives as a notice and is applied by the stream
    notices = tmp_path / "notices"
    notices.mkdir()
    (notices / "n.json").write_text('{"path": "a/two.py", "op": "write"}\n')
    maintain(engine, change_stream(engine, str(notices)), str(tmp_path / "state"), once=True).awaitTermination()
    cold = Engine(spark, engine.root, str(tmp_path / "cold"))
    cold.build()
    for cols in (("id", "kind", "start_line", "end_line", "body_hash"),):
        assert table(engine.nodes(), *cols) == table(cold.nodes(), *cols)
    assert table(engine.edges(), "source", "target", "relation", "confidence") == table(
        cold.edges(), "source", "target", "relation", "confidence")
    assert ("a/two.py#extra", "a/two.py#run", "calls") in table(engine.edges(), "source", "target", "relation")


def test_answers(engine):
    assert engine.token_index() is not None
    by_index = engine.ask("store save helper").hits
    assert by_index.first()["pointer"].startswith(("web/store.ts", "web/app.ts"))
    found = engine.ask("who calls run")
    assert found.mode == "structural"
    plain, sourced = (engine.ask("save store", limit=5, source=x).hits.collect() for x in (False, True))
    assert len(plain) > 1 and [r.pointer for r in sourced] == [r.pointer for r in plain]
    code = engine.ask("save store", limit=3, source=True).hits.where("pointer = 'web/store.ts:L2-L2'").first()["code"]
    assert code.strip() == "save(v) { return v; }"
    with pytest.raises(ValueError):
        engine.ask("x", within="nowhere")


def test_tools_never_raise(engine):
    from codeloom import tools

    assert "hits in" in tools.call(engine, "find_all", {"pattern": "return"})["text"]
    assert tools.call(engine, "find_all", {"pattern": "("})["error"]
    assert "App.run" not in tools.call(engine, "file_api", {"file": "store.ts"})["text"]
    assert tools.call(engine, "nope")["error"] and tools.call(engine, "find_code", {})["error"]
    assert "hotspots" in tools.call(engine, "repo_map")["text"]


def test_cards_and_concepts(engine):
    engine.write_cards()
    card = open(os.path.join(engine.out, "a/two.md")).read()
    assert "- Helper · class · L1-L3 — class Helper" in card

    def draft(entries):
        return [{"name": "Part " + p.split("/")[0], "summary": s, "sources": [p], "links": [{"to": "part a", "relation": "part_of"}]}
                for p, s in entries]

    notes = {r.slug: r for r in engine.build_concepts(lambda p, t: f"About {p}.", draft).collect()}
    assert set(notes) == {"part-a", "part-go", "part-web"}
    assert [link.to for link in notes["part-web"].links] == ["part-a"] and notes["part-a"].links == []
    at = os.path.join(engine.out, "part-web.md")
    with open(at, "a") as f:
        f.write("kept by hand\n")
    engine.build_concepts(lambda p, t: f"About {p}.", draft)
    text = open(at).read()
    assert "kept by hand" in text and text.count("## Summary") == 1 and "symbol: Store" in text
    assert engine.ok()
    os.remove(os.path.join(engine.out, "part-go.md"))
    assert [r.status for r in engine.check()["roster"].collect()] == ["note missing"]
