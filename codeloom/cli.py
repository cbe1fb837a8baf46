"""Command line: ``python -m codeloom.cli build|ask|skeleton|check|callers|grep|map PATH …``."""

from __future__ import annotations

import argparse
import sys

from . import __version__, report
from .engine import Engine
from .session import local_session
from .workspace import Workspace


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--out", help="folder of the stored graph")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *words: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("root")
        for w in words:
            c.add_argument(w)
        return c

    add("build").add_argument("--cards", action="store_true", help="also write markdown cards")
    ask = add("ask", "query")
    ask.add_argument("--limit", type=int, default=8)
    ask.add_argument("--in", dest="within")
    ask.add_argument("--source", action="store_true")
    ask.add_argument("--full", action="store_true")
    ask.add_argument("--no-graph-rank", action="store_true")
    add("skeleton", "file")
    add("check")
    callers = add("callers", "symbol")
    callers.add_argument("--direction", choices=["in", "out"], default="in")
    callers.add_argument("--depth", default="1", help="number of steps, or all")
    callers.add_argument("--in", dest="within")
    grep = add("grep", "pattern")
    grep.add_argument("--in", dest="within")
    grep.add_argument("-i", "--ignore-case", action="store_true")
    grep.add_argument("-F", "--fixed", action="store_true")
    add("map").add_argument("--max-dirs", type=int, default=16)
    return p


def ask_workspace(space: Workspace, a: argparse.Namespace) -> int:
    """The same commands over a folder of repositories."""
    if a.command == "build":
        repos = space.split(lambda found, mixed: print(report.split_text(found, mixed)))
        if a.cards:
            print(f"{sum(space.engine(r).write_cards() for r in repos)} cards")
        return 0
    if a.command == "check":
        text, ok = report.space_check_text(space)
        print(text, end="")
        return 0 if ok else 1
    if a.command == "skeleton":
        repo, _, file = a.file.partition("/")
        if repo not in space.built():
            print(f"{a.file}: begin with one of {', '.join(space.built())}")
            return 1
        print(report.skeleton_text(space.engine(repo), file), end="")
        return 0
    text = report.refresh_text(space.refresh())
    if a.command == "ask":
        text += report.space_ask_text(space, a.query, a.limit, a.within, not a.no_graph_rank)
    elif a.command == "callers":
        text += report.space_callers_text(space, a.symbol, a.direction, None if a.depth == "all" else int(a.depth), a.within)
    elif a.command == "grep":
        text += report.space_grep_text(space, a.pattern, within=a.within, fixed=a.fixed, ignore_case=a.ignore_case)
    else:
        text += report.space_map_text(space, a.max_dirs)
    note = space.note()
    print(text + (note + "\n" if note else ""), end="")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session()
    space = Workspace(spark, a.root, a.out)
    if space.is_workspace():
        return ask_workspace(space, a)
    engine = Engine(spark, a.root, a.out)
    if a.command == "build":
        print(engine.build())
        if a.cards:
            print(f"{engine.write_cards()} cards")
        return 0
    if a.command == "check":
        text, ok = report.check_text(engine)
        print(text, end="")
        return 0 if ok else 1
    engine.ensure_fresh()
    if a.command == "ask":
        answer = engine.ask(a.query, a.limit, a.within, not a.no_graph_rank, a.source or a.full, a.full)
        text = report.ask_text(engine, a.query, answer)
    elif a.command == "skeleton":
        text = report.skeleton_text(engine, a.file)
    elif a.command == "callers":
        depth = None if a.depth == "all" else int(a.depth)
        text = report.callers_text(engine, a.symbol, a.direction, depth, a.within)
    elif a.command == "grep":
        text = report.grep_text(engine, a.pattern, a.within, a.ignore_case, a.fixed)
    else:
        text = report.map_text(engine.repo_map(a.max_dirs))
    print(text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
