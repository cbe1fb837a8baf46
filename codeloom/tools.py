"""The six questions as named tools with JSON schemas, for hosts that call by name."""

from __future__ import annotations

from . import report
from .engine import Engine


def _schema(required: list[str], **props: dict) -> dict:
    return {"type": "object", "properties": props, "required": required}


TEXT, FLAG, NUMBER = {"type": "string"}, {"type": "boolean"}, {"type": "number"}

TOOLS: dict[str, dict] = {
    "find_code": _schema(["query"], query=TEXT, limit=NUMBER, full=FLAG, **{"in": TEXT}),
    "file_api": _schema(["file"], file=TEXT),
    "check_freshness": _schema([]),
    "trace_calls": _schema(["symbol"], symbol=TEXT, direction={"type": "string", "enum": ["in", "out"]},
                           depth={"anyOf": [NUMBER, {"const": "all"}]}, **{"in": TEXT}),
    "find_all": _schema(["pattern"], pattern=TEXT, ignore_case=FLAG, fixed=FLAG, **{"in": TEXT}),
    "repo_map": _schema([], max_dirs=NUMBER),
}


def _depth(value) -> int | None:
    if value == "all":
        return None
    return max(1, int(value)) if isinstance(value, (int, float)) else 1


def call(engine: Engine, name: str, args: dict | None = None) -> dict:
    """Run a tool; problems come back as text, never as an exception."""
    a = args or {}
    try:
        missing = [k for k in TOOLS[name]["required"] if not a.get(k)]
        if missing:
            raise ValueError(f"missing argument: {', '.join(missing)}")
        if name != "check_freshness":
            engine.ensure_fresh()
        if name == "find_code":
            answer = engine.ask(a["query"], int(a.get("limit", 5)), a.get("in"), source=True, full=bool(a.get("full")))
            text = report.ask_text(engine, a["query"], answer)
        elif name == "file_api":
            text = report.skeleton_text(engine, a["file"])
        elif name == "check_freshness":
            text = report.check_text(engine)[0]
        elif name == "trace_calls":
            text = report.callers_text(engine, a["symbol"], a.get("direction", "in"), _depth(a.get("depth", 1)), a.get("in"))
        elif name == "find_all":
            text = report.grep_text(engine, a["pattern"], a.get("in"), bool(a.get("ignore_case")), bool(a.get("fixed")))
        else:
            text = report.map_text(engine.repo_map(int(a.get("max_dirs", 16))))
        return {"text": text, "error": False}
    except KeyError:
        return {"text": f"unknown tool {name}", "error": True}
    except Exception as e:  # told to the caller
        return {"text": str(e), "error": True}
