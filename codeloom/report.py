"""Plain-text reports over finished results.  Only rows a reader sees are collected."""

from __future__ import annotations



from pyspark.sql import functions as F

from .engine import Answer, Engine
from .operators import repomap as M
from .operators import savings as SV
from .workspace import Refresh, Workspace

LABEL = "codeloom"
SHOWN = 200


def ask_text(engine: Engine, query: str, answer: Answer) -> str:
    rows = answer.hits.collect()  # at most the asked number of hits
    lines = [f'{LABEL} ask: "{query}"  ({answer.mode})', ""]
    if answer.note:
        lines += [answer.note, ""]
    if not rows:
        return "\n".join(lines + ["no matches."]) + "\n"
    for i, r in enumerate(rows, 1):
        d = r.asDict()
        if answer.mode == "structural":
            tail = f" — {d['snippet']}" if d["snippet"] else ""
            lines.append(f"- {d['title']}  {d['pointer']}  ({d['relation']}){tail}")
        else:
            scope = f"[{d['scope']}/] " if d["scope"] else ""
            lines += [f"{i}. {scope}{d['title']}  [{d['kind']}]", f"   {d['pointer']}"]
            if d["snippet"]:
                lines.append(f"   {d['snippet']}")
            if d["related"]:
                lines.append("   related: " + ", ".join(d["related"]))
        if d.get("code"):
            lines += ["", "```", d["code"], "```"]
    if answer.ranking is not None and answer.ranking.also_matched is not None:
        also = [r["scope"] for r in answer.ranking.also_matched.orderBy("scope").limit(SHOWN).collect()]
        if also:
            lines += ["", "also matched: " + ", ".join(a or "(root)" for a in also)]
    body = "\n".join(lines)
    return body + (SV.footer(answer.hits, engine.nodes(), body, LABEL) if "code" in answer.hits.columns else "") + "\n"


def skeleton_text(engine: Engine, file: str) -> str:
    rows = engine.skeleton(file).collect()  # the definitions of one file
    if not rows:
        return f"{LABEL} skeleton: {file}\n\nno definitions indexed for this file\n"
    lines = [f"{LABEL} skeleton: {rows[0]['path']}"]
    for r in rows:
        sig = f"  {r['signature']}" if r["signature"] else ""
        about = f" — {r['summary']}" if r["summary"] else ""
        lines.append(f"- L{r['start_line']}-L{r['end_line']}  {r['kind']} {r['name']}{sig}{about}")
    return "\n".join(lines) + "\n"


def callers_text(engine: Engine, symbol: str, direction: str = "in", depth: int | None = 1, within: str | None = None) -> str:
    hits = engine.callers(symbol, direction, depth, within)
    rows = hits.orderBy("depth", "path", "start_line", "id").limit(SHOWN).collect()
    word = "callers" if direction == "in" else "callees"
    if not rows:
        return f"{symbol}: no indexed {word}\n"
    arrow = "←" if direction == "in" else "→"
    lines = [f"{symbol}: {word}"]
    for r in rows:
        where = f"{r['path']}:L{r['start_line']}-L{r['end_line']}" if r["path"] else "external"
        lines.append(f"  {arrow} {r['name'] or r['id']}  {where}  ({r['relation']}{'' if depth == 1 else f', depth {r.depth}'})")
    if len(rows) == SHOWN:
        lines.append(f"  … {hits.count() - SHOWN} more")
    return "\n".join(lines) + "\n"


def grep_text(engine: Engine, pattern: str, within: str | None = None, ignore_case: bool = False, fixed: bool = False) -> str:
    res = engine.grep(pattern, within, ignore_case, fixed)
    size = res.groups.agg(F.count("*").alias("groups"), F.countDistinct("path").alias("files")).first()
    groups = res.groups.limit(SHOWN).collect()
    lines = [f'{LABEL} grep: "{pattern}": {res.total} hits in {size["groups"]} groups, {size["files"]} files']
    for g in groups:
        name = g["span_id"].split("#", 1)[-1] if g["span_id"] else "(module level)"
        lines += ["", f"{name}  {g['path']}  ({g['in_degree']}←)"]
        lines += [f"  {h['line']}: {h['text']}" for h in g["hits"][:SHOWN]]
        if g["n_hits"] > SHOWN:
            lines.append(f"  and {g['n_hits'] - SHOWN} further lines")
    if size["groups"] > SHOWN:
        lines += ["", f"and {size['groups'] - SHOWN} further groups"]
    return "\n".join(lines) + "\n"


def map_text(rm: M.RepoMap) -> str:
    t = rm.totals.first()
    lines = [f"{LABEL} map: {t['files']} files · {t['symbols']} symbols · {t['edges']} edges · {', '.join(t['languages'])}", ""]
    hubs: dict[tuple, list[str]] = {}
    for h in rm.hubs.orderBy("scope", "dir", "rank").collect():  # a few per shown directory
        hubs.setdefault((h["scope"], h["dir"]), []).append(f"{h['name']} ({h['path'].rsplit('/', 1)[-1]}, {h['in_degree']}←)")
    dropped = {r["scope"]: r["dropped"] for r in rm.dropped.collect()}
    scope = None
    for d in rm.dirs.orderBy("scope", "rank").collect():
        if len(dropped) > 1 and d["scope"] != scope:
            scope = d["scope"]
            lines.append(f"## {scope or '(root)'}")
        name = d["path"] if d["is_file"] else d["path"] + "/"
        tail = "   hubs: " + ", ".join(hubs[(d["scope"], d["dir"])]) if (d["scope"], d["dir"]) in hubs else ""
        lines.append(f"{name:<20}{d['files']} files · {d['symbols']} symbols{tail}")
    more = sum(dropped.values())
    if more:
        lines.append(f"… +{more} more directories not shown")
    spots = [f"{h['name']} · {h['kind']} · {h['path']}:L{h['start_line']}-L{h['end_line']} · {h['in_degree']}←" for h in rm.hotspots.collect()]
    return "\n".join([*lines, "", "hotspots: " + "  ".join(spots)]) + "\n"


def check_text(engine: Engine) -> tuple[str, bool]:
    """Drift report and verdict.  Lists are shown up to a limit, counts are whole."""
    found = engine.check()
    signs = {"changed": "~", "added": "+", "removed": "-", "stale": "!", "content": "~", "coverage": "+"}
    lines, clean, present = [], True, False
    for layer, df in found.items():
        if df is None:
            lines.append(f"{layer}: not built")
            continue
        present = True
        key = df.columns[0]
        counts = {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}
        if not counts:
            lines.append(f"{layer}: OK")
            continue
        clean = False
        lines.append(f"{layer}: STALE (" + ", ".join(f"{n} {s}" for s, n in sorted(counts.items())) + ")")
        for r in df.orderBy("status", key).limit(SHOWN).collect():
            detail = f" {r['before']} → {r['now']}" if layer == "files" and r["before"] else ""
            lines.append(f"  {signs.get(r['status'], '!')} {r[key]}{detail}")
    return "\n".join(lines) + "\n", present and clean


def freshness_banner(engine: Engine) -> str | None:
    """One line when indexed files are missing on disk."""
    from .operators.drift import freshness
    from .sources import files as FS

    prints = engine.store.table("prints")
    if prints is None:
        return None
    row = freshness(prints, FS.list_files(engine.spark, engine.root)).first()
    if not row["missing"]:
        return None
    return f"{row['missing']} of {row['total']} indexed files are not on disk; run build to refresh"


def status_line(engine: Engine) -> str:
    from .streaming.sessions import status

    r = status(engine.nodes(), engine.edges()).first()
    return f"{r['nodes']} nodes · {r['edges']} edges · {r['ready']} ready · {r['stale']} stale"


# --------------------------------------------------------------------------
# folders of repositories


def split_text(repos: list[str], mixed: bool) -> str:
    given_up = "; the graph over the whole folder is no longer used" if mixed else ""
    return f"{len(repos)} repositories, each with its own graph: {', '.join(repos)}{given_up}"


def refresh_text(done: Refresh) -> str:
    lines = [f"rebuilt before answering: {', '.join(done.rebuilt)}"] if done.rebuilt else []
    if done.failed:
        lines.append(f"not rebuilt, answers are of the last graph: {', '.join(done.failed)}")
    return "".join(line + "\n" for line in lines)


def space_ask_text(space: Workspace, query: str, limit: int, only: str | None, graph_rank: bool) -> str:
    fused = space.ask(query, limit, only, graph_rank)
    rows = fused.ranked.orderBy(F.col("score").desc(), "scope", "id").limit(limit).collect()
    lines = [f'{LABEL} ask: "{query}"', ""]
    for i, r in enumerate(rows, 1):
        lines += [f"{i}. [{r['scope']}/] {r['title']}", f"   {r['pointer']}"]
    also = [r["scope"] for r in fused.also_matched.orderBy("scope").limit(SHOWN).collect()]
    if also:
        lines += ["", "also matched: " + ", ".join(also)]
    return "\n".join(lines if rows else [*lines, "no matches."]) + "\n"


def space_callers_text(space: Workspace, symbol: str, direction: str, depth: int | None, within: str | None) -> str:
    hits = space.callers(symbol, direction, depth, within)
    order = ["symbol", *(["depth"] if "depth" in hits.columns else []), "id"]
    rows = hits.orderBy(*order).limit(SHOWN).collect()
    arrow = "←" if direction == "in" else "→"
    lines = [f"{r['symbol']} {arrow} {r['id']}  ({r['relation']})" for r in rows]
    if len(rows) == SHOWN:
        lines.append(f"… {hits.count() - SHOWN} more")
    return "\n".join(lines or [f"{symbol}: nothing indexed"]) + "\n"


def space_grep_text(space: Workspace, pattern: str, **flags) -> str:
    groups, counts = space.grep(pattern, **flags)
    found = counts.orderBy("repo").collect()  # one row per repository
    lines = [f'{LABEL} grep: "{pattern}": ' + (", ".join(f"{r['total_hits']} in {r['repo']}" for r in found) or "no hits")]
    for g in groups.orderBy(F.col("in_degree").desc(), "path", "first_line").limit(SHOWN).collect():
        lines += ["", f"{g['key']}  ({g['in_degree']}←)"]
        lines += [f"  {h['line']}: {h['text']}" for h in g["hits"][:SHOWN]]
        if g["n_hits"] > SHOWN:
            lines.append(f"  and {g['n_hits'] - SHOWN} further lines")
    return "\n".join(lines) + "\n"


def space_map_text(space: Workspace, max_dirs: int | None) -> str:
    dirs, _ = space.repo_map(max_dirs)
    rows = dirs.orderBy("scope", F.col("symbols").desc(), "path").limit(SHOWN).collect()
    return "\n".join(f"{r['path']}  {r['files']} files · {r['symbols']} symbols" for r in rows) + "\n"


def space_check_text(space: Workspace) -> tuple[str, bool]:
    """A line per repository; one that is not built never fails, but something must be built."""
    if not space.built():
        return "no repository is built\n", False
    rows = space.check().orderBy("repo").collect()  # one per repository
    lines = []
    for r in rows:
        counts = ", ".join(f"{r[s]} {s}" for s in ("added", "removed", "changed", "stale") if r[s])
        lines.append(f"{r['repo']}: " + ("not built" if not r["built"] else "OK" if r["ok"] else f"STALE ({counts})"))
    return "\n".join(lines) + "\n", all(r["ok"] for r in rows)
