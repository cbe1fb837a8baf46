"""Small hand-made graphs."""

NODE = ("id string, name string, kind string, path string, start_line int, end_line int, signature string, "
        "body_hash string, chars bigint, body_text string, summary_state string, summary string, ord bigint")


def nodes(spark, rows):
    """Rows of (id, kind, path, …) with keyword overrides in a dict at the end."""
    out = []
    for i, r in enumerate(rows):
        id_, kind, path, *more = r
        d = dict(name=id_.rsplit("#", 1)[-1].rsplit(".", 1)[-1] if kind != "file" else path.rsplit("/", 1)[-1],
                 start_line=1, end_line=1, signature=None, body_hash="h", chars=None, body_text=None,
                 summary_state="pending", summary=None, ord=i)
        d.update(more[0] if more else {})
        out.append((id_, d["name"], kind, path, d["start_line"], d["end_line"], d["signature"], d["body_hash"], d["chars"],
                    d["body_text"], d["summary_state"], d["summary"], d["ord"]))
    return spark.createDataFrame(out, NODE)


def edges(spark, rows):
    out = [(s, t, (rel[0] if rel else "calls"), "extracted", i) for i, (s, t, *rel) in enumerate(rows)]
    return spark.createDataFrame(out, "source string, target string, relation string, confidence string, ord bigint")


def simple(spark, ids):
    return nodes(spark, [(i, "function", f"src/{i}.py") for i in ids])
