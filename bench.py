"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codeloom.plans import all_queries  # noqa: E402
from codeloom.session import local_session  # noqa: E402

HEADLINE = [
    "tokenize_counts", "doc_frequency", "ask_lexical_topk", "ask_scope_rrf", "ask_graph_blend",
    "in_degree", "repo_map_dirs", "hub_topk_per_dir", "callers_1hop", "impact_bfs_depth3", "closure_callees",
    "grep_hits", "grep_grouped_by_span", "resolve_name_unique", "resolve_typed_chain",
    "drift_full_outer", "fingerprint_probe", "concept_merge", "batch_greedy", "novelty_dedup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "codeloom-bench")
    known = all_queries()
    # one query warms the JVM and the Python side; it is not counted
    known["body_lengths"].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.time()
        known[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
