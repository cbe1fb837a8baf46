"""The registered queries, by family."""

from .registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    from . import build_queries, graph_queries, text_queries, workspace_queries  # noqa: F401

    return dict(QUERIES)
