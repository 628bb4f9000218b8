"""Named queries over the driver tables, each with its check in SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES, Query

MODULES = ("alignment_queries", "text_queries", "name_queries", "bank_queries", "scoring_queries",
           "log_queries", "source_queries", "stream_queries")


def all_queries() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return dict(QUERIES)
