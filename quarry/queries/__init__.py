"""Registry of every query with its DuckDB twin. Modules register ``QUERIES`` / ``ORACLE`` dicts."""

from __future__ import annotations

import importlib

MODULES = ("text_q", "chat_q", "curate_q", "score_q", "grid_q", "ppl_q", "results_q", "io_q", "stream_q", "select_q")


def _load():
    queries, oracle = {}, {}
    for m in MODULES:
        mod = importlib.import_module(f"quarry.queries.{m}")
        for k in mod.QUERIES:
            if k in queries:
                raise ValueError(f"duplicate query key {k}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
