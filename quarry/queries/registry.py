"""Per-module query registry: ``@register(key, oracle_sql)`` records the Spark callable and its
DuckDB twin (omit the SQL for keys without an SQL form)."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict = {}

    def __call__(self, name: str, sql: str | None = None):
        def deco(fn):
            if name in self.queries:
                raise ValueError(f"duplicate query key {name}")
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn
        return deco
