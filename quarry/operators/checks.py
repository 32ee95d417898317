"""Analysis-time checks (P-6): they read only ``df.schema`` and run no job."""

from __future__ import annotations

from pyspark.sql import DataFrame


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail before any job runs if a required column is absent; returns ``df`` for chaining."""
    have = set(df.columns)
    missing = [n for n in names if n not in have]
    if missing:
        raise MissingColumnsError(f"required column(s) missing: {missing}; have {sorted(have)}")
    return df


def missing_columns(df: DataFrame, *names: str) -> list[str]:
    """Report form of ``require_columns``."""
    have = set(df.columns)
    return [n for n in names if n not in have]
