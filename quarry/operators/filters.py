"""Row gates (F-1..F-10). Each returns a filtered DataFrame; predicates are plain columns so they push
down to the scan where the referenced columns come straight from Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# Comment bodies that mark a removed answer.
DELETED_MARKERS = ("[deleted]", "[removed]")
# Folder names that are never model outputs.
RESERVED_DIRS = ("temp", "combined", "evaluation")


def class_gate(df: DataFrame, use_class_filter: bool = True, keep: str = "KEEP") -> DataFrame:
    """F-1: keep rows whose class is KEEP, or that carry no class key at all (``has_class`` false).
    A present-but-null class fails (ledger Q3)."""
    if not use_class_filter:
        return df
    return df.where(~F.col("has_class") | F.col("class").eqNullSafe(keep))


def min_score(df: DataFrame, n: int = 0, col: str = "upvotes") -> DataFrame:
    """F-2: missing or null score counts as 0 (ledger Q4)."""
    return df.where(F.coalesce(F.col(col), F.lit(0)) >= n)


def min_length_pred(inp: str = "input", out: str = "output", min_in: int = 10, min_out: int = 2) -> Column:
    i, o = F.col(inp), F.col(out)
    return (
        i.isNotNull() & o.isNotNull() & (i != "") & (o != "")
        & (F.length(T.py_strip(i)) >= min_in) & (F.length(T.py_strip(o)) >= min_out)
    )


def min_length(df: DataFrame, inp: str = "input", out: str = "output", min_in: int = 10, min_out: int = 2) -> DataFrame:
    """F-3: non-empty input and output, stripped lengths at least ``min_in`` / ``min_out`` code points."""
    return df.where(min_length_pred(inp, out, min_in, min_out))


def word_band_pred(text: Column, lo: int = 6, hi: int = 50) -> Column:
    return T.word_count(text).between(lo, hi)


def word_band(df: DataFrame, text: Column, lo: int = 6, hi: int = 50) -> DataFrame:
    """F-4: whitespace word count in [lo, hi], both ends inclusive (ledger Q8)."""
    return df.where(word_band_pred(text, lo, hi))


def engagement(df: DataFrame, col: str = "num_comments", n: int = 1) -> DataFrame:
    """F-5: drop posts with fewer than ``n`` comments."""
    return df.where(F.col(col) >= n)


def score_by_view(df: DataFrame, gated_view: str = "new", min_score_: int = 3) -> DataFrame:
    """F-6: only in ``gated_view``, drop posts scoring below ``min_score_``."""
    return df.where(~((F.col("view") == gated_view) & (F.col("score") < min_score_)))


def comment_valid_pred(stickied: str = "stickied", body: str = "body") -> Column:
    return ~F.coalesce(F.col(stickied), F.lit(False)) & ~F.coalesce(F.col(body).isin(*DELETED_MARKERS), F.lit(False))


def comment_valid(df: DataFrame) -> DataFrame:
    """F-7: not stickied and the body is not a deleted/removed marker."""
    return df.where(comment_valid_pred())


def level_in(df: DataFrame, levels, col: str = "Number_of_Constraints") -> DataFrame:
    """F-8."""
    return df.where(F.col(col).isin(*list(levels)))


def model_dirs(df: DataFrame, col: str = "model", reserved=RESERVED_DIRS, contains: str | None = None) -> DataFrame:
    """F-9: drop reserved folder names; optionally keep names containing a family substring."""
    out = df.where(~F.col(col).isin(*reserved))
    if contains:
        out = out.where(F.col(col).contains(contains))
    return out


def quick_discard(inp: str = "input", out: str = "output", min_in: int = 10, min_out: int = 5) -> Column:
    """F-10: True when the stripped input or output is too short to be worth classifying."""
    i = F.length(T.py_strip(F.coalesce(F.col(inp), F.lit(""))))
    o = F.length(T.py_strip(F.coalesce(F.col(out), F.lit(""))))
    return (i < min_in) | (o < min_out)
