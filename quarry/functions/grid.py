"""Digit grids as native nested arrays: reply text -> grid, grid -> text, exact comparison, shape.

Parsing follows the reference rules (ledger Q12): strip the reply, split on '\\n' only, strip each
line and drop empty ones; in each line every character that is neither a digit nor whitespace is
deleted (so ``1,2,3`` becomes ``123``); whitespace tokens become integers; lines left without a
number vanish; no rows at all -> null (never correct). Digits are ASCII; a token beyond 64 bits
becomes a null cell, which never equals an expected value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import SPARK_WS_CLASS, WS_CLASS, py_split, py_strip

NON_DIGIT_NON_WS = "[^0-9" + SPARK_WS_CLASS[1:]
NON_DIGIT_NON_WS_RE2 = "[^0-9" + WS_CLASS[1:]


def parse_grid(reply: Column) -> Column:
    lines = F.filter(F.transform(F.split(py_strip(reply), "\n"), lambda ln: py_strip(ln)), lambda ln: ln != "")
    rows = F.transform(lines, lambda ln: F.transform(py_split(F.regexp_replace(ln, NON_DIGIT_NON_WS, "")),
                                                    lambda tok: tok.try_cast("bigint")))
    rows = F.filter(rows, lambda r: F.size(r) > 0)
    return F.when(F.size(rows) > 0, rows)


def grid_text(grid: Column, sep: str = " ") -> Column:
    """Rows of ``sep``-joined numbers, one per line."""
    return F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), sep)), "\n")


def grids_equal(predicted: Column, expected: Column) -> Column:
    """Deep equality; a null prediction is never correct."""
    return F.coalesce(predicted == expected, F.lit(False))


def grid_shape(grid: Column) -> Column:
    """[rows, len(first row)], second 0 when the grid is empty."""
    return F.array(F.size(grid).cast("int"), F.coalesce(F.size(F.try_element_at(grid, F.lit(1))), F.lit(0)).cast("int"))
