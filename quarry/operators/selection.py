"""The first n rows in an order for any n, without a sort of all rows and without a task that sees n rows of every other.

The n-th key is found by narrowing: a bounded sample of the keys still in question gives splitters, one counting pass tells how
many rows lie between them, and the interval that holds the n-th row is narrowed again. Rows below it are taken by a filter; only the
last interval (a few thousand rows, or the rows of a single key) is put in order, over range partitions. Every pass reads
the order columns alone, and what reaches the driver is a sample of at most a few hundred keys and as many counts.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordering import row_index

SPLITTERS = 64
LAST = 10_000
_GRAIN = 1 << 30


def _key(df: DataFrame, order: list[Column]) -> Column:
    """The order columns as one comparable value (nulls first, as in an ascending sort); ties go by a digest of the row."""
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.xxhash64(*df.columns).alias("tie"))


def _value(row) -> Column:
    return F.struct(*[F.lit(v).alias(name) for name, v in row.asDict().items()])


def nth_interval(keys: DataFrame, n: int, total: int, last: int = LAST):
    """(low, high, before, size): the n-th smallest key (from 1) lies in [low, high), which holds ``size`` rows and has
    ``before`` rows below it. ``low`` or ``high`` is null where the interval is open."""
    low = high = None
    before, size, step = 0, total, 0
    while size > last:
        step += 1
        inside = keys
        if low is not None:
            inside = inside.where(F.col("key") >= _typed(keys, low))
        if high is not None:
            inside = inside.where(F.col("key") < _typed(keys, high))
        share = min(1.0, 4 * SPLITTERS / size)
        drawn = inside.where(F.pmod(F.xxhash64("key", F.lit(step)), F.lit(_GRAIN)) < int(share * _GRAIN)).select("key").distinct()
        picks = [r["key"] for r in drawn.orderBy("key").limit(8 * SPLITTERS).collect()]
        ends = inside.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
        if ends["lo"] == ends["hi"]:
            break
        picks = [p for p in picks if p != ends["lo"]] or [ends["hi"]]
        picks = picks[::max(1, len(picks) // SPLITTERS)]
        marks = F.array(*[_typed(keys, p) for p in picks])
        slot = F.size(F.filter(marks, lambda m: m <= F.col("key")))
        counts = {r["slot"]: r["count"] for r in inside.groupBy(slot.alias("slot")).count().collect()}
        sums, at = [], before
        for s in range(len(picks) + 1):
            at += counts.get(s, 0)
            sums.append(at)
        s = bisect_right(sums, n - 1)
        before, size = (sums[s - 1] if s else before), counts.get(s, 0)
        low, high = (picks[s - 1] if s else low), (picks[s] if s < len(picks) else high)
    return low, high, before, size


def _typed(keys: DataFrame, row) -> Column:
    return _value(row).cast(keys.schema["key"].dataType)


def first_rows(df: DataFrame, n: int, order, last: int = LAST) -> DataFrame:
    """Exactly the ``n`` first rows of ``df`` by ``order`` (ascending; ties by a digest of the whole row, equal rows are
    exchangeable); all rows if there are not more. The rows come in no particular order."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if n <= 0:
        return df.limit(0)
    total = df.count()
    if n >= total:
        return df
    key = _key(df, order)
    keys = df.select(key.alias("key"))
    low, high, before, _ = nth_interval(keys, n, total, last)
    taken = df.where(key < _typed(keys, low)) if low is not None else df.limit(0)
    if low is not None:
        rest = df.where(key >= _typed(keys, low))
    else:
        rest = df
    if high is not None:
        rest = rest.where(key < _typed(keys, high))
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    # rows of one key differ in nothing that matters here, so they may be spread by any other value
    spread = rest.withColumn("_key", key).withColumn("_spread", F.rand(0))
    placed = row_index(spread, ["_key", "_spread"], "_place", parts)
    return taken.unionByName(placed.where(F.col("_place") < n - before).drop("_key", "_spread", "_place"))
