"""Sort, limit, top-k and seeded sampling (O-1..O-6).

Limits up to ``SMALL`` rows are ``orderBy(key).limit(n)``: Spark plans ``TakeOrderedAndProject``, where every map
task keeps its own top n and only n x tasks rows reach the final merge. Larger ones find the n-th key by narrowing and
filter by it (``operators.selection``); their rows come unsorted. No global window, no collect of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SMALL = 10_000


def _first(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    if n <= SMALL:
        return df.orderBy(*order).limit(n)
    from quarry.operators.selection import first_rows

    return first_rows(df, n, order)


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def first_n(df: DataFrame, n: int | None, order) -> DataFrame:
    """O-1: first ``n`` rows in dataset order (an explicit key); ``None`` keeps all; never more than exist."""
    if n is None:
        return df
    return _first(df, n, _cols(order))


def priority_target(df: DataFrame, target: int, order=("view_rank", "page", "pos")) -> DataFrame:
    """O-2: stop at ``target`` accepted records, filled in listing priority order (after gates, Q7)."""
    return _first(df, target, _cols(order))


def sample_key(seed: int, key: Column) -> Column:
    """Uniform, seeded, engine-independent sort key: md5 of ``'<seed>:<key>'``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_exact(df: DataFrame, n: int | None, seed: int, key: str) -> DataFrame:
    """O-3: exactly ``n`` rows without replacement, deterministic for a seed; all rows if n >= count."""
    if n is None:
        return df
    return _first(df, n, [sample_key(seed, F.col(key)), F.col(key)])


def sort_categorical(df: DataFrame, order_dim: DataFrame, label: str = "label", ord_col: str = "ord") -> DataFrame:
    """O-4: keep only labels listed in ``order_dim`` (label, ord) and sort by that order.
    ``order_dim`` is a fixed literal list, so it is broadcast."""
    return df.join(F.broadcast(order_dim), label, "inner").orderBy(ord_col)


def shuffle_options(options: Column, seed: int, qid: Column) -> Column:
    """O-5: seeded permutation of an array of option structs within one row (no shuffle).

    Each element is keyed by md5('<seed>:<qid>:<i>') and the array is sorted on that key."""
    keyed = F.transform(options, lambda o, i: F.struct(
        F.md5(F.concat(F.lit(f"{seed}:"), qid.cast("string"), F.lit(":"), i.cast("string"))).alias("k"),
        o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def sorted_by(df: DataFrame, *cols) -> DataFrame:
    """O-6: total order on the given columns (a range-partitioned sort at scale)."""
    return df.orderBy(*_cols(cols))


def row_index(df: DataFrame, key: str | list[str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """P-7: 0-based position of each row in ``key`` order without a global window, whatever other columns it has.

    Rows are range-partitioned and sorted by ``key`` and written once together with their partition and their
    position in it (``monotonically_increasing_id`` is consecutive per partition). Counts and rows are then both
    read from that table, so they agree however the range bounds were sampled. Each partition's offset is the
    count of all earlier ones: a table with one row per partition, which is broadcast."""
    from pyspark.sql import Window

    from quarry.session import materialize

    keys = [key] if isinstance(key, str) else list(key)
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    s = materialize(
        df.repartitionByRange(n, *[F.col(k) for k in keys]).sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)),
        "row-index")
    sizes = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_pid", "_local", "_off"))
