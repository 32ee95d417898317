"""Join helpers.

``hot_split_join`` is the skew-safe equi-join used where one side is a per-key dimension (exactly one
row per key, e.g. corpus word counts) and the other side repeats hot keys without bound (every
document contains "the"). The dimension's own weight column names the hot keys: the top ``hot_k``
keys (with a bounded key width) are broadcast - a proven size bound of ``hot_k`` rows - and joined
without moving the big side; only cold rows go through the shuffle join, where no key is hot.
``salted_join`` does the same for wide dimension rows, by salting the hot keys. ``block_join`` is for keys
that repeat on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_K = 10_000
HOT_KEY_MAX_CHARS = 64


def _bounded(col: str, most: int):
    """The key, or a digest where it is longer than ``most``: hot keys of any length join at a bounded width."""
    text = F.col(col).cast("string")
    return F.when(F.length(text) > most, F.concat(F.lit("md5:"), F.md5(text))).otherwise(text)


def hot_keys_by_count(df: DataFrame, keys: list[str], hot_k: int = HOT_K) -> DataFrame:
    """The ``hot_k`` most frequent keys of a fact table (partial+final count, then a top-k): the
    fact-side hot set for ``hot_split_join(..., hot_keys=...)``."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.col("_n").desc(), *keys).limit(hot_k).select(*keys))


def hot_split_join(big: DataFrame, dim: DataFrame, keys: list[str], weight: str | None = None, hot_k: int = HOT_K,
                   max_key_chars: int = HOT_KEY_MAX_CHARS, how: str = "inner",
                   hot_keys: DataFrame | None = None) -> DataFrame:
    """Equi-join ``big`` with ``dim`` (unique on ``keys``) without a hot reducer.

    ``big`` feeds two branches (hot and cold rows): pass a frame that is cheap to derive twice (a
    map-only derivation of a scan, or a materialized stage table), not one behind a shuffle.

    The hot set is the top ``hot_k`` dim keys by ``weight`` (dimension-side frequency, e.g. corpus
    counts), or the given ``hot_keys`` (fact-side frequency, see ``hot_keys_by_count``); either way it
    is cut to ``hot_k`` rows, the broadcast's bound. Any hot set gives the same result.

    ``how`` is "inner" or "left" (big side preserved). Result columns: big's, then dim's non-keys."""
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    dim_cols = [c for c in dim.columns if c not in keys]
    wide = [f"_w_{k}" for k in keys]
    if hot_keys is None:
        hot_dim = dim.orderBy(F.col(weight).desc(), *keys).limit(hot_k)
    else:
        hot_dim = dim.join(hot_keys.limit(hot_k), keys, "left_semi")
    hot = hot_dim.select(*[_bounded(k, max_key_chars).alias(w) for k, w in zip(keys, wide, strict=True)],
                         *[F.col(c).alias(f"_hot_{c}") for c in dim_cols], F.lit(True).alias("_is_hot"))
    keyed = big.withColumns({w: _bounded(k, max_key_chars) for k, w in zip(keys, wide, strict=True)})
    tagged = keyed.join(F.broadcast(hot), wide, "left")
    hot_part = tagged.where(F.col("_is_hot")).select(
        *big.columns, *[F.col(f"_hot_{c}").alias(c) for c in dim_cols])
    cold = tagged.where(F.col("_is_hot").isNull()).select(*big.columns)
    cold_part = cold.join(dim, keys, how).select(*big.columns, *dim_cols)
    return hot_part.unionByName(cold_part)


def salted_join(big: DataFrame, dim: DataFrame, key: str, spread: list[str], how: str = "inner", hot_rows: int = 10_000,
                salts: int | None = None, hot_k: int = HOT_K) -> DataFrame:
    """Equi-join of ``big`` with a dimension (unique on ``key``) whose rows are too wide to broadcast: keys that ``big``
    repeats more than ``hot_rows`` times are salted by a hash of the ``spread`` columns and their one dimension
    row is repeated per salt, so a key with a third of all rows spreads over ``salts`` tasks."""
    salts = salts or big.sparkSession.sparkContext.defaultParallelism
    hot = F.broadcast(big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
                      .orderBy(F.col("_n").desc(), key).limit(hot_k).select(key, F.lit(True).alias("_hot")))
    b = big.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0).cast("bigint"))).drop("_hot")
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    d = dim.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0).cast("bigint"))))).drop("_hot")
    return b.join(d, [key, "_salt"], how).drop("_salt")


def block_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, block_rows: int = 10_000, hot_k: int = HOT_K) -> DataFrame:
    """Inner equi-join, null matching null, for keys that may be hot on both sides. From exact counts, a key with more than
    ``block_rows`` rows on a side is cut into row blocks (left) and column blocks (right) of about that size; every left row goes to all
    column blocks of its row block and the other way round, so each cell of two blocks is one group of the join and a key's product
    spreads over its cells. Blocks follow a hash of the whole row, so they are the same whenever a task is run again; rows
    equal in every column share a block. Counts are kept for the ``hot_k`` largest products of hot keys (by hash of the key), which
    bounds the broadcast. Result columns: left's, then right's."""
    count = lambda df, key, name: df.groupBy(F.xxhash64(key).alias("_h")).agg(F.count(F.lit(1)).alias(name))
    hot = (count(left, left_key, "_l").join(count(right, right_key, "_r"), "_h").where(F.greatest("_l", "_r") > block_rows)
           .orderBy((F.col("_l") * F.col("_r").cast("double")).desc(), "_h").limit(hot_k)
           .select("_h", F.ceil(F.col("_l") / block_rows).cast("int").alias("_a"), F.ceil(F.col("_r") / block_rows).cast("int").alias("_b")))

    def cut(df: DataFrame, key: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        block = F.coalesce(F.pmod(F.xxhash64(*df.columns, F.lit(1)), F.col(own)).cast("int"), F.lit(0))
        every = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        with_blocks = df.withColumn("_h", F.xxhash64(key)).join(F.broadcast(hot), "_h", "left")
        return with_blocks.select(*df.columns, block.alias(mine), F.explode(every).alias(theirs))
    x = cut(left, left_key, "_a", "_b", "_i", "_j").alias("x")
    y = cut(right, right_key, "_b", "_a", "_j", "_i").alias("y")
    on = F.col(f"x.`{left_key}`").eqNullSafe(F.col(f"y.`{right_key}`")) & (F.col("x._i") == F.col("y._i")) & (F.col("x._j") == F.col("y._j"))
    return x.join(y, on).select(*[F.col(f"x.`{c}`") for c in left.columns], *[F.col(f"y.`{c}`") for c in right.columns])
