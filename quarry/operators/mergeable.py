"""A-6 / A-8 over many runs: statistics kept per (group, run) and merged on read, so that earlier runs are not read again.

A kept row holds counts, sum, sum of squares, minimum, maximum and a KLL quantile sketch of a run's values. All merge: sums and extremes
exactly, sketches by ``kll_merge_agg_double``, in any order. A sketch is bounded by ``k`` whatever the run's size (a few times k values); up to about
k values it is exact, beyond that a quantile's rank is off by at most ``rank_error(k)`` of the rows, with 99 % confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 2000


def rank_error(k: int = K) -> float:
    """Normalised rank error of one quantile of a KLL sketch (99 % confidence), the published fit for this sketch."""
    return 2.296 / k ** 0.9723


def run_statistics(df: DataFrame, value: str, group: list[str], run: str, k: int = K) -> DataFrame:
    """One mergeable row per (group, run); null and NaN values count in n_rows only. Partial sketches are built map-side, so a hot
    group costs its reducer one sketch per map task."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    return df.groupBy(*group, run).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_scored"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def add_runs(df: DataFrame, path: str, value: str, group: list[str], run: str, k: int = K) -> str:
    """Keep the statistics of the runs in ``df``, one folder per run: a run that is written again replaces itself, others stay."""
    stats = run_statistics(df, value, group, run, k)
    stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)
    return path


def merged_statistics(kept: DataFrame, group: list[str], quantile: float = 0.5) -> DataFrame:
    """n_rows, n_scored, mean, stddev (population), min, max and ``quantile`` per group over all kept runs; null where no value is."""
    m = kept.groupBy(*group).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_scored").alias("n_scored"), F.sum("total").alias("_t"), F.sum("squares").alias("_q"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("_s"))
    n = F.nullif(F.col("n_scored"), F.lit(0))
    mean = F.col("_t") / n
    return m.select(*group, "n_rows", "n_scored", mean.alias("mean"),
                    F.when(n.isNotNull(), F.sqrt(F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0)))).alias("stddev"), "min", "max",
                    F.when(F.col("n_scored") > 0, F.kll_sketch_get_quantile_double("_s", F.lit(quantile))).alias("quantile"))


def rank_off(df: DataFrame, merged: DataFrame, value: str, group: list[str], quantile: float = 0.5) -> DataFrame:
    """How far each group's merged quantile is from the exact rank, as a share of its values: 0 where the exact rank lies among the values equal
    to it. One pass of conditional counts over the values (``merged`` has one row per group)."""
    q = merged.select(*group, F.col("quantile").alias("_q"))
    v = F.col(value).cast("double")
    c = df.join(q, group).where(v.isNotNull() & ~F.isnan(v)).groupBy(*group).agg(
        F.avg((v < F.col("_q")).cast("int")).alias("_below"), F.avg((v <= F.col("_q")).cast("int")).alias("_upto"))
    return c.select(*group, F.greatest(F.col("_below") - quantile, F.lit(quantile) - F.col("_upto"), F.lit(0.0)).alias("rank_off"))
