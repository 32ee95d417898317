"""Aggregations (A-1..A-11). All are partial+final hash/sort aggregates: a hot group is combined on
the map side before the shuffle, so its cost is one row per map task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_counts(df: DataFrame, col: str = "class", labels=("KEEP", "DISCARD")) -> DataFrame:
    """A-1: one row with a count per class label (``count_if``, single pass)."""
    return df.agg(*[F.count_if(F.col(col) == lab).alias(f"n_{lab.lower()}") for lab in labels])


def stage_counts(df: DataFrame, group: str, stages: list[tuple[str, Column]]) -> DataFrame:
    """A-2: funnel counts per group and in total (rollup), in one pass.

    ``stages`` are cumulative predicates: stage i counts rows passing predicates 1..i."""
    aggs = [F.count(F.lit(1)).alias("n_in")]
    acc = None
    for name, pred in stages:
        acc = pred if acc is None else (acc & pred)
        aggs.append(F.count_if(F.coalesce(acc, F.lit(False))).alias(name))
    out = df.rollup(group).agg(*aggs)
    return out.withColumn(group, F.coalesce(F.col(group), F.lit("__total__")))


def accuracy(df: DataFrame, group: list[str], correct: Column) -> DataFrame:
    """A-3: correct, total, correct/total (0 when total is 0)."""
    return df.groupBy(*group).agg(
        F.count_if(F.coalesce(correct, F.lit(False))).alias("correct"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("accuracy", F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total")), F.lit(0.0)))


def choice_rate(df: DataFrame, group: list[str], picked: str = "picked_trait", target: str = "high") -> DataFrame:
    """A-4: share of samples whose pick is ``target``; unanswered samples stay in the denominator."""
    return df.groupBy(*group).agg(
        F.count_if(F.col(picked).eqNullSafe(target)).alias("high_trait_count"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("high_trait_rate",
                 F.coalesce(F.try_divide(F.col("high_trait_count").cast("double"), F.col("total")), F.lit(0.0)))


def best_of_k(trials: DataFrame, keys: list[str], trial: str = "trial", correct: str = "correct", k: int = 3) -> DataFrame:
    """A-5: per (task, test): solved if any of the first ``k`` trials is right; ``trials_needed`` is the
    first right trial (null if unsolved); trials after the first success are not counted (Q13)."""
    t = trials.where(F.col(trial) <= k)
    first_ok = F.min(F.when(F.col(correct), F.col(trial)))
    out = t.groupBy(*keys).agg(
        first_ok.alias("trials_needed"),
        F.max(trial).alias("_max_trial"),
    )
    return out.select(
        *keys,
        F.col("trials_needed").isNotNull().alias("solved"),
        F.col("trials_needed").cast("bigint").alias("trials_needed"),
        F.coalesce(F.col("trials_needed"), F.col("_max_trial")).cast("bigint").alias("trials_used"),
    )


def metric_stats(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """A-6: mean, exact median, min, max over non-null values (median via ``exact_median``).

    The (group, value) pairs are written once: the aggregate, the median's range sampling and its
    two branches then read that small table instead of recomputing an expensive input."""
    from quarry.session import materialize

    keys = list(group) or ["_all"]
    keyed = df if group else df.withColumn("_all", F.lit(1))
    keyed = materialize(keyed.select(*keys, value), "stats-values")
    v = F.col(value)
    stats = keyed.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count(v).alias("n_scored"), F.count(F.lit(1)).alias("n_rows"))
    out = stats.join(exact_median(keyed, keys, value, stage=False), keys, "left")
    return out.select(*group, "mean", "median", "min", "max", "n_scored", "n_rows")


def split_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """A-11: per model and split: total, solved and accuracy (0 when empty)."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_tasks"), F.count_if(F.col("solved")).alias("solved"),
    ).withColumn("accuracy", F.coalesce(F.try_divide(F.col("solved").cast("double"), F.col("total_tasks")), F.lit(0.0)))


def exact_median(df: DataFrame, group: list[str], value: str, partitions: int | None = None,
                 stage: bool = True) -> DataFrame:
    """Exact median of non-null ``value`` per group (mean of the two middle values when the count
    is even), without gathering a group's values in one task: ``median`` buffers every distinct
    value of a group in its final task, which a group holding a third of all rows cannot afford.

    Values are range-partitioned and sorted by (group, value); a row's rank in its group is the
    count of its group in earlier partitions plus its position inside its partition. The per
    (partition, group) count table has at most #groups + #partitions rows and each group spans at
    most #partitions of them; only the partitions holding a group's one or two middle ranks are
    joined back (AQE broadcasts that table when it is small). The range partitioner samples its
    input in a pass of its own, so (group, value) pairs are written first (``stage``; pass False when
    ``df`` is already a written table); the sorted rows feed two branches that must see the same
    partitions, so they are written with their partition and place and both branches read that."""
    from pyspark.sql import Window

    from quarry.session import materialize

    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    v = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    if stage:
        v = materialize(v, "median-values")
    s = materialize(
        v.repartitionByRange(n, *[F.col(g) for g in group], F.col("_v")).sortWithinPartitions(*group, "_v")
        .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()), "median-sorted")
    stats = s.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_pid")
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*group))
    stats = stats.select("_pid", *group, "_n", "_m0", before.alias("_before"), total.alias("_total"))
    lo, hi = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    end = F.col("_before") + F.col("_n") - 1
    targets = stats.where(lo.between(F.col("_before"), end) | hi.between(F.col("_before"), end)).select(
        "_pid", *group, "_m0", "_before", lo.alias("_lo"), hi.alias("_hi"))
    picked = s.join(targets, ["_pid", *group]).withColumn("_rank", F.col("_before") + F.col("_mid") - F.col("_m0"))
    picked = picked.where((F.col("_rank") == F.col("_lo")) | (F.col("_rank") == F.col("_hi")))
    return picked.groupBy(*group).agg(F.avg("_v").alias("median"))
