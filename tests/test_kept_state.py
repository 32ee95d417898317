"""Statistics and coverage that are kept and merged: order does not matter, hot groups, repeats, odd values; equal to the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import cell_bitmaps as B
from quarry.operators import mergeable as M


@pytest.fixture(scope="module")
def values(spark):
    """A hot group of skewed values with many ties, a small one, one of nulls and NaN only."""
    hot = spark.range(60_000).select(F.lit("hot").alias("g"), (F.col("id") % 7).alias("run"),
                                     F.floor(F.pow(F.rand(3) * 100, 2)).cast("double").alias("x"))
    rest = spark.createDataFrame([("few", 0, 1.0), ("few", 1, 2.0), ("few", 6, 9.0), ("none", 0, None), ("none", 1, float("nan"))],
                                 "g string, run bigint, x double")
    return hot.unionByName(rest).cache()


def test_merged_statistics_within_the_stated_rank_error(spark, values, tmpdir_fresh):
    runs, merged = list(range(7)), []
    for attempt in range(2):
        random.Random(attempt).shuffle(runs)  # merge order does not matter
        for r in runs:
            M.add_runs(values.where(F.col("run") == r), f"{tmpdir_fresh}/kept{attempt}", "x", ["g"], "run", k=400)
        M.add_runs(values.where("run = 3"), f"{tmpdir_fresh}/kept{attempt}", "x", ["g"], "run", k=400)  # again: replaces itself
        merged.append(M.merged_statistics(spark.read.parquet(f"{tmpdir_fresh}/kept{attempt}"), ["g"], 0.9))
    exact = {r.g: r for r in values.where(~F.isnan("x")).groupBy("g").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("lo"),
                                                                         F.max("x").alias("hi"), F.count("x").alias("n")).collect()}
    for m in merged:
        got = {r.g: r for r in m.collect()}
        for g in ("hot", "few"):
            assert got[g].n_scored == exact[g].n and (got[g].min, got[g].max) == (exact[g].lo, exact[g].hi)
            assert got[g].mean == pytest.approx(exact[g].mean) and got[g].stddev == pytest.approx(exact[g].sd)
        assert tuple(got["none"])[1:] == (2, 0, None, None, None, None, None)
        off = {r.g: r.rank_off for r in M.rank_off(values, m, "x", ["g"], 0.9).collect()}
        assert off["hot"] <= M.rank_error(400) and off["few"] <= 1 / 3


def test_missing_cells_equal_the_anti_join_across_buckets(spark, tmpdir_fresh):
    n = 2 * B.BITS + 777  # two whole buckets and a part
    models = spark.createDataFrame([("full",), ("holes",), ("nothing",), ("holes",)], "m string")
    full = spark.range(1, n + 1).select(F.lit("full").alias("m"), F.col("id").alias("c"))
    holes = spark.range(1, n + 1).where("id % 10 = 0 OR id > 65530").select(F.lit("holes").alias("m"), F.col("id").alias("c"))
    odd = spark.createDataFrame([("holes", 0), ("holes", None), (None, 5), ("holes", n + 3), ("stranger", 1), ("holes", 10)], "m string, c bigint")
    results = full.unionByName(holes).unionByName(odd)
    kept = B.cell_bitmaps(results.where("c % 2 = 0"), "m", "c")
    kept = B.merge_bitmaps(kept, B.cell_bitmaps(results.where("c % 2 = 1"), "m", "c"), "m")
    kept = B.merge_bitmaps(kept, B.cell_bitmaps(holes, "m", "c"), "m")  # the same results again
    assert kept.agg(F.max(F.length("bits"))).first()[0] <= B.BITS // 8
    grid = models.distinct().crossJoin(spark.range(1, n + 1).withColumnRenamed("id", "c"))
    want = grid.join(results.select("m", "c").distinct(), ["m", "c"], "left_anti")
    got = B.missing_cells(models, kept, "m", n, "c")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    count = {r.m: (r.n_done, r.n_missing) for r in B.coverage_counts(models, kept, "m", n).collect()}
    missing = {r["m"]: r["count"] for r in want.groupBy("m").count().collect()}
    assert count == {m: (n - missing.get(m, 0), missing.get(m, 0)) for m in ("full", "holes", "nothing")}


def test_no_cells_and_no_results(spark):
    models = spark.createDataFrame([("a",)], "m string")
    none = B.cell_bitmaps(spark.createDataFrame([], "m string, c bigint"), "m", "c")
    assert B.missing_cells(models, none, "m", 0).isEmpty()
    assert {r.cell for r in B.missing_cells(models, none, "m", 3).collect()} == {1, 2, 3}
