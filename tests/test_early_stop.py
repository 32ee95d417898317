"""O-2 with early stop: same rows as a full sort, later folders not read, hot rank, ties and odd targets."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import early_stop as ES


@pytest.fixture(scope="module")
def rows(spark):
    """Rank 0 holds two thirds of the rows; some pages are empty, some ranks and pages null."""
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 < 2, 0).otherwise((F.col("id") % 5).cast("int")).cast("int").alias("view_rank"),
        F.floor(F.col("id") / 7 % 200).cast("bigint").alias("page"), F.col("id").alias("pos"))
    odd = spark.createDataFrame([(9001, None, 3, 0), (9002, 0, None, 0)], "id bigint, view_rank int, page bigint, pos bigint")
    return df.unionByName(odd)


def _landed(spark, rows, root):
    path = ES.land_by_priority(rows, f"{root}/landed", pages_per_block=16, rows_per_file=500)
    landed = spark.read.parquet(path)
    return landed, landed.groupBy("_rank", "_block").agg(F.count(F.lit(1)).alias("n"))


@pytest.mark.parametrize("target", [0, 1, 2, 3, 117, 2000, 2999, 3002, 5000])
def test_same_rows_as_a_full_sort(spark, rows, tmpdir_fresh, target):
    landed, counts = _landed(spark, rows, tmpdir_fresh)
    got = ES.first_of_landed(landed, counts, target, ["view_rank", "page", "pos"])
    want = sorted((r for r in rows.collect()), key=lambda r: tuple((x is not None, x) for x in (r.view_rank, r.page, r.pos)))[:target]
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want)
    assert got.columns == rows.columns


def test_folders_behind_the_target_are_not_read(spark, rows, tmpdir_fresh):
    landed, counts = _landed(spark, rows, tmpdir_fresh)
    got = ES.first_of_landed(landed, counts, 300, ["view_rank", "page", "pos"])
    plan = got.select("id", "view_rank", "page", "pos")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 2 and "_rank" in plan.split("PartitionFilters: ")[1].split("]")[0]
    read = {tuple(r) for r in landed.join(got.select("id"), "id").select("_rank", "_block").distinct().collect()}
    assert len(read) < counts.count() / 2


def test_hot_rank_is_spread_over_tasks(spark, rows, tmpdir_fresh):
    landed, _ = _landed(spark, rows, tmpdir_fresh)
    per_file = landed.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert per_file < 2000 / 4


def test_empty_table(spark, rows, tmpdir_fresh):
    path = ES.land_by_priority(rows.limit(0), f"{tmpdir_fresh}/landed")
    landed = ES.read_landed(spark, path, rows.schema)
    counts = landed.groupBy("_rank", "_block").agg(F.count(F.lit(1)).alias("n"))
    assert ES.first_of_landed(landed, counts, 10, ["view_rank", "page", "pos"]).count() == 0


def test_curation_to_a_target_is_the_head_of_the_whole_job(spark):
    from quarry.plans import curate as CU
    from quarry.sources.tables import table

    events, conv = (table(spark, "/root/testdata/sf0.001", t) for t in ("events", "conversations"))
    order = ["view_rank", "page", "pos"]
    whole = [tuple(r) for r in CU.answered_posts(events, conv).orderBy(*order).select("id", "answer", "title").collect()]
    for target in (len(whole) // 3, len(whole) + 50):
        got = CU.answered_to_target(events, conv, target, pages_per_block=2).orderBy(*order).select("id", "answer", "title")
        assert [tuple(r) for r in got.collect()] == whole[:target]
