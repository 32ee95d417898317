"""Stream = batch, including across a stop and restart from the checkpoint with new files arriving."""

from pyspark.sql import functions as F

from quarry.operators import filters as FL
from quarry.operators import windows as W
from quarry.plans import curate as CU
from quarry.sources.tables import table
from quarry.streaming.first_seen import compact_changelog, file_stream, read_first_seen, start_first_seen
from quarry.streaming.incremental import start_append

SMALL = "/root/testdata/sf0.001"


def _land_in_two_waves(spark, events, root):
    """Two waves of files: the second wave arrives after the first run has stopped."""
    first = events.where(F.col("event_id") % 2 == 0)
    second = events.where(F.col("event_id") % 2 == 1)
    first.repartition(3).write.mode("append").parquet(f"{root}/in")
    return second


def test_first_seen_survives_restart(spark, tmpdir_fresh):
    events = table(spark, SMALL, "events")
    second = _land_in_two_waves(spark, events, tmpdir_fresh)
    order, payload = ["view_rank", "page", "pos"], ["view", "score", "num_comments", "thread_id"]
    for _ in range(2):
        stream = CU.listing_from_events(file_stream(spark, f"{tmpdir_fresh}/in", events.schema, 1))
        start_first_seen(stream, "id", order, payload, f"{tmpdir_fresh}/log", f"{tmpdir_fresh}/ckpt").awaitTermination()
        second.repartition(2).write.mode("append").parquet(f"{tmpdir_fresh}/in")
        second = second.where("false")
    log = compact_changelog(spark, f"{tmpdir_fresh}/log", "id", f"{tmpdir_fresh}/compacted")
    assert spark.read.parquet(log).groupBy("id").count().where("count > 1").isEmpty()
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = read_first_seen(spark, log, "id")
    want = W.first_seen(CU.listing_from_events(events))
    cols = ["id", "view", "page", "pos", "score"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())


def test_incremental_save_no_duplicates_after_restart(spark, tmpdir_fresh):
    events = table(spark, SMALL, "events")
    second = _land_in_two_waves(spark, events, tmpdir_fresh)

    def accepted():
        s = CU.listing_from_events(file_stream(spark, f"{tmpdir_fresh}/in", events.schema, 1))
        return FL.score_by_view(FL.engagement(s), CU.GATED_VIEW, 3).select("id", "page", "pos")

    start_append(accepted(), f"{tmpdir_fresh}/sink", f"{tmpdir_fresh}/ckpt").awaitTermination()
    n_first = spark.read.parquet(f"{tmpdir_fresh}/sink").count()
    second.repartition(2).write.mode("append").parquet(f"{tmpdir_fresh}/in")
    start_append(accepted(), f"{tmpdir_fresh}/sink", f"{tmpdir_fresh}/ckpt").awaitTermination()
    start_append(accepted(), f"{tmpdir_fresh}/sink", f"{tmpdir_fresh}/ckpt").awaitTermination()  # nothing new
    got = spark.read.parquet(f"{tmpdir_fresh}/sink")
    want = FL.score_by_view(FL.engagement(CU.listing_from_events(events)), CU.GATED_VIEW, 3).select("id", "page", "pos")
    assert 0 < n_first < got.count()
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_watermarked_first_seen_equals_batch_on_unique_batches(spark, tmpdir_fresh):
    """Each file holds each id at most once (the survey's unique-per-batch input): the bounded-state
    variant then returns exactly the batch first-seen rows."""
    from pyspark.sql import Window

    from quarry.streaming.first_seen import start_first_seen_watermarked

    events = table(spark, SMALL, "events")
    listing = CU.listing_from_events(events).withColumn("ts", F.timestamp_seconds(F.col("created_utc").cast("bigint")))
    # file i holds the i-th occurrence of every id, so files arrive in listing order and no file repeats an id
    occ = listing.withColumn("occ", F.row_number().over(Window.partitionBy("id").orderBy("view_rank", "page", "pos")))
    for i in sorted(r.occ for r in occ.select("occ").distinct().collect()):
        occ.where(F.col("occ") == i).drop("occ").coalesce(1).write.mode("append").parquet(f"{tmpdir_fresh}/in/occ={i:03d}")
    schema = listing.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmpdir_fresh}/in")
    start_first_seen_watermarked(stream, "id", "ts", "3650 days", f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ckpt").awaitTermination()
    got = spark.read.parquet(f"{tmpdir_fresh}/out").select("id", "view", "page", "pos")
    want = W.first_seen(CU.listing_from_events(events)).select("id", "view", "page", "pos")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_bounded_first_seen_evicts_counts_late_rows_and_survives_restart(spark, tmpdir_fresh):
    """Files arrive one by one in time order, with a stop in between; then a file far behind the watermark arrives: its rows are late,
    counted row by row, and change nothing. The winner is the listing's although the better row arrives second."""
    from quarry.streaming.first_seen import late_rows, open_sessions, read_first_seen_bounded, start_first_seen_bounded

    root, cols = tmpdir_fresh, "id string, day int, page bigint"

    def land(rows):
        df = spark.createDataFrame(rows, cols).withColumn("at", F.timestamp_seconds(F.col("day") * 86400))
        df.coalesce(1).write.mode("append").parquet(f"{root}/in")
        return df.schema

    def go(schema):
        q = start_first_seen_bounded(file_stream(spark, f"{root}/in", schema, 1), "id", "at", ["page"], ["day"], "1 day", "3 days",
                                     f"{root}/sink", f"{root}/ckpt")
        q.awaitTermination()

    schema = land([("a", 100, 9), ("b", 100, 1), ("b", 101, 1), (None, 100, 1)])
    schema = land([("a", 102, 2), ("c", 102, 5)])
    go(schema)
    assert open_sessions(spark, f"{root}/ckpt", "id").count() == 3
    land([(f"x{i}", 120, i) for i in range(5)])
    go(schema)  # restart: the watermark passes day 119, so a, b and c leave the state
    assert {r.id for r in open_sessions(spark, f"{root}/ckpt", "id").collect()} == {f"x{i}" for i in range(5)}
    assert spark.read.parquet(f"{root}/sink").count() == 3
    land([("a", 121, 1), ("late", 90, 0), ("late", 90, 0), ("a", 91, 0)])
    go(schema)
    go(schema)  # nothing new
    got = {tuple(r) for r in read_first_seen_bounded(spark, f"{root}/sink", f"{root}/ckpt", "id").collect()}
    assert got == {("a", 1, 121), ("b", 1, 100), ("c", 5, 102)} | {(f"x{i}", i, 120) for i in range(5)}
    late = late_rows(spark.read.parquet(f"{root}/in"), f"{root}/sink", f"{root}/ckpt", "id", "at")
    assert {tuple(r) for r in late.collect()} == {("late", 2), ("a", 1)}
