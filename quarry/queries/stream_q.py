"""Registered streaming queries: listing rows from ``events`` landed as files, consumed by
Structured Streaming (Trigger.AvailableNow, as many files per micro-batch as there are cores), results read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import filters as FL
from quarry.plans import curate as CU
from quarry.queries.curate_q import LISTING, first_seen_sql
from quarry.queries.registry import Registry
from quarry.session import scratch_path
from quarry.sources.tables import table
from quarry.streaming.first_seen import (
    file_stream, land_files, late_rows, read_first_seen, read_first_seen_bounded, start_first_seen, start_first_seen_bounded)
from quarry.streaming.incremental import start_append

register = Registry()
QUERIES, ORACLE = register.queries, register.oracle


GATES = f"num_comments >= 1 AND NOT (view = '{CU.GATED_VIEW}' AND score < 3)"


def _landed(spark, sf):
    ev = table(spark, sf, "events")
    path = land_files(ev, scratch_path(spark, "events-landed"), "event_id")
    return file_stream(spark, path, ev.schema, files_per_trigger=spark.sparkContext.defaultParallelism)


# ST-1 --------------------------------------------------------------------------------------------
@register("stream_first_seen", f"SELECT id, view, page, pos, score FROM ({first_seen_sql(LISTING)}) WHERE {GATES}")
def stream_first_seen(spark, sf):
    listing = CU.listing_from_events(_landed(spark, sf))
    base = scratch_path(spark, "first-seen")
    q = start_first_seen(listing, "id", ["view_rank", "page", "pos"], ["view", "score", "num_comments", "thread_id"],
                         f"{base}/changelog", f"{base}/checkpoint")
    q.awaitTermination()
    rows = read_first_seen(spark, f"{base}/changelog", "id")
    gated = FL.score_by_view(FL.engagement(rows), CU.GATED_VIEW, 3)
    return gated.select("id", "view", "page", "pos", "score")


# ST-1 with bounded state --------------------------------------------------------------------------
WAVE_DAYS = 5


@register("stream_first_seen_bounded", f"""
SELECT f.id, f.view, f.page, f.pos, f.score, CAST(0 AS BIGINT) AS n_late FROM ({first_seen_sql(LISTING)}) f""")
def stream_first_seen_bounded(spark, sf):
    """Listing rows arrive in waves of WAVE_DAYS; the query stops after half of them and restarts on its checkpoint. With a delay of
    more than a wave no row is late; ids that come back after the horizon open a new session."""
    ev = table(spark, sf, "events")
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (86400 * WAVE_DAYS))
    first, last = ev.select(F.min(day), F.max(day)).first()
    base = scratch_path(spark, "first-seen-bounded")

    def arrivals(df):
        return CU.listing_from_events(df).withColumn("seen_at", F.timestamp_seconds("created_utc"))

    half = (first + last) // 2 if first is not None else 0
    for waves in (range(first or 0, half + 1), range(half + 1, (last or 0) + 1)):
        for w in waves:
            land_files(ev.where(day == w), f"{base}/in", "event_id", mode="append")
        stream = file_stream(spark, f"{base}/in", ev.schema, files_per_trigger=spark.sparkContext.defaultParallelism)
        start_first_seen_bounded(arrivals(stream), "id", "seen_at", ["view_rank", "page", "pos"], ["view", "score"],
                                 f"{WAVE_DAYS + 1} days", "3 days", f"{base}/sink", f"{base}/checkpoint").awaitTermination()
    rows = read_first_seen_bounded(spark, f"{base}/sink", f"{base}/checkpoint", "id")
    late = late_rows(arrivals(spark.read.schema(ev.schema).parquet(f"{base}/in")), f"{base}/sink", f"{base}/checkpoint", "id", "seen_at")
    return rows.join(late, "id", "left").select("id", "view", "page", "pos", "score", F.coalesce("n_late", F.lit(0).cast("bigint")).alias("n_late"))


# ST-2 --------------------------------------------------------------------------------------------
@register("stream_incremental_save", f"SELECT id, view, page, pos FROM ({LISTING}) WHERE {GATES}")
def stream_incremental_save(spark, sf):
    """Gated listing rows saved micro-batch by micro-batch; the query is then restarted on the same
    checkpoint (as after an interruption) and must add nothing."""
    listing = CU.listing_from_events(_landed(spark, sf))
    accepted = FL.score_by_view(FL.engagement(listing), CU.GATED_VIEW, 3).select("id", "view", "page", "pos")
    base = scratch_path(spark, "incremental")
    for _ in range(2):  # first run, then a restart from the checkpoint
        start_append(accepted, f"{base}/sink", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/sink")
