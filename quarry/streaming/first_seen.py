"""ST-1: first-seen dedup over arriving listing pages, with Structured Streaming.

Exact first-seen per id, independent of arrival order and of how rows fall into micro-batches: a
streaming aggregation keeps, per id, the minimum of struct(listing order..., payload...) in the
state store (the reference's in-memory "seen" set, made durable by the checkpoint). Updated ids of
each micro-batch are appended, with the batch id, to a changelog table in shared storage; readers
take the latest entry per id (a partial+final aggregate), so a retried batch that appends again
changes nothing. Gates run after the dedup (ledger Q5), on read.

State lives in RocksDB (set where the query starts), one entry per id outside the heap. ``compact_changelog`` rewrites
the changelog to one entry per id, so reads follow the number of ids and not of micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_first_seen(stream: DataFrame, key: str, order_cols: list[str], payload_cols: list[str],
                     changelog: str, checkpoint: str, available_now: bool = True):
    stream.sparkSession.conf.set(STATE_PROVIDER, ROCKSDB)
    best = stream.groupBy(key).agg(F.min(F.struct(*order_cols, *payload_cols)).alias("best"))

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(changelog)

    w = (best.writeStream.outputMode("update").foreachBatch(append)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_first_seen(spark: SparkSession, changelog: str, key: str) -> DataFrame:
    """Current first-seen row per id: the entry of the latest batch that updated it."""
    log = spark.read.parquet(changelog)
    latest = log.groupBy(key).agg(F.max_by("best", "batch_id").alias("best"))
    return latest.select(key, "best.*")


def compact_changelog(spark: SparkSession, changelog: str, key: str, compacted: str) -> str:
    """Write the changelog's latest entry per id to ``compacted``, a changelog of its own to continue with (the old folder is
    left to the caller: a reader may still be on it)."""
    latest = spark.read.parquet(changelog).groupBy(key).agg(F.max("batch_id").alias("batch_id"), F.max_by("best", "batch_id").alias("best"))
    latest.select(key, "best", "batch_id").write.mode("overwrite").parquet(compacted)
    return compacted


def land_files(df: DataFrame, path: str, order_col: str, rows_per_file: int = 250_000, mode: str = "overwrite") -> str:
    """Land a table as Parquet files of consecutive ranges of ``order_col``; the number of files follows the rows."""
    n = max(2, -(-df.count() // rows_per_file))
    df.repartitionByRange(n, order_col).write.mode(mode).parquet(path)
    return path


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_first_seen_watermarked(stream: DataFrame, key: str, event_time: str, delay: str, sink: str,
                                 checkpoint: str, available_now: bool = True):
    """Bounded-state variant: ``dropDuplicatesWithinWatermark`` keeps the first *arriving* row per id
    while the id is within ``delay`` of the watermark, and appends it to a Parquet sink. State is
    evicted as the watermark passes, so memory stays bounded on an endless stream; the price is that
    the winner inside one micro-batch follows arrival order, not listing order (use
    ``start_first_seen`` when the listing-order winner must be exact)."""
    deduped = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    w = (deduped.writeStream.format("parquet").outputMode("append")
         .option("path", sink).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# ---- bounded state, exact winner -----------------------------------------------------------------
def start_first_seen_bounded(stream: DataFrame, key: str, event_time: str, order_cols: list[str], payload_cols: list[str],
                             delay: str, horizon: str, sink: str, checkpoint: str, available_now: bool = True):
    """First-seen with bounded state whose winner is the listing's, not the arrival's.

    An id's rows form a session: rows less than ``horizon`` apart in event time. The state holds the minimum of (order, payload)
    and the number of rows of every open session; when the watermark (``delay`` behind the newest row) has passed its end, the
    session is written to ``sink`` once and leaves the state. So the state holds the ids of the last ``horizon + delay`` only, and
    an id that comes again later opens a session of its own: ``read_first_seen_bounded`` merges an id's sessions by the same
    minimum, so the winner is exact over all rows that were not late. Rows behind the watermark that reach no open session are dropped
    by Spark; ``late_rows`` counts them. Everything runs in the JVM; rows with a null id or time take no part."""
    stream.sparkSession.conf.set(STATE_PROVIDER, ROCKSDB)
    known = stream.where(F.col(key).isNotNull() & F.col(event_time).isNotNull())
    best = F.struct(*order_cols, *payload_cols)
    sessions = (known.withWatermark(event_time, delay).groupBy(F.session_window(event_time, horizon).alias("session"), key)
                .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n_rows")))
    w = (sessions.select(key, "session", "best", "n_rows").writeStream.format("parquet").outputMode("append")
         .option("path", sink).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def open_sessions(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, best, n_rows) of the sessions still in the state, as of the last committed micro-batch (the state store as a table)."""
    state = spark.read.format("statestore").load(checkpoint)
    names = state.select("value.*").columns
    best, n = names[-2], names[-1]
    return state.select(F.col(f"key.{key}").alias(key), F.col(f"value.{best}").alias("best"), F.col(f"value.{n}").alias("n_rows"))


def sessions_so_far(spark: SparkSession, sink: str, checkpoint: str, key: str) -> DataFrame:
    """Written and open sessions together: each row that was not late is in exactly one of them. (Read it between micro-batches or
    after the query has stopped: sink and state are then of the same batch.)"""
    still = open_sessions(spark, checkpoint, key)
    return spark.read.schema(still.schema).parquet(sink).union(still)


def read_first_seen_bounded(spark: SparkSession, sink: str, checkpoint: str, key: str) -> DataFrame:
    """The first-seen row per id over all sessions (partial+final minimum)."""
    return sessions_so_far(spark, sink, checkpoint, key).groupBy(key).agg(F.min("best").alias("best")).select(key, "best.*")


def late_rows(landed: DataFrame, sink: str, checkpoint: str, key: str, event_time: str) -> DataFrame:
    """(key, n_late) of every id that lost rows to the watermark: rows landed less rows held by sessions. It reads key and time of
    the landed files only, and needs nothing that a restart would lose."""
    came = landed.where(F.col(key).isNotNull() & F.col(event_time).isNotNull()).select(key, F.lit(1).cast("bigint").alias("n"))
    held = sessions_so_far(landed.sparkSession, sink, checkpoint, key).select(key, (-F.col("n_rows")).alias("n"))
    return came.union(held).groupBy(key).agg(F.sum("n").alias("n_late")).where("n_late <> 0")
