"""Session construction and shared-storage helpers.

Jobs never create their own session: they take the caller's. ``local_session`` exists for tests, the
bench and the oracle checker only. ``scratch_path`` resolves a folder under the cluster's shared
``spark.checkpoint.dir`` so that anything written mid-job survives the loss of an executor.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for correctness (UTC dates, ANSI mode) or for plan quality (AQE, skew split).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quarry",
                  extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**BASE_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
        .config("spark.quarry.fixtures.spread", str(os.cpu_count() if cores == "*" else cores))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_session_defaults(spark: SparkSession) -> None:
    """Dates and run stamps are defined in UTC (ledger Q22): pin the session time zone."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a private one only when the session names none (tests)."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if re.match(r"file:|/", conf) and not spark.sparkContext.master.startswith("local"):
            warnings.warn(f"spark.checkpoint.dir is {conf}: it must be a mount that every executor sees", stacklevel=2)
        spark.sparkContext.setCheckpointDir(conf)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    # A private folder only for local runs (tests, bench); on a cluster, stage tables and streaming
    # state must live on shared storage that outlives any executor.
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store) for this cluster session")
    local = tempfile.mkdtemp(prefix="quarry-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir for staging files."""
    base = ensure_checkpoint_dir(spark)
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete what this application's jobs staged. Call it when no result frame is needed any more: the frames that jobs
    return may still read their stage tables."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/scratch")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage at a stage that several consumers read: write it once as Parquet under the shared
    checkpoint folder and return the read-back frame. Lost executors then recompute from this table,
    not from the raw input, and the consumers share one computation instead of one each. ``options`` go to the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)
