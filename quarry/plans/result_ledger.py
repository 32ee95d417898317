"""SRC-4 / A-9 / W-3 kept up to date: a store that reads only result files it has not read yet.

A store is a folder of three Parquet tables, each cut by load number:

* ``rows``   unified metric rows (E16) of the files read by a load,
* ``state``  per load, what its still valid rows say per (task, label): the latest run and the count and sum of accuracies. Partial
  results that merge by maximum and sum, so a report over all loads reads one small row per load and label, not the files,
* ``ledger`` path, time and length of each file the load has read, or has found gone (length null). Written last: a load that died
  earlier left no ledger, so the next one takes the same number and overwrites its rows.

A file's newest ledger entry rules. A file rewritten since has another time or length: it is read again and its old rows no longer
count; the states of loads that held them are written anew. Loads are single-writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import results as R
from quarry.session import materialize

LEDGER = "load bigint, path string, modified timestamp, length bigint"
TASK_LABEL = ["task", "label"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """The newest entry per path (of files that are there): load, path, modified, length."""
    if not _exists(spark, f"{store}/ledger"):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(f"{store}/ledger")
    return rows.groupBy("path").agg(F.max_by(F.struct("load", "modified", "length"), "load").alias("e")).select("e.load", "path", "e.modified", "e.length")


def listing(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, modified, length of every file under ``root``; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
            .select("path", F.col("modificationTime").alias("modified"), "length"))


def _state(rows: DataFrame) -> DataFrame:
    latest = F.struct("run_ts", "file_path", "family", "config", "acc", "acc_stderr", "acc_norm", "acc_norm_stderr")
    return rows.groupBy("load", *TASK_LABEL).agg(F.max(latest).alias("latest"), F.count(F.lit(1)).alias("n_runs"),
                                                 F.count("acc").alias("n_acc"), F.sum("acc").alias("sum_acc"))


def _write_load(df: DataFrame, path: str, load: int) -> None:
    df.drop("load").write.mode("overwrite").parquet(f"{path}/load={load}")


def load_new(spark: SparkSession, root: str, store: str, read=R.read_harness_files, glob: str = "part-*") -> int:
    """Take in what is new, rewritten or gone under ``root``; returns the number of files read (0: nothing changed, nothing written).

    ``read(spark, paths)`` gives the rows of ``R.read_harness_folders`` for the given paths. Paths of new files pass
    through the driver, as every file listing of Spark does; contents do not."""
    known = ledger(spark, store)
    found = listing(spark, root, glob)
    k = known.select("path", F.col("modified").alias("_m"), F.col("length").alias("_l"), F.col("load").alias("_load"))
    both = materialize(found.join(k, "path", "full_outer"), "ledger-diff")
    there = F.col("length").isNotNull()
    fresh = both.where(there & ~(F.col("modified").eqNullSafe(F.col("_m")) & F.col("length").eqNullSafe(F.col("_l"))))
    gone = both.where(~there & F.col("_l").isNotNull())
    entries = fresh.select("path", "modified", "length").unionByName(gone.select("path", F.lit(None).cast("timestamp").alias("modified"),
                                                                                 F.lit(None).cast("bigint").alias("length")))
    if entries.isEmpty():
        return 0
    load = 1 + (spark.read.schema(LEDGER).parquet(f"{store}/ledger").agg(F.max("load")).first()[0] if _exists(spark, f"{store}/ledger") else 0)
    paths = [r.path for r in fresh.select("path").toLocalIterator()]
    # also when files are only gone: what a load of this number left behind when it died must go
    new = materialize(R.unified_metrics(read(spark, paths)), "ledger-rows") if paths else spark.read.parquet(f"{store}/rows").drop("load").limit(0)
    _write_load(new, f"{store}/rows", load)
    _write_load(_state(new.withColumn("load", F.lit(load).cast("bigint"))), f"{store}/state", load)
    replaced = both.where(F.col("_load").isNotNull() & (~there | ~F.col("modified").eqNullSafe(F.col("_m")) | ~F.col("length").eqNullSafe(F.col("_l"))))
    touched = [r[0] for r in replaced.where("_l IS NOT NULL").select("_load").distinct().collect()]  # at most one per earlier load
    for t in touched:
        old = spark.read.parquet(f"{store}/rows/load={t}").withColumn("load", F.lit(t).cast("bigint"))
        still = both.where(F.col("_load") == t).join(replaced.select("path"), "path", "left_anti").select(_plain("path").alias("_p")).distinct()
        valid = old.join(still, _plain("file_path") == F.col("_p"), "left_semi")
        _write_load(materialize(_state(valid), "ledger-state"), f"{store}/state", t)
    _write_load(entries, f"{store}/ledger", load)
    return len(paths)


def _plain(path: str) -> Column:
    """A path without scheme, decoded: listings and row metadata spell the same file differently."""
    return F.url_decode(F.replace(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"), F.lit("+"), F.lit("%2B")))


def current_rows(spark: SparkSession, store: str) -> DataFrame:
    """Unified metric rows of every file's newest version."""
    rows = spark.read.parquet(f"{store}/rows")
    now = ledger(spark, store).where("length IS NOT NULL").select(F.col("load").alias("_load"), _plain("path").alias("_p"))
    return rows.join(now, (rows["load"] == F.col("_load")) & (_plain("file_path") == F.col("_p")), "left_semi").drop("load")


def current_labels(spark: SparkSession, store: str) -> DataFrame:
    """W-3 and the mean accuracy per (task, label), merged from the loads' states: latest run's columns, n_runs, mean_acc (null
    when no run has one)."""
    done = spark.read.schema(LEDGER).parquet(f"{store}/ledger").agg(F.max("load")).first()[0]  # not what an unfinished load has written
    merged = spark.read.parquet(f"{store}/state").where(F.col("load") <= done).groupBy(*TASK_LABEL).agg(
        F.max("latest").alias("l"), F.sum("n_runs").alias("n_runs"), (F.sum("sum_acc") / F.nullif(F.sum("n_acc"), F.lit(0))).alias("mean_acc"))
    return merged.select(*TASK_LABEL, "l.*", "n_runs", "mean_acc")
