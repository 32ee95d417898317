"""Driver tables (Parquet) by name. Column pruning and filters reach the scan because callers select
and filter declaratively on the returned frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: Test and bench sessions may set this to spread the single-row-group fixtures over the cores; unset elsewhere.
SPREAD_CONF = "spark.quarry.fixtures.spread"
TEXT_TABLES = frozenset({"documents", "conversations", "pages"})


def table(spark: SparkSession, sf_dir: str, name: str, balance: bool = True) -> DataFrame:
    """Read a driver table. The scan's parallelism is Spark's own (``spark.sql.files.maxPartitionBytes``). Only where
    the session names ``spark.quarry.fixtures.spread`` are text tables dealt round-robin to that many tasks
    (``balance=False`` opts out), because the fixtures are single row groups, which no setting can split."""
    if name not in TABLE_NAMES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = spark.conf.get(SPREAD_CONF, None)
    return df.repartition(int(spread)) if spread and balance and name in TEXT_TABLES else df
