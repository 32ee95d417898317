"""O-2 at scale: the first ``target`` rows in priority order without reading what lies behind them.

Rows are landed once as Parquet, one folder per (rank, block of consecutive pages). Counts per folder and their running sum say in
which folder the target is reached. Folders before it are taken whole, the one it falls in is ordered and cut, and no file of a
later folder is opened (partition pruning). The counts are one small row per folder and are all that one task sees at once; only
the border, a single row, reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.operators.ordering import first_n

PAGES_PER_BLOCK = 1000
FOLDERS = (StructField("_rank", LongType()), StructField("_block", LongType()))


def land_by_priority(df: DataFrame, path: str, rank: str = "view_rank", page: str = "page", pages_per_block: int = PAGES_PER_BLOCK,
                     rows_per_file: int = 1_000_000) -> str:
    """Write ``df`` under ``path`` in folders ``_rank=<rank>/_block=<page div pages_per_block>``. Rows are dealt by range of (rank, page), so a view
    that holds most rows is spread over tasks by its pages. A null rank or page comes first, as in an ascending sort."""
    n = max(1, -(-df.count() // rows_per_file))
    placed = df.withColumns({"_rank": F.coalesce(F.col(rank).cast("bigint"), F.lit(-2**63)),
                             "_block": F.coalesce(F.floor(F.col(page) / pages_per_block).cast("bigint"), F.lit(-2**63))})
    placed.repartitionByRange(n, "_rank", "_block", page).write.mode("overwrite").partitionBy("_rank", "_block").parquet(path)
    return path


def read_landed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table ``land_by_priority`` wrote from rows of ``schema``, with its folder columns (also when it is empty)."""
    return spark.read.schema(StructType([*schema.fields, *FOLDERS])).parquet(path)


def border(counts: DataFrame, target: int) -> tuple[int, int, int] | None:
    """(rank, block, rows wanted of it) of the folder in which ``target`` is reached; None if all folders together hold fewer.
    ``counts`` has one row per folder: _rank, _block, n."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("_rank", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = counts.withColumn("_before", before).where((F.col("_before") < target) & (F.col("_before") + F.col("n") >= target))
    row = reached.select("_rank", "_block", (F.lit(target) - F.col("_before")).alias("want")).first()
    return tuple(row) if row else None


def first_of_landed(landed: DataFrame, counts: DataFrame, target: int, order: list[str]) -> DataFrame:
    """The first ``target`` rows by (rank, block, ``order``) of a landed table (``order`` goes on from rank and page); all rows if there
    are fewer, none if ``target`` is 0 or less. Rows come unsorted."""
    if target <= 0:
        return landed.limit(0).drop("_rank", "_block")
    cut = border(counts, target)
    if cut is None:
        return landed.drop("_rank", "_block")
    rank, block, want = cut
    earlier = landed.where((F.col("_rank") < rank) | ((F.col("_rank") == rank) & (F.col("_block") < block)))
    there = landed.where((F.col("_rank") == rank) & (F.col("_block") == block))
    return earlier.unionByName(first_n(there, want, order)).drop("_rank", "_block")
