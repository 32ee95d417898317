"""J-4 for very large grids: done cells as bitmaps, missing cells by their difference.

A grid is ``models`` x cells 1 to n. Done cells of a model are kept as one bitmap per bucket of BITS cells, at most 4 KB each; the
table of bitmaps is built by a partial+final aggregate, merges by OR (new results are added without the old ones) and is the
only thing compared: a full bucket is passed over by its bit count, and only the cells of the others are unpacked. The grid itself, models x
cells, is never made: models are exploded to buckets, 1 / BITS of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 32768  # of a Spark bitmap


def cell_bitmaps(results: DataFrame, model: str, cell: str) -> DataFrame:
    """(model, bucket, bits) of the done cells; repeated results set one bit. Cells below 1 and nulls are no cells."""
    done = results.where(F.col(model).isNotNull() & (F.col(cell) >= 1))
    at = F.col(cell).cast("bigint")
    return done.groupBy(model, F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def merge_bitmaps(kept: DataFrame, new: DataFrame, model: str) -> DataFrame:
    """Kept and new bitmaps as one table: adding the same results again changes nothing."""
    return kept.unionByName(new).groupBy(model, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _buckets(models: DataFrame, bitmaps: DataFrame, model: str, n_cells: int) -> DataFrame:
    n = -(-n_cells // BITS)
    if n_cells < 1:
        wanted = models.select(model).limit(0).withColumn("bucket", F.lit(1).cast("bigint"))
    else:
        wanted = models.select(model).distinct().select(model, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))).alias("bucket"))
    size = F.least(F.lit(BITS).cast("bigint"), F.lit(n_cells) - (F.col("bucket") - 1) * BITS)
    # a cell beyond the grid sets a bit beyond the last bucket's size, which is neither counted nor unpacked
    return wanted.join(bitmaps, [model, "bucket"], "left").withColumn("_size", size.cast("int"))


def missing_cells(models: DataFrame, bitmaps: DataFrame, model: str, n_cells: int, cell: str = "cell") -> DataFrame:
    """(model, cell) of every cell without a result, for the models given."""
    b = _buckets(models, bitmaps, model, n_cells)
    b = b.where(F.col("bits").isNull() | (F.bitmap_count("bits") < F.col("_size")) | (F.col("_size") < BITS))
    open_at = F.expr("filter(sequence(0, _size - 1), p -> bits IS NULL OR "
                     "getbit(cast(conv(hex(substring(bits, p div 8 + 1, 1)), 16, 10) AS int), cast(p % 8 AS int)) = 0)")
    return b.select(model, "bucket", F.explode(open_at).alias("_p")).select(
        model, ((F.col("bucket") - 1) * BITS + F.col("_p") + 1).alias(cell))


def coverage_counts(models: DataFrame, bitmaps: DataFrame, model: str, n_cells: int) -> DataFrame:
    """(model, n_done, n_missing) without unpacking whole buckets; the last bucket counts its cells inside the grid."""
    b = _buckets(models, bitmaps, model, n_cells)
    inside = F.expr("cast(size(filter(sequence(0, _size - 1), p -> "
                    "getbit(cast(conv(hex(substring(bits, p div 8 + 1, 1)), 16, 10) AS int), cast(p % 8 AS int)) = 1)) AS bigint)")
    done = F.when(F.col("bits").isNull(), F.lit(0)).when(F.col("_size") == BITS, F.bitmap_count("bits")).otherwise(inside)
    return b.groupBy(model).agg(F.sum(done).alias("n_done"), F.sum(F.col("_size") - done).alias("n_missing"))
