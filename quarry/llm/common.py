"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.session import materialize

__all__ = ["materialize", "read_table", "row_key", "ship_package", "text_key", "with_fields"]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, so that pandas and Arrow
    functions can import it there wherever the driver was started from."""
    sc: SparkContext = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-pkg-"), "quarry_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._quarry_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, by Spark's own reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """Add a unique row number. It is only stable once written, so callers materialize the frame."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_key(text="text"):
    """A 128-bit content key of a text (null counts as empty): rows that share it hold equal texts."""
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"))


def with_fields(df: DataFrame, **fields: str) -> StructType:
    """The schema of ``df`` followed by more fields (a copy: ``DataFrame.schema`` is shared)."""
    more = [StructType.fromDDL(f"`{name}` {kind}").fields[0] for name, kind in fields.items()]
    return StructType([*df.schema.fields, *more])
