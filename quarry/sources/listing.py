"""SRC-7: saved listing pages (``data.children[].data``) <-> one row per post with view, page, pos.

A page document holds at most one API page (100 posts), so building one is a bounded per-group
collect; reading flattens with ``posexplode`` (pos = position on the page) and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST_FIELDS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("thread_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("created_utc", T.DoubleType()),
])

PAGE_SCHEMA = T.StructType([
    T.StructField("view", T.StringType()),
    T.StructField("view_rank", T.IntegerType()),
    T.StructField("page", T.LongType()),
    T.StructField("data", T.StructType([
        T.StructField("after", T.StringType()),
        T.StructField("children", T.ArrayType(T.StructType([T.StructField("data", POST_FIELDS)]))),
    ])),
])


def write_listing_pages(listing: DataFrame, path: str) -> str:
    """Land listing rows as page documents (JSON lines, one page per line)."""
    present = [f.name for f in POST_FIELDS.fields if f.name in listing.columns]
    post = F.struct(*[F.col(c) if c in present else F.lit(None).cast(POST_FIELDS[c].dataType).alias(c)
                      for c in POST_FIELDS.fieldNames()])
    pages = (listing.groupBy("view", "view_rank", "page")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), post.alias("data")))).alias("kids")))
    doc = pages.select(
        "view", "view_rank", "page",
        F.struct(F.element_at("kids", -1)["data"]["id"].alias("after"),
                 F.transform("kids", lambda k: F.struct(k["data"].alias("data"))).alias("children")).alias("data"))
    doc.write.mode("overwrite").json(path)
    return path


def read_listing_pages(spark: SparkSession, path: str) -> DataFrame:
    """Flatten landed pages to E1 rows; ``pos`` is the 0-based position on the page."""
    pages = spark.read.schema(PAGE_SCHEMA).json(path)
    flat = pages.select("view", "view_rank", "page", F.posexplode("data.children").alias("pos", "child"))
    return flat.select("view", "view_rank", "page", F.col("pos").cast("bigint").alias("pos"), "child.data.*")
