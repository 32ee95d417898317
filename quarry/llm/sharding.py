"""Sharding by sampled splitters (native: DataFrame functions only).

Records are range-partitioned by (key, row number). A size-weighted sample of keys gives quantile
boundaries; exact rows and bytes per range follow from one aggregation, ranges that turn out overfull
are subdivided by sampling again inside them, and prefix sums over the (bounded) range table give every
record its exact global byte position, so shard boundaries are exact quantiles of the bytes and not
estimates. A record larger than 1/128 of a shard could still unbalance a boundary; there are fewer than
128 x n_shards of those by arithmetic, and they are dealt first, largest to the least loaded shard. The
ranges of the rest then fill what each shard has left.

Defined cases: null key sorts first; null text has no bytes; equal keys and repeated rows are told apart
by the row number, so a key that holds a third of all rows spreads over many ranges; an empty table gives
an empty result; a single record larger than a shard's share sits alone with whatever still fits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, row_key

MAX_RANGES = 16_384      # bound of the range table, which is broadcast and scanned by one window
BIG_FRACTION = 128       # a record above 1/128 of a shard is dealt by itself


def _splitters(rows: DataFrame, n_ranges: int, oversample: int) -> DataFrame:
    """One row: the sorted array of at most n_ranges - 1 boundary keys. A size-weighted sample without
    replacement is the ``m`` smallest values of -ln(u) / size, with u a hash of the row's identity."""
    m = n_ranges * oversample
    u = (F.shiftrightunsigned(F.xxhash64("_key", "_row"), 11) + F.lit(1)) / F.lit(float(2 ** 53 + 1))
    drawn = (rows.select("_key", "_row", (-F.log(u) / F.greatest(F.col("size"), F.lit(1))).alias("_p"))
             .orderBy("_p", "_key", "_row").limit(m))
    keys = drawn.agg(F.sort_array(F.collect_list(F.struct("_key", "_row"))).alias("_k"))
    step = F.size("_k") / F.lit(n_ranges)
    picked = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.lit(max(n_ranges - 1, 1))),
        lambda i: F.get("_k", F.least(F.floor(i * step).cast("int"), F.size("_k") - 1))))
    return keys.select(F.sort_array(F.filter(picked, lambda x: x.isNotNull())).alias("_s"))


def _with_range(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """Number of splitters at or below each row's (key, row), by binary search in the sorted array."""
    joined = (rows.drop("_range").withColumn("_one", F.lit(1))
              .join(F.broadcast(splitters.withColumn("_one", F.lit(1))), "_one").drop("_one"))
    me = F.struct("_key", "_row")
    steps = math.ceil(math.log2(4 * MAX_RANGES))

    def halve(at, s):
        nxt = at + s
        inside = (nxt <= F.size("_s")) & (F.get("_s", nxt - 1) <= me)
        return F.when(inside, nxt).otherwise(at)

    powers = F.array(*[F.lit(2 ** k) for k in range(steps, -1, -1)])
    return joined.withColumn("_range", F.aggregate(powers, F.lit(0), halve)).drop("_s")


def _range_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_b"))


def split_ranges(rows: DataFrame, n_ranges: int, oversample: int = 16, rounds: int = 3) -> DataFrame:
    """Rows with ``_range``; ranges above four times the mean rows or bytes are sampled again and split."""
    cut = _splitters(rows, n_ranges, oversample)
    ranged = materialize(_with_range(rows, cut), "shard-ranges")
    for _ in range(rounds):
        stats = _range_stats(ranged)
        mean = stats.agg(F.avg("_n").alias("n"), F.avg("_b").alias("b"), F.count(F.lit(1)).alias("k")).first()
        if not mean.k or mean.k >= MAX_RANGES:
            break
        over = stats.filter((F.col("_n") > 4 * mean.n + 1000) | (F.col("_b") > 4 * mean.b + 1_000_000))
        found = over.agg(F.count(F.lit(1)).alias("k"), F.sum("_n").alias("n"), F.sum("_b").alias("b")).first()
        if not found.k:
            break
        extra = int(min(MAX_RANGES - mean.k, math.ceil(max(found.n / max(mean.n, 1), found.b / max(mean.b, 1)))))
        inside = ranged.join(F.broadcast(over.select("_range")), "_range", "left_semi")
        more = _splitters(inside, max(extra, 2), oversample)
        cut = cut.union(more).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_s")))).alias("_s"))
        ranged = materialize(_with_range(ranged, cut), "shard-ranges")
    return ranged


def _deal_big(big: DataFrame, n_shards: int) -> DataFrame:
    """Largest first, each to the least loaded shard: a fold over fewer than 128 x n_shards records."""
    listed = big.agg(F.sort_array(F.collect_list(F.struct(F.col("size"), F.col("_row"))), asc=False).alias("_l"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("load"),
                     F.expr("cast(array() as array<struct<_row:bigint,shard:int,size:bigint>>)").alias("out"))

    def put(state, x):
        load = state["load"]
        to = F.array_position(load, F.array_min(load)).cast("int")
        return F.struct(
            F.transform(load, lambda v, i: F.when(i == to - 1, v + x["size"]).otherwise(v)).alias("load"),
            F.concat(state["out"], F.array(F.struct(x["_row"].alias("_row"), (to - 1).alias("shard"),
                                                    x["size"].alias("size")))).alias("out"))

    dealt = listed.select(F.explode(F.aggregate("_l", start, put)["out"]).alias("d")).select("d.*")
    slot = Window.partitionBy("shard").orderBy(F.col("size").desc(), "_row")
    return dealt.select("_row", "shard", (F.row_number().over(slot) - 1).cast("long").alias("slot"), "size")


def shard_by_bytes(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text",
                   overhead: int = 16, rows_per_range: int = 1_000_000, ranges_per_shard: int = 8) -> DataFrame:
    """Every record with ``size``, ``text_crc32``, ``shard`` (0 .. n_shards - 1, sizes near equal) and
    ``slot`` (gapless from 0 in its shard). Texts stay where they are: only keys and sizes move."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = materialize(row_key(docs.select(
        F.col(key).alias("_key"), (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"))), "shard-rows")
    total = narrow.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    out = ["_key", "size", "text_crc32", "shard", "slot"]
    if not total.n:
        empty = narrow.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
        return empty.select(*out).withColumnRenamed("_key", key)
    is_big = F.col("size") * F.lit(n_shards * BIG_FRACTION) > F.lit(total.b)
    dealt = materialize(_deal_big(narrow.filter(is_big), n_shards), "shard-big")
    big = narrow.filter(is_big).join(F.broadcast(dealt.drop("size")), "_row").select(*out)

    # what each shard has left, as cumulative bytes of the other records (n_shards rows)
    loads = narrow.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(
        dealt.groupBy("shard").agg(F.sum("size").alias("_load"), F.count(F.lit(1)).alias("_held")), "shard", "left")
    room = loads.select("shard", F.coalesce("_held", F.lit(0)).cast("long").alias("_held"),
                        F.greatest(F.lit(total.b / n_shards) - F.coalesce("_load", F.lit(0)), F.lit(0.0)).alias("_room"))
    edges = room.select("shard", "_held", (F.sum("_room").over(Window.orderBy("shard")) /
                                           F.sum("_room").over(Window.partitionBy())).alias("_edge"))
    edges = materialize(edges, "shard-edges")
    edge_row = edges.agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "_edge"))),
                                     lambda e: e["_edge"]).alias("_e"))

    n_ranges = int(min(MAX_RANGES, max(n_shards * ranges_per_shard, math.ceil(total.n / rows_per_range))))
    ranged = split_ranges(narrow.filter(~is_big), n_ranges)
    every = Window.orderBy("_range")
    base = _range_stats(ranged).select(
        "_range", (F.sum("_n").over(every) - F.col("_n")).alias("_n0"), (F.sum("_b").over(every) - F.col("_b")).alias("_b0"),
        F.sum("_b").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_range").orderBy("_key", "_row")
    placed = (ranged.withColumns({"_at": F.row_number().over(inside),
                                  "_cum": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
              .join(F.broadcast(base), "_range")
              .withColumns({"_at": F.col("_n0") + F.col("_at") - 1, "_one": F.lit(1),
                            "_mid": (F.col("_b0") + F.col("_cum") - F.col("size") / 2) / F.col("_all")})
              .join(F.broadcast(edge_row.withColumn("_one", F.lit(1))), "_one")
              .withColumn("shard", F.least(F.size(F.filter("_e", lambda e: e <= F.col("_mid"))),
                                           F.lit(n_shards - 1)).cast("int"))
              .select("_key", "size", "text_crc32", "shard", "_at"))
    placed = materialize(placed, "shard-placed")
    first = (placed.groupBy("shard").agg(F.min("_at").alias("_first"))
             .join(edges.select("shard", "_held"), "shard"))
    small = (placed.join(F.broadcast(first), "shard")
             .withColumn("slot", F.col("_at") - F.col("_first") + F.col("_held")).select(*out))
    return big.unionByName(small).withColumnRenamed("_key", key)
