"""Skew-safe operators give exactly the plain results on skewed input."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import windows as W
from quarry.operators.joins import hot_split_join


def test_two_level_cap_is_exact_on_a_hot_view(spark):
    n = 50_000
    df = (spark.range(n).repartition(37)
          .select(F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("v"), (F.col("id") % 7).cast("string"))).alias("view"),
                  (F.xxhash64("id") % 1000).alias("page"), F.col("id").alias("pos")))
    two = W.cap_per_view(df, cap=300, buckets=8)
    one = W.cap_per_view(df, cap=300, buckets=1)
    a = sorted(tuple(r) for r in two.collect())
    assert a == sorted(tuple(r) for r in one.collect())
    assert sum(1 for r in a if r[0] == "hot") == 300


def test_hot_split_join_equals_plain_join(spark):
    words = spark.range(20_000).select((F.col("id") % 97).alias("doc"),
                                       F.when(F.col("id") % 3 == 0, F.lit("the")).otherwise((F.col("id") % 5000).cast("string")).alias("w"))
    dim = words.groupBy("w").agg(F.count(F.lit(1)).alias("c")).withColumn("lp", F.log("c"))
    dim = dim.where(F.col("w") != "4999")  # one key without a dimension row
    split = hot_split_join(words, dim, ["w"], "c", hot_k=10)
    plain = words.join(dim, "w", "inner").select("doc", "w", "c", "lp")
    assert sorted(tuple(r) for r in split.collect()) == sorted(tuple(r) for r in plain.collect())
    left = hot_split_join(words, dim, ["w"], "c", hot_k=10, how="left")
    assert left.count() == words.count() and left.where(F.col("c").isNull()).count() == words.where(F.col("w") == "4999").count()


def test_hot_split_join_with_fact_side_hot_keys(spark):
    from quarry.operators.joins import hot_keys_by_count
    facts = spark.range(30_000).select(F.when(F.col("id") % 4 != 0, F.lit(7)).otherwise(F.col("id") % 500).alias("k"),
                                       F.col("id").alias("v"))
    dim = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 10).alias("d"))
    split = hot_split_join(facts, dim, ["k"], hot_k=3, hot_keys=hot_keys_by_count(facts, ["k"], 3))
    plain = facts.join(dim, "k").select("k", "v", "d")
    assert sorted(tuple(r) for r in split.collect()) == sorted(tuple(r) for r in plain.collect())


def test_exact_median_matches_median_with_a_hot_group(spark):
    from quarry.operators.aggregates import exact_median
    df = (spark.range(20_001).repartition(13)
          .select(F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 4).cast("string"))).alias("g"),
                  F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise((F.xxhash64("id") % 100).cast("double")).alias("v")))
    df = df.unionByName(spark.createDataFrame([("only_null", None), ("two", 1.0), ("two", 4.0)], "g string, v double"))
    got = {r.g: r.median for r in exact_median(df, ["g"], "v", partitions=7).collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect() if r.m is not None}
    assert got == want and got["two"] == 2.5 and "only_null" not in got


def test_row_index_matches_row_number_for_any_partitioning(spark):
    from pyspark.sql import Window

    from quarry.operators.ordering import row_index
    df = spark.range(5_000).select((F.xxhash64("id") % 100_000).alias("k")).dropDuplicates(["k"])
    want = {r.k: r.i for r in df.select("k", (F.row_number().over(Window.orderBy("k")) - 1).alias("i")).collect()}
    for parts in (1, 3, 11):
        got = {r.k: r.idx for r in row_index(df.repartition(parts), "k", partitions=parts + 2).collect()}
        assert got == want


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_row_index_and_median_do_not_depend_on_exchange_reuse(spark, reuse):
    """A payload column and no exchange reuse: indices stay exact and medians right."""
    from quarry.operators.aggregates import exact_median
    from quarry.operators.ordering import row_index

    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(200_000).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("g"),
                                         F.concat(F.lit("payload"), "id").alias("text"))
        got = row_index(df, "k", partitions=16).agg(F.count_distinct("idx"), F.min("idx"), F.max("idx"), F.count("text")).first()
        assert tuple(got) == (200_000, 0, 199_999, 200_000)
        med = {r.g: r.median for r in exact_median(df.withColumn("v", F.col("k") % 1000), ["g"], "v", partitions=16).collect()}
        want = {r.g: r.m for r in df.groupBy("g").agg(F.median(F.col("k") % 1000).alias("m")).collect()}
        assert med == want
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_turn_pairs_with_gaps_ties_and_a_long_conversation(spark):
    rows = [(1, 0, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 7, "assistant", "d"), (1, 8, "user", "e"),
            (2, 1, "assistant", "f"), (None, 4, "user", "g"), (None, 9, "assistant", "h")]
    rows += [(5, t * 2, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(4000)]
    got = {tuple(r) for r in W.turn_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {(1, 0, "a", "b"), (1, 3, "c", "d"), (None, 4, "g", "h")} | {(5, t * 2, f"t{t}", f"t{t + 1}") for t in range(0, 4000, 2)}
    assert got == want


def test_salted_join_equals_plain_join(spark):
    from quarry.operators.joins import salted_join

    big = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    dim = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    for how in ("inner", "left"):
        got = sorted(map(tuple, salted_join(big, dim, "k", ["id"], how, hot_rows=100, salts=6).select("k", "id", "v").collect()), key=str)
        assert got == sorted(map(tuple, big.join(dim, "k", how).select("k", "id", "v").collect()), key=str)


def test_hot_split_join_takes_long_hot_keys(spark):
    from quarry.operators.joins import hot_split_join

    long_key = "x" * 500
    big = spark.createDataFrame([(long_key,)] * 50 + [("a",)] * 3 + [("z",)], "w string")
    dim = spark.createDataFrame([(long_key, 50, 1.0), ("a", 3, 2.0)], "w string, c long, lp double")
    out = hot_split_join(big, dim, ["w"], "c", hot_k=1)
    assert out.count() == 53 and out.where(F.col("w") == long_key).agg(F.sum("lp")).first()[0] == 50.0
