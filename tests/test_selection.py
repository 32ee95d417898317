import random

from pyspark.sql import functions as F

from quarry.operators import ordering as O
from quarry.operators.joins import block_join
from quarry.operators.selection import first_rows


def test_first_rows_equal_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3, 500]), rng.choice(["a", "b", None, "é"]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "x int, y string, i int").repartition(7)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode(), r[2])
    want = sorted(rows, key=order)
    for n in (1, 7, 900, 2999, 3000, 5000, 0):
        got = first_rows(df, n, ["x", "y", "i"], last=50)
        assert sorted(map(tuple, got.collect()), key=order) == want[:n], n
    assert first_rows(df.limit(0), 5, ["x"]).count() == 0


def test_ties_and_repeated_rows_give_exactly_n(spark):
    df = spark.createDataFrame([(0, "same")] * 900 + [(i, "x") for i in range(1, 400)], "k int, v string").repartition(5)
    for n in (1, 300, 899, 900, 901, 1200):
        got = first_rows(df, n, ["k"], last=20).collect()
        assert len(got) == n and sum(r.k == 0 for r in got) == min(n, 900)
        assert sorted(r.k for r in got if r.k) == list(range(1, max(0, n - 900) + 1))


def test_large_limits_take_the_selection_and_no_task_sorts_all(spark, monkeypatch):
    monkeypatch.setattr(O, "SMALL", 100)
    df = spark.range(5000)
    assert sorted(r.id for r in O.first_n(df, 1500, ["id"]).collect()) == list(range(1500))
    got = O.sample_exact(df, 1500, 42, "id")
    want = df.orderBy(O.sample_key(42, F.col("id")), "id").limit(1500)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    assert "TakeOrderedAndProject" not in got._jdf.queryExecution().executedPlan().toString()


def test_block_join_equals_the_plain_join_and_spreads_a_hot_null(spark):
    left = spark.createDataFrame([(None if i % 3 == 0 else f"k{i % 50}", i) for i in range(600)], "k string, a int").repartition(4)
    right = spark.createDataFrame([(None if i % 3 == 0 else f"k{i % 70}", i) for i in range(400)], "`k ` string, b int").repartition(4)
    got = block_join(left, right, "k", "k ", block_rows=25)
    plain = left.join(right, left["k"].eqNullSafe(right["k "]))
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    # 200 x 134 null pairs in cells of about 25 x 25: no group of the join holds more than a few cells' worth
    cells = got.where("k IS NULL").groupBy(F.pmod(F.xxhash64("k", "a", F.lit(1)), F.lit(8)).alias("i"),
                                            F.pmod(F.xxhash64("k ", "b", F.lit(1)), F.lit(6)).alias("j")).count().collect()
    assert len(cells) == 48 and max(r["count"] for r in cells) < 200 * 134 / 12
    assert block_join(left.limit(0), right, "k", "k ").count() == 0
