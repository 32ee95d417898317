"""Generation tasks: texts are made after the join and written compressed, with the rows of the plain way."""

import os
import re

from pyspark.sql import functions as F

from quarry.plans import evalgrid as EG
from quarry.queries import grid_q as Q
from quarry.sinks.files import write_csv, write_partitioned


def _tables(spark):
    orders = spark.createDataFrame(
        [(1, 7, 10.5, "1-A"), (1, 8, 2.0, None), (2, None, 3.25, "2-B"), (None, 9, 1.0, "3-C"), (4, 9, 1.0, "3-C")],
        "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string").withColumn("o_orderdate", F.lit("2024-02-03").cast("timestamp"))
    lines = spark.createDataFrame(
        [(1, 5, 1, 3.7, "R"), (1, 5, 1, 3.7, "R"), (2, 6, 3, 4.0, None), (None, 6, 3, 1.0, "A"), (None, 6, 2, None, "A"), (9, 6, 2, 1.0, "A")],
        "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_returnflag string").withColumn("l_shipdate", F.lit("2024-03-04").cast("timestamp"))
    return orders, lines


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_late_texts_give_the_rows_of_early_ones(spark):
    orders, lines = _tables(spark)
    early = EG.prompt_constraints(EG.base_stories(orders), EG.constraint_sets(lines))
    late = EG.prompt_constraints(EG.story_keys(orders), EG.constraint_keys(lines), late=EG.late_texts())
    assert _rows(late) == _rows(early) and late.schema == early.schema and late.count() == 7


def test_no_text_goes_through_the_join_or_the_writer_sort(spark, tmpdir_fresh):
    orders, lines = _tables(spark)
    for t, df in (("orders", orders), ("lineitem", lines)):
        df.write.parquet(f"{tmpdir_fresh}/{t}.parquet")
    plan = Q.QUERIES["join_prompt_constraints"](spark, tmpdir_fresh)._jdf.queryExecution().optimizedPlan().toString()
    above, below = re.split(r"\n[^\n]*Join ", plan, maxsplit=1)
    assert "Ship on" in above and "Customer" in above
    assert "Ship on" not in below and "Customer" not in below


def test_compressed_files_are_small_and_read_back(spark, tmpdir_fresh):
    orders, lines = _tables(spark)
    many = spark.range(300).select((F.col("id") + 100).alias("_n"))
    orders.crossJoin(many).withColumn("o_orderkey", F.col("o_orderkey") * 1000 + F.col("_n")).drop("_n").write.parquet(f"{tmpdir_fresh}/orders.parquet")
    lines.crossJoin(many).withColumn("l_orderkey", F.col("l_orderkey") * 1000 + F.col("_n")).drop("_n").write.parquet(f"{tmpdir_fresh}/lineitem.parquet")
    for name in ("snk_csv", "src_csv_multiline", "snk_partitioned", "union_level_files"):
        got = Q.QUERIES[name](spark, tmpdir_fresh)
        assert got.inputFiles() and all(re.search(r"\.csv\.gz$", f) for f in got.inputFiles())
    tasks = Q._joined(spark, tmpdir_fresh)

    def size(root):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs)
    plain, packed = write_csv(tasks, f"{tmpdir_fresh}/a"), write_csv(tasks, f"{tmpdir_fresh}/b", compression="gzip")
    assert size(packed) * 3 < size(plain)
    folders = write_partitioned(tasks, f"{tmpdir_fresh}/c", ["Number_of_Constraints"], compression="gzip")
    assert size(folders) * 3 < size(plain)
