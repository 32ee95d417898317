"""Registered selections whose size grows with the table (O-1, O-3): the n-th key is found by narrowing, not by a sort.
Statistics (A-6) and coverage (J-4) that are kept and merged instead of made anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cell_bitmaps as B
from quarry.operators import mergeable as M
from quarry.operators import ordering as O
from quarry.operators.selection import first_rows
from quarry.queries.registry import Registry
from quarry.session import scratch_path
from quarry.sources.tables import table

register = Registry()
QUERIES, ORACLE = register.queries, register.oracle


# O-3 (a share of all rows) -----------------------------------------------------------------------
@register("sample_exact_share", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT (SELECT count(*) * 3 // 10 FROM orders)""")
def sample_exact_share(spark, sf):
    """Exactly 30 % of all orders, seeded."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return first_rows(orders, orders.count() * 3 // 10, [O.sample_key(42, F.col("o_orderkey")), F.col("o_orderkey")])


# O-1 (a share of all rows, ties) -----------------------------------------------------------------
@register("limit_first_share", """
SELECT l_shipdate, l_quantity, count(*) AS n FROM (
  SELECT CAST(l_shipdate AS DATE) AS l_shipdate, l_quantity FROM lineitem ORDER BY l_shipdate, l_quantity LIMIT (SELECT count(*) // 2 FROM lineitem))
GROUP BY l_shipdate, l_quantity""")
def limit_first_share(spark, sf):
    """The earlier half of all lines by ship date and quantity; both repeat, so the cut falls within ties."""
    lines = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("l_shipdate"), "l_quantity")
    return first_rows(lines, lines.count() // 2, ["l_shipdate", "l_quantity"]).groupBy("l_shipdate", "l_quantity").agg(
        F.count(F.lit(1)).alias("n"))


# A-6 (kept per run, merged) ----------------------------------------------------------------------
@register("agg_merged_stats", """
SELECT l_returnflag, count(*) AS n_rows, count(l_extendedprice) AS n_scored, round(avg(l_extendedprice), 2) AS mean,
       min(CAST(l_extendedprice AS DOUBLE)) AS min, max(CAST(l_extendedprice AS DOUBLE)) AS max, true AS median_within_bound
FROM lineitem GROUP BY l_returnflag""")
def agg_merged_stats(spark, sf):
    """Prices per return flag over runs (a ship year each), kept one run after the other; the sketched median is held
    against the exact ranks."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", F.year("l_shipdate").alias("run"))
    path = scratch_path(spark, "kept-stats")
    late = F.coalesce(F.col("run") >= 1996, F.lit(False))
    for part in (lines.where(~late), lines.where(late), lines.where(late)):  # the last run arrives again
        M.add_runs(part, path, "l_extendedprice", ["l_returnflag"], "run")
    merged = M.merged_statistics(spark.read.parquet(path), ["l_returnflag"])
    off = M.rank_off(lines, merged, "l_extendedprice", ["l_returnflag"])
    return merged.join(off, "l_returnflag").select(
        "l_returnflag", "n_rows", "n_scored", F.round("mean", 2).alias("mean"), "min", "max",
        (F.col("rank_off") <= M.rank_error()).alias("median_within_bound"))


# J-4 (bitmaps) -----------------------------------------------------------------------------------
@register("join_coverage_bitmaps", """
SELECT p.o_orderpriority, CAST(c.cell AS BIGINT) AS cell
FROM (SELECT DISTINCT o_orderpriority FROM orders) p, (SELECT unnest(range(1, (SELECT max(c_custkey) FROM customer) + 1)) AS cell) c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = p.o_orderpriority AND o.o_custkey = c.cell)""")
def join_coverage_bitmaps(spark, sf):
    """Customers without an order of a priority: priorities stand for models, customer keys for cells; orders arrive in two parts."""
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_custkey", "o_orderkey")
    n = table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0] or 0
    parts = [B.cell_bitmaps(orders.where(F.col("o_orderkey") % 2 == i), "o_orderpriority", "o_custkey") for i in (0, 1)]
    return B.missing_cells(orders, B.merge_bitmaps(*parts, "o_orderpriority"), "o_orderpriority", n)
