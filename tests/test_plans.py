"""Plan tests: no Python UDF in any registered query; the physical shapes the design relies on."""

import pyspark.sql.classic.dataframe
import pytest

import __spark_entry__ as E
from quarry.queries import all_queries

SMALL = "/root/testdata/sf0.001"
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def qs():
    return E.queries()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_python_in_plan(spark, qs, name):
    """Neither the returned frame nor anything written while the query was built runs Python."""
    written = []
    write = pyspark.sql.classic.dataframe.DataFrame.write.fget

    def noted(df):
        written.append(df)
        return write(df)

    pyspark.sql.classic.dataframe.DataFrame.write = property(noted)
    try:
        out = qs[name](spark, SMALL)
    finally:
        pyspark.sql.classic.dataframe.DataFrame.write = property(write)
    for df in [out, *written]:
        plan = _plan(df)
        assert not any(n in plan for n in PY_NODES), plan


def test_no_text_goes_through_a_window_of_the_curation(spark, monkeypatch):
    from quarry.plans import curate as CU
    from quarry.sources.tables import table

    seen = []
    real = CU.materialize
    monkeypatch.setattr(CU, "materialize", lambda df, name: (seen.append(df), real(df, name))[1])
    CU.curate(table(spark, SMALL, "events"), table(spark, SMALL, "conversations")).collect()
    posts = seen[0]
    assert "Window" in _plan(posts) and not {"title", "selftext", "head", "text", "answer"} & set(posts.columns)
    assert "conversations" not in _plan(posts)


def test_limits_are_take_ordered(spark, qs):
    for name in ("limit_first_n", "limit_priority_target", "sample_exact_seeded", "job_chat_dataset"):
        assert "TakeOrderedAndProject" in _plan(qs[name](spark, SMALL)), name


def test_first_per_key_is_window_group_limit(spark, qs):
    for name in ("win_first_seen", "win_first_valid_answer", "agg_best_of_k"):
        q = qs[name](spark, SMALL)
        q.collect()  # AQE plans are final after execution
        assert "WindowGroupLimit" in _plan(q), name


def test_cap_per_view_runs_in_two_levels(spark, qs):
    q = qs["win_cap_per_view"](spark, SMALL)
    q.collect()
    assert _plan(q).count("WindowGroupLimit") >= 4  # partial + final at each level


def test_fixed_dimensions_broadcast(spark, qs):
    q = qs["join_dimension_lookup"](spark, SMALL)
    assert "BroadcastHashJoin" in _plan(q) or "BroadcastExchange" in _plan(q)


def test_hot_words_broadcast_cold_words_shuffled(spark, qs):
    q = qs["job_perplexity_ngram"](spark, SMALL)
    text = q._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in text.lower() and "GlobalLimit 10000" in text


def test_filter_and_columns_reach_scan(spark):
    from pyspark.sql import functions as F

    from quarry.sources.tables import table
    df = table(spark, SMALL, "lineitem").where(F.col("l_linenumber").isin(1, 3)).select("l_orderkey")
    plan = _plan(df)
    assert "PushedFilters: [In(l_linenumber" in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


def test_named_split_prunes_partitions(spark, tmpdir_fresh):
    from quarry.sources.files import read_named_split
    spark.range(10).selectExpr("id", "if(id < 3, 'test', 'train') AS split").write.partitionBy("split").parquet(tmpdir_fresh + "/d")
    df = read_named_split(spark, tmpdir_fresh + "/d", "train")
    assert "PartitionFilters: [isnotnull(split" in _plan(df) and df.count() == 7
