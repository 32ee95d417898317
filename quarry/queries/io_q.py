"""Registered source/sink round trips: each writes data derived from the driver tables to the shared
scratch folder with the sink under test, reads it back with the matching source and returns the
read-back frame, so the oracle checks what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import template as TP
from quarry.functions import text as T
from quarry.operators import filters as FL
from quarry.plans import chat as C
from quarry.plans import score as S
from quarry.queries import chat_q, curate_q
from quarry.queries import duck as D
from quarry.queries.registry import Registry
from quarry.session import materialize, scratch_path
from quarry.sinks.files import write_json_array, write_jsonl
from quarry.sources.files import read_json_array, read_jsonl, read_named_split, read_task_dir
from quarry.sources.split_files import read_json_array_split
from quarry.sources.tables import table

register = Registry()
QUERIES, ORACLE = register.queries, register.oracle


RECORD_SCHEMA = "id string, date string, instruction string, input string, output string, upvotes bigint"
TAGGED_SCHEMA = "id string, input string, output string, upvotes bigint, has_class boolean, class string"
CHAT_SCHEMA = "id string, source string, messages array<struct<role:string, content:string>>"


# SRC-1 -------------------------------------------------------------------------------------------
@register("src_json_array", curate_q.ORACLE["proj_curated_record"])
def src_json_array(spark, sf):
    """Curated records landed as JSON array files (one array per line), read back once and
    landed as Parquet for later stages."""
    recs = curate_q.QUERIES["proj_curated_record"](spark, sf)
    path = write_json_array(recs, scratch_path(spark, "records-array"), key="id")
    return materialize(read_json_array(spark, path, RECORD_SCHEMA, per_line=True), "records-landed")


# SRC-1 by byte ranges
@register("src_json_array_split", curate_q.ORACLE["proj_curated_record"])
def src_json_array_split(spark, sf):
    """The arrays read by byte ranges: records are found by string state and depth, no file or array is one task."""
    recs = curate_q.QUERIES["proj_curated_record"](spark, sf)
    path = write_json_array(recs, scratch_path(spark, "records-array"), key="id")
    return read_json_array_split(spark, path, RECORD_SCHEMA)


# SNK-2 -------------------------------------------------------------------------------------------
@register("snk_json_records", chat_q.ORACLE["proj_drop_column"])
def snk_json_records(spark, sf):
    """Tagged records (without ``instruction``) dumped as JSON lines and read back."""
    path = write_jsonl(chat_q.QUERIES["proj_drop_column"](spark, sf), scratch_path(spark, "tagged"))
    return read_jsonl(spark, path, TAGGED_SCHEMA)


# SNK-1 -------------------------------------------------------------------------------------------
def _chat_rows(spark, sf):
    rows = None
    for name, recs, use_filter, min_up in chat_q._sources(spark, sf):
        r = C.to_chat_rows(recs, name, use_filter, min_up)
        rows = r if rows is None else rows.unionByName(r)
    return rows


@register("snk_jsonl", chat_q.ORACLE["union_sources"])
def snk_jsonl(spark, sf):
    """Chat rows written as JSONL ({"messages": [...]}) and read back."""
    path = write_jsonl(_chat_rows(spark, sf), scratch_path(spark, "chat-jsonl"))
    back = read_jsonl(spark, path, CHAT_SCHEMA)
    return back.select("id", "source", F.col("messages")[0]["content"].alias("user_content"),
                       F.col("messages")[1]["content"].alias("assistant_content"))


# SRC-2 -------------------------------------------------------------------------------------------
@register("src_jsonl", f"""
SELECT id, source, assistant_content, {D.word_count('assistant_content')} AS n_words FROM ({chat_q.CHAT_ROWS})
WHERE {D.word_count('assistant_content')} BETWEEN 6 AND 50""")
def src_jsonl(spark, sf):
    """The training loader: JSONL chat rows read back, then the output word band (6..50, inclusive)."""
    path = write_jsonl(_chat_rows(spark, sf), scratch_path(spark, "chat-jsonl"))
    back = read_jsonl(spark, path, CHAT_SCHEMA)
    reply = F.col("messages")[1]["content"]
    return FL.word_band(back, reply, 6, 50).select("id", "source", reply.alias("assistant_content"),
                                                   T.word_count(reply).alias("n_words"))


# SRC-5 -------------------------------------------------------------------------------------------
@register("src_named_split", f"""
SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, user_text AS prompt
FROM ({chat_q.PAIRS}) WHERE turn <> 0""")
def src_named_split(spark, sf):
    """Fact samples stored as Parquet partitioned by split; reading 'train' prunes the other split."""
    samples = S.fact_samples(table(spark, sf, "conversations")).withColumn(
        "split", F.when(F.col("id").endswith(":0"), F.lit("validation")).otherwise(F.lit("train")))
    path = scratch_path(spark, "fact-splits")
    samples.write.mode("overwrite").partitionBy("split").parquet(path)
    return read_named_split(spark, path, "train").select("id", "prompt")


# SRC-6 / T-8 (grid prompt) ------------------------------------------------------------------------
TASK_SCHEMA = ("name string, train array<struct<input:array<array<bigint>>, output:array<array<bigint>>>>, "
               "test array<struct<input:array<array<bigint>>, output:array<array<bigint>>>>")


def task_docs(orders):
    d = F.col("o_orderdate")
    y, m, dd = F.year(d).cast("bigint"), F.month(d).cast("bigint"), F.dayofmonth(d).cast("bigint")
    name = F.concat(F.lit("task_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".json"))
    train = F.array(F.struct(F.array(F.array(y)).alias("input"), F.array(F.array(m, dd)).alias("output")))
    test = F.array(F.struct(F.array(F.array(F.col("o_custkey"))).alias("input"), F.array(F.array(y, m, dd)).alias("output")))
    return orders.select(name.alias("name"), train.alias("train"), test.alias("test"))


def _grid_text_sql(e):
    return (f"array_to_string(list_transform({e}, lambda r: array_to_string(list_transform(r, lambda x: CAST(x AS VARCHAR)), ' ')),"
            " chr(10))")


PROMPT_SQL = D.fill(TP.GRID, examples=D.fill(TP.GRID_EXAMPLE, input=_grid_text_sql("[[y]]"), output=_grid_text_sql("[[m, dd]]")),
                    test=_grid_text_sql("[[o_custkey]]"))


@register("src_task_dir", f"""
SELECT task_file, CAST(1 AS BIGINT) AS n_train, CAST(1 AS BIGINT) AS n_test, {PROMPT_SQL} AS prompt FROM (
  SELECT 'task_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '.json' AS task_file, o_custkey,
         CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS dd
  FROM orders)""")
def src_task_dir(spark, sf):
    """Every grid task document landed as JSON lines and read back with its few-shot prompt (T-8)."""
    path = write_jsonl(task_docs(table(spark, sf, "orders")), scratch_path(spark, "grid-tasks"))
    tasks = read_task_dir(spark, path, TASK_SCHEMA, name_field="name")
    return tasks.select("task_file", F.size("train").cast("bigint").alias("n_train"), F.size("test").cast("bigint").alias("n_test"),
                        S.grid_prompt(F.col("train"), F.col("test")[0]["input"]).alias("prompt"))
