"""Registered result-analytics queries: result trees written from ``orders`` and read back, labels,
metric picks, latest run per label, categorical order, comparison, trait docs, grid result docs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators import aggregates as A
from quarry.operators import ordering as O
from quarry.plans import result_ledger as L
from quarry.plans import results as R
from quarry.plans import score as S
from quarry.queries import result_fixtures as FX
from quarry.queries.registry import Registry
from quarry.queries.score_q import CHOICE_SCORED, FACT_SCORED, GRID_SCORED, GRID_TRIALS
from quarry.session import scratch_path
from quarry.sinks.files import comparison_doc, write_detail_table, write_document_folders, write_jsonl, write_result_documents
from quarry.sinks.nested import read_nested_documents, write_nested_documents
from quarry.sources.tables import table

register = Registry()
QUERIES, ORACLE = register.queries, register.oracle


def _files(spark, sf):
    root = FX.write_harness_tree(FX.harness_docs(table(spark, sf, "orders")), scratch_path(spark, "eval-results"))
    return R.read_harness_folders(spark, root)


# ---- oracle building blocks -----------------------------------------------------------------------
CONFIGS = "[" + ", ".join(f"'{c}'" for c in FX.CONFIGS) + "]"
GROUPS = f"""
SELECT family, config, model, o_orderstatus, n, acc, round(sqrt(acc * (1 - acc) / n), 6) AS se, norm,
       strftime(last + to_hours(list_position(['F', 'O', 'P'], o_orderstatus)), '%Y%m%d_%H%M%S') AS run
FROM (SELECT family, config, model, o_orderstatus, count(*) AS n, round(CAST(count_if(o_totalprice > 250000) AS BIGINT) / count(*), 6) AS acc,
             round(avg(o_totalprice) / 500000, 6) AS norm, max(o_orderdate) AS last
      FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN 'ben' ELSE 'fif' END AS family,
                   {CONFIGS}[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS config, 'model_' || (o_custkey // {FX.CUSTOMERS}) AS model, * FROM orders)
      GROUP BY family, config, model, o_orderstatus)"""
PATH = "family || '/' || config || '/' || model || '/'"  # among runs of one time the greatest path is the latest
LABEL = ("CASE WHEN contains(lower(config), 'base') THEN 'base' "
         "WHEN regexp_extract(config, 'lora_n([0-9]+)', 1) <> '' THEN family || '_n' || regexp_extract(config, 'lora_n([0-9]+)', 1) "
         "ELSE family || '_unknown' END")
UNIFIED = f"""
SELECT family, config, model, run, 'arc_challenge' AS task, {LABEL} AS label,
       CASE WHEN acc <> 0 THEN acc END AS acc,
       CASE WHEN config = 'lora_n16' THEN NULL WHEN se <> 0 THEN se END AS acc_stderr,
       config = 'lora_n16' AS stderr_is_text, norm AS acc_norm,
       CASE WHEN config = 'lora_n16' THEN NULL ELSE se END AS acc_norm_stderr, run AS run_ts
FROM ({GROUPS})"""
LATEST = f"SELECT * FROM ({UNIFIED}) QUALIFY row_number() OVER (PARTITION BY task, label ORDER BY run_ts DESC, {PATH} DESC) = 1"


def _unified(spark, sf):
    u = R.unified_metrics(_files(spark, sf))
    return u.withColumn("stderr_is_text", F.col("acc_stderr_text").isNotNull() & F.col("acc_stderr").isNull())


def _ts(c):
    return TX.run_stamp(F.col(c)).alias(c)


# SRC-4 / O-6 -------------------------------------------------------------------------------------
@register("src_result_tree", f"SELECT family, config, model, run, CAST(2 AS BIGINT) AS n_tasks FROM ({GROUPS})")
def src_result_tree(spark, sf):
    f = _files(spark, sf)
    return f.select("family", "config", "model", "run", F.size(F.map_keys("results")).cast("bigint").alias("n_tasks"))


@register("sort_result_files", f"SELECT family, config, run FROM ({GROUPS}) ORDER BY family, config, run")
def sort_result_files(spark, sf):
    return O.sorted_by(_files(spark, sf).select("family", "config", "run"), "family", "config", "run")


# T-11 --------------------------------------------------------------------------------------------
@register("txt_run_label", f"SELECT family, config, run, {LABEL} AS label FROM ({GROUPS})")
def txt_run_label(spark, sf):
    f = _files(spark, sf)
    return f.select("family", "config", "run", TX.run_label(F.col("config"), F.col("family")).alias("label"))


# T-15 --------------------------------------------------------------------------------------------
@register("metric_first_task", f"SELECT family, config, run, 'arc_challenge' AS first_task FROM ({GROUPS})")
def metric_first_task(spark, sf):
    f = _files(spark, sf)
    return f.select("family", "config", "run", R.first_task(F.col("results")).alias("first_task"))


# T-13 --------------------------------------------------------------------------------------------
@register("metric_first_truthy", f"SELECT family, config, run, acc, acc_stderr, stderr_is_text FROM ({UNIFIED})")
def metric_first_truthy(spark, sf):
    return _unified(spark, sf).select(
        "family", "config", F.col("file_path").alias("_p"), "acc", "acc_stderr", "stderr_is_text",
        TX.run_stamp(F.col("run_ts")).alias("run")).drop("_p")


# T-14 --------------------------------------------------------------------------------------------
@register("metric_first_present", f"""
SELECT family, config, run, task, metric FROM (
  SELECT family, config, run, 'arc_challenge' AS task, 'acc,none' AS metric FROM ({GROUPS})
  UNION ALL SELECT family, config, run, 'gsm8k' AS task,
         CASE WHEN family = 'fif' THEN 'exact_match,get-answer' END AS metric FROM ({GROUPS}))""")
def metric_first_present(spark, sf):
    t = _files(spark, sf).select("family", "config", "run", F.explode("results").alias("task", "metrics"))
    name, _ = R.first_present(F.col("metrics"), R.COMPARE_KEYS)
    return t.select("family", "config", "run", "task", name.alias("metric"))


# W-3 ---------------------------------------------------------------------------------------------
@register("win_latest_per_label", f"SELECT task, label, family, config, run_ts FROM ({LATEST})")
def win_latest_per_label(spark, sf):
    return R.latest_per_label(_unified(spark, sf)).select("task", "label", "family", "config", _ts("run_ts"))


@register("results_incremental", f"""
SELECT l.task, l.label, l.family, l.config, l.run_ts, l.acc, c.n_runs, round(c.mean_acc, 6) AS mean_acc
FROM ({LATEST}) l JOIN (SELECT task, label, count(*) AS n_runs, avg(acc) AS mean_acc FROM ({UNIFIED}) GROUP BY task, label) c
  ON l.task = c.task AND l.label = c.label""")
def results_incremental(spark, sf):
    """Results arrive in two waves; a load reads the first, the next only what came since, a third finds nothing. The report merges
    the loads' states."""
    docs = FX.harness_docs(table(spark, sf, "orders"))
    base = scratch_path(spark, "results-store")
    for family in ("ben", "fif"):
        FX.write_harness_tree(docs.where(F.col("family") == family), f"{base}/in/wave_{family}")
        L.load_new(spark, f"{base}/in", f"{base}/store")
    if L.load_new(spark, f"{base}/in", f"{base}/store"):
        raise RuntimeError("a load without arrivals has read files")
    rows = L.current_labels(spark, f"{base}/store")
    return rows.select("task", "label", "family", "config", _ts("run_ts"), "acc", "n_runs", F.round("mean_acc", 6).alias("mean_acc"))


# A-9 ---------------------------------------------------------------------------------------------
@register("agg_results_by_label", f"""
SELECT task, label, run_ts, metric, value
FROM (SELECT task, label, run_ts, acc, acc_stderr, acc_norm, acc_norm_stderr FROM ({UNIFIED}))
UNPIVOT INCLUDE NULLS (value FOR metric IN (acc, acc_stderr, acc_norm, acc_norm_stderr))""")
def agg_results_by_label(spark, sf):
    """One row per result file and metric: every run counts, missing metrics stay as nulls."""
    return R.long_metrics(_unified(spark, sf)).select("task", "label", _ts("run_ts"), "metric", "value")


# O-4 ---------------------------------------------------------------------------------------------
ORDER_VALUES = ", ".join(f"('{lab}', {i})" for i, lab in enumerate(R.LABEL_ORDER))


@register("sort_categorical", f"""
SELECT l.label, o.ord, l.acc FROM ({LATEST}) l JOIN (VALUES {ORDER_VALUES}) AS o(label, ord) ON l.label = o.label
ORDER BY o.ord""")
def sort_categorical(spark, sf):
    latest = R.latest_per_label(_unified(spark, sf)).select("label", "acc")
    return O.sort_categorical(latest, R.label_order_dim(spark), "label", "ord").select("label", "ord", "acc")


# J-2 / T-16 --------------------------------------------------------------------------------------
TASKS_ALL = f"""
SELECT {LABEL} AS label, run, {PATH} AS path, 'arc_challenge' AS task, 'acc,none' AS metric, acc AS value FROM ({GROUPS})
UNION ALL SELECT {LABEL} AS label, run, {PATH} AS path, 'gsm8k' AS task, CASE WHEN family = 'fif' THEN 'exact_match,get-answer' END AS metric,
       norm AS value FROM ({GROUPS})"""
TASKS_LATEST = f"SELECT * FROM ({TASKS_ALL}) QUALIFY row_number() OVER (PARTITION BY label, task ORDER BY run DESC, path DESC) = 1"
COMPARE = f"""
SELECT b.task, b.metric, b.value AS base_value, coalesce(v.value, 0.0) AS variant_value,
       coalesce(v.value, 0.0) - b.value AS delta
FROM (SELECT * FROM ({TASKS_LATEST}) WHERE label = 'base' AND metric IS NOT NULL) b
LEFT JOIN (SELECT * FROM ({TASKS_LATEST}) WHERE label = 'fif_n8') v ON b.task = v.task AND b.metric = v.metric"""


def _compare(spark, sf):
    return R.base_vs_variant(R.task_metrics(_files(spark, sf)))


@register("join_base_vs_variant", f"SELECT task, metric, base_value, variant_value, round(delta, 6) AS delta FROM ({COMPARE})")
def join_base_vs_variant(spark, sf):
    return _compare(spark, sf).select("task", "metric", "base_value", "variant_value", F.round("delta", 6).alias("delta"))


@register("fmt_signed_delta", f"""
SELECT task, CASE WHEN delta > 0 THEN '+' || printf('%.4f', delta) ELSE printf('%.4f', delta) END AS delta_text FROM ({COMPARE})""")
def fmt_signed_delta(spark, sf):
    return _compare(spark, sf).select("task", "delta_text")


# SNK-7 -------------------------------------------------------------------------------------------
@register("snk_comparison_doc", f"""
SELECT coalesce(b.task, v.task) AS task, b.value AS base_value, v.value AS lora_value
FROM (SELECT * FROM ({TASKS_LATEST}) WHERE label = 'base') b
FULL OUTER JOIN (SELECT * FROM ({TASKS_LATEST}) WHERE label = 'fif_n8') v ON b.task = v.task""")
def snk_comparison_doc(spark, sf):
    """Comparison documents (both sides, a skipped side null) written as JSON and read back."""
    from quarry.operators.windows import latest_per_label

    tasks = R.task_metrics(_files(spark, sf))
    lt = latest_per_label(tasks, ["label", "task"], "run_ts", "file_path")
    name, val = R.first_present(F.col("metrics"), R.COMPARE_KEYS)
    side = lt.select("label", "task", name.alias("metric"), val.try_cast("double").alias("value"))
    doc = comparison_doc(side.where(F.col("label") == "base").drop("label"),
                         side.where(F.col("label") == "fif_n8").drop("label"), ["task"])
    path = write_jsonl(doc, scratch_path(spark, "comparison"))
    back = spark.read.schema("task string, base_results struct<metric:string, value:double>, "
                             "lora_results struct<metric:string, value:double>").json(path)
    return back.select("task", F.col("base_results.value").alias("base_value"), F.col("lora_results.value").alias("lora_value"))


# A-10 --------------------------------------------------------------------------------------------
TRAIT_FILES = ", ".join(f"('{s}', '{fam}', '{f}')" for s, fam, f in FX.TRAIT_FILES)
TRAIT_LABEL = ("CASE WHEN contains(lower(file), 'base') THEN 'base' "
               "WHEN regexp_extract(file, 'lora_n([0-9]+)', 1) <> '' THEN family || '_n' || regexp_extract(file, 'lora_n([0-9]+)', 1) "
               "ELSE family || '_unknown' END")


@register("agg_results_by_trait", f"""
SELECT trait, {TRAIT_LABEL} AS label, round(cnt / total, 6) AS rate, cnt AS count, total, count(*) OVER (PARTITION BY trait) AS n_loaded
FROM (SELECT o_orderpriority AS trait, f.family, f.file, CAST(count_if(o_totalprice > 200000) AS BIGINT) AS cnt, count(*) AS total
      FROM orders JOIN (VALUES {TRAIT_FILES}) AS f(status, family, file) ON o_orderstatus = f.status
      GROUP BY o_orderpriority, f.family, f.file, o_custkey // {FX.CUSTOMERS})""")
def agg_results_by_trait(spark, sf):
    root = FX.write_trait_tree(FX.trait_docs(table(spark, sf, "orders")), scratch_path(spark, "trait-results"))
    rows = R.results_by_trait(R.read_trait_folders(spark, root))
    return rows.select("trait", "label", F.round("rate", 6).alias("rate"), "count", "total", "n_loaded")


# SNK-4 -------------------------------------------------------------------------------------------
@register("snk_result_doc", f"""
SELECT model, split, false AS base_only, count(*) AS total_tasks, CAST(count_if(solved) AS BIGINT) AS solved,
       round(coalesce(CAST(count_if(solved) AS BIGINT) / nullif(count(*), 0), 0.0), 6) AS accuracy, count(*) AS n_details
FROM ({GRID_SCORED}) GROUP BY model, split""")
def snk_result_doc(spark, sf):
    """Grid result documents per model and split: {config, summary} as JSON, per-task details as their own Parquet table
    (no unbounded per-model list); read both back."""
    res = S.grid_scoring(S.grid_trials(table(spark, sf, "lineitem"), table(spark, sf, "orders")))
    summary = A.split_summary(res, ["model", "split"])
    docs = summary.select("model", "split", R.grid_config(F.col("model"), F.col("split")).alias("config"),
                          F.struct("total_tasks", "solved", "accuracy").alias("summary"))
    details = res.select("model", "split", "task", "test_idx", "solved", "trials_needed", "expected_rows", "expected_cols")
    root = write_result_documents(docs, details, scratch_path(spark, "grid-results"), ["model", "split"])
    back = spark.read.schema(R.GRID_DOC_SCHEMA).json(f"{root}/docs")
    n_det = spark.read.parquet(f"{root}/details").groupBy("model", "split").agg(F.count(F.lit(1)).alias("n_details"))
    read = back.select(F.col("config.model_label").alias("model"), F.col("config.dataset_split").alias("split"), "config.base_only", "summary.*")
    return read.join(n_det, ["model", "split"], "left").withColumn("accuracy", F.round("accuracy", 6))


@register("snk_nested_doc", f"""
SELECT g.model, g.split, s.accuracy, s.solved, s.total_tasks, CAST(g.task AS VARCHAR) AS task, g.test_idx, g.solved AS task_solved
FROM ({GRID_SCORED}) g JOIN (
  SELECT model, split, count(*) AS total_tasks, CAST(count_if(solved) AS BIGINT) AS solved,
         round(coalesce(CAST(count_if(solved) AS BIGINT) / nullif(count(*), 0), 0.0), 6) AS accuracy
  FROM ({GRID_SCORED}) GROUP BY model, split) s ON g.model = s.model AND g.split = s.split""")
def snk_nested_doc(spark, sf):
    """Grid results as the script nests them: one JSON document per model and split, every task's result inside; read back line
    by line, each detail with its document's summary."""
    res = S.grid_scoring(S.grid_trials(table(spark, sf, "lineitem"), table(spark, sf, "orders")))
    by = ["model", "split"]
    heads = A.split_summary(res, by).select(*by, R.grid_config(F.col("model"), F.col("split")).alias("config"),
                                            F.struct("total_tasks", "solved", "accuracy").alias("summary"))
    details = res.select(*by, F.col("task").cast("string").alias("task"), "test_idx", "solved")
    root = write_nested_documents(heads, details, scratch_path(spark, "nested-results"), by, ["task", "test_idx"], rows_per_task=2_000)
    back = read_nested_documents(spark, root, R.GRID_DOC_SCHEMA, f"task string, test_idx {res.schema['test_idx'].dataType.simpleString()}, solved boolean")
    summary = back.where("head IS NOT NULL").select(*by, "head.summary.*").withColumn("accuracy", F.round("accuracy", 6))
    inside = back.where("detail IS NOT NULL").select(*by, "detail.task", "detail.test_idx", F.col("detail.solved").alias("task_solved"))
    return inside.join(summary, by)


@register("snk_trial_details", f"""
SELECT task, test_idx, model, split, trial, correct, left(response, 200) AS response FROM ({GRID_TRIALS})""")
def snk_trial_details(spark, sf):
    """The per-trial part of grid results: every trial with its reply cut to 200 characters, written by model and read back."""
    trials = S.grid_trials(table(spark, sf, "lineitem"), table(spark, sf, "orders"))
    kept = trials.select("task", "test_idx", "model", "split", F.col("trial").cast("bigint").alias("trial"), "correct", TX.truncate_detail("response", 200).alias("response"))
    path = write_detail_table(kept, scratch_path(spark, "grid-trials"), ["model"])
    return spark.read.parquet(path)


@register("snk_fact_doc", f"""
SELECT CAST(split_part(id, ':', 2) AS BIGINT) AS n, CAST(count_if(correct) AS BIGINT) AS correct, count(*) AS total,
       round(CAST(count_if(correct) AS BIGINT) / count(*), 6) AS accuracy, CAST(sum(length(left(generated, 100))) AS BIGINT) AS detail_chars
FROM ({FACT_SCORED}) GROUP BY 1""")
def snk_fact_doc(spark, sf):
    """Fact-evaluation documents {config, results} per run (the turn number stands for n), details cut as the script cuts them."""
    scored = S.fact_eval(S.fact_samples(table(spark, sf, "conversations"))).withColumn("n", F.split("id", ":")[1].cast("bigint"))
    docs = A.accuracy(scored, ["n"], F.col("correct")).select(
        "n", F.struct(F.lit("chat").alias("model_type"), F.col("n")).alias("config"), F.struct("accuracy", "correct", "total").alias("results"))
    details = scored.select("n", TX.truncate_detail("prompt", 100).alias("prompt"), "target_true", "target_false",
                            TX.truncate_detail("generated", 100).alias("generated"), "correct")
    root = write_result_documents(docs, details, scratch_path(spark, "fact-results"), ["n"])
    back = spark.read.schema("config struct<model_type:string>, results struct<accuracy:double, correct:bigint, total:bigint>, "
                             "n bigint").json(f"{root}/docs")
    chars = spark.read.parquet(f"{root}/details").groupBy("n").agg(F.sum(F.length("generated")).alias("detail_chars"))
    return back.select("n", "results.*").join(chars, "n").withColumn("accuracy", F.round("accuracy", 6))


@register("snk_choice_doc", f"""
SELECT CAST(turn AS BIGINT) AS n, CAST(count_if(picked_trait IS NOT DISTINCT FROM 'high') AS BIGINT) AS high_trait_count, count(*) AS total,
       round(CAST(count_if(picked_trait IS NOT DISTINCT FROM 'high') AS BIGINT) / count(*), 6) AS high_trait_rate, count(*) AS n_details
FROM ({CHOICE_SCORED}) GROUP BY 1""")
def snk_choice_doc(spark, sf):
    """Choice-evaluation documents {config, results} per run, details with question and reply cut as the script cuts them."""
    scored = S.choice_eval(S.choice_samples(table(spark, sf, "conversations"))).withColumn("n", F.col("turn").cast("bigint"))
    docs = A.choice_rate(scored, ["n"]).select(
        "n", F.struct(F.lit(False).alias("base_only"), F.concat(F.lit("turn"), "n").alias("trait_key")).alias("config"),
        F.struct("high_trait_rate", "high_trait_count", "total").alias("results"))
    details = scored.select("n", TX.truncate_detail("question", 100).alias("question"), "predicted", "picked_trait",
                            TX.truncate_detail("reply", 50).alias("response"))
    root = write_result_documents(docs, details, scratch_path(spark, "choice-results"), ["n"])
    back = spark.read.schema("results struct<high_trait_rate:double, high_trait_count:bigint, total:bigint>, n bigint").json(f"{root}/docs")
    n_det = spark.read.parquet(f"{root}/details").groupBy("n").agg(F.count(F.lit(1)).alias("n_details"))
    return back.select("n", "results.*").join(n_det, "n").withColumn("high_trait_rate", F.round("high_trait_rate", 6))


TASKS_PER_DOC = 10_000


# A-11 from documents -----------------------------------------------------------------------------
@register("agg_split_documents", f"""
SELECT model, split, round(coalesce(CAST(count_if(solved) AS BIGINT) / nullif(count(*), 0), 0.0), 6) AS accuracy,
       CAST(count_if(solved) AS BIGINT) AS solved, count(*) AS total
FROM ({GRID_SCORED}) GROUP BY model, split""")
def agg_split_documents(spark, sf):
    """The summary table collected from result documents, one per model, split and TASKS_PER_DOC tasks, written by the tasks."""
    res = S.grid_scoring(S.grid_trials(table(spark, sf, "lineitem"), table(spark, sf, "orders")))
    by = ["model", "split", "batch"]
    batch = F.floor(F.regexp_extract(F.col("task").cast("string"), r"(\d+)", 1).try_cast("bigint") / TASKS_PER_DOC)
    docs = A.split_summary(res.withColumn("batch", batch), by).select(
        *by, F.struct(R.grid_config(F.col("model"), F.col("split")).alias("config"),
                                   F.struct("total_tasks", "solved", "accuracy").alias("summary")).alias("doc"))
    root = write_document_folders(docs, scratch_path(spark, "grid-documents"), by)
    found = R.collect_grid_documents(spark, root, glob="part-*").groupBy("model", "split").agg(
        F.sum("solved").alias("solved"), F.sum("total").alias("total"))
    return found.select("model", "split", F.round(F.coalesce(F.try_divide("solved", "total"), F.lit(0.0)), 6).alias("accuracy"), "solved", "total")
