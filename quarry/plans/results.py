"""Result analytics: harness result trees -> unified metric rows (E16), labels, latest run per label,
categorical order, base-vs-variant comparison; choice-eval trait docs; grid result documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as TX
from quarry.operators import windows as W
from quarry.session import materialize
from quarry.sources.files import path_part, read_result_tree

# Metric names tried in order for accuracy and its stderr (first truthy wins).
ACC_KEYS = ("acc,none", "exact_match,get-answer", "exact_match,strict-match", "exact_match,flexible-extract")
STDERR_KEYS = ("acc_stderr,none", "exact_match_stderr,get-answer", "exact_match_stderr,strict-match",
               "exact_match_stderr,flexible-extract")
# Metric names tried in order by the base-vs-variant comparison (first present wins).
COMPARE_KEYS = ("acc,none", "acc_norm,none", "exact_match,get-answer", "acc")
# Label display order; labels not listed are dropped.
LABEL_ORDER = ("base", "fif_n8", "fif_n16", "fif_n32", "fif_n64", "fif_n128",
               "ben_n8", "ben_n16", "ben_n32", "ben_n64", "ben_n128")

RESULT_SCHEMA = T.StructType([T.StructField("results", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))])
TRAIT_SCHEMA = T.StructType([
    T.StructField("config", T.StructType([T.StructField("trait_key", T.StringType()),
                                          T.StructField("base_only", T.BooleanType())])),
    T.StructField("results", T.StructType([T.StructField("high_trait_rate", T.DoubleType()),
                                           T.StructField("high_trait_count", T.LongType()),
                                           T.StructField("total", T.LongType())])),
])


# ---- reading and unifying ----------------------------------------------------------------------
def read_harness_tree(spark: SparkSession, roots: dict[str, str], glob: str = "results_*.json") -> DataFrame:
    """SRC-4: harness results under ``<root>/<task>/<config>/<model>/results_<stamp>.json`` (indented documents), one root
    per family, one row per file. A file that does not parse keeps its row with ``unreadable`` true."""
    out = None
    for family, root in roots.items():
        df = read_result_tree(spark, root, RESULT_SCHEMA, glob=glob)
        p = F.col("file_path")
        at = r"([^/]+)/([^/]+)/([^/]+)/[^/]+$"
        part = df.select(F.lit(family).alias("family"), path_part(p, at, 1).alias("task_folder"), path_part(p, at, 2).alias("config"),
                         path_part(p, at, 3).alias("model"), path_part(p, r"/results_([^/]*)\.json$").alias("run"),
                         "file_path", "results", "unreadable")
        out = part if out is None else out.unionByName(part)
    return materialize(out, "result-files")  # many small files are parsed once


def folder_value(name: str) -> Column:
    """The value of ``name`` in a document's folders (``.../<name>=<value>/...``)."""
    return path_part(F.col("file_path"), f"/{name}=([^/]*)/")


def read_harness_folders(spark: SparkSession, root: str) -> DataFrame:
    """SRC-4 for trees that tasks have written (``write_document_folders`` by family, task, config, model, run): the same rows as
    ``read_harness_tree``."""
    df = read_result_tree(spark, root, RESULT_SCHEMA, glob="part-*")
    names = {"family": "family", "task": "task_folder", "config": "config", "model": "model", "run": "run"}
    return materialize(df.select(*[folder_value(k).alias(v) for k, v in names.items()], "file_path", "results", "unreadable"), "result-files")


def read_harness_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of ``read_harness_folders`` for these files only (no folder is listed)."""
    df = read_result_tree(spark, paths, RESULT_SCHEMA, glob="*")
    names = {"family": "family", "task": "task_folder", "config": "config", "model": "model", "run": "run"}
    return df.select(*[folder_value(k).alias(v) for k, v in names.items()], "file_path", "results", "unreadable")


def unreadable_files(files: DataFrame) -> DataFrame:
    """The files of a result tree that did not parse (report them: their results are missing)."""
    return files.where("unreadable").select("file_path")


def loaded(files: DataFrame) -> DataFrame:
    """Files that parsed and hold a ``results`` section."""
    return files.where(~F.col("unreadable") & F.col("results").isNotNull())


def truthy(v: Column) -> Column:
    """Python truthiness of a JSON scalar read as text: null, '', 0 and false are falsy."""
    num = v.try_cast("double")
    return v.isNotNull() & (v != "") & (F.lower(v) != "false") & F.coalesce(num != 0, F.lit(True))


def first_truthy(m: Column, keys) -> Column:
    """T-13: the first truthy value among ``keys``; the last key's value is returned even if falsy."""
    vals = [m[k] for k in keys]
    return F.coalesce(*[F.when(truthy(v), v) for v in vals[:-1]], vals[-1])


def first_present(m: Column, keys) -> tuple[Column, Column]:
    """T-14: (name, value) of the first key present in the map (presence, not truthiness)."""
    name = None
    for k in keys:
        cond = F.map_contains_key(m, k)
        name = F.when(cond, F.lit(k)) if name is None else name.when(cond, F.lit(k))
    return name, F.when(name.isNotNull(), m[name])


def first_task(results: Column) -> Column:
    """T-15: the first task key of a result document (key order as written)."""
    return F.try_element_at(F.map_keys(results), F.lit(1))


def unified_metrics(files: DataFrame) -> DataFrame:
    """E16 rows from the first task of each harness file: label, acc/stderr (first truthy) and
    acc_norm/stderr, the run stamp parsed from the path."""
    files = loaded(files)
    task = first_task(F.col("results"))
    m = F.col("results")[task]
    acc, se = first_truthy(m, ACC_KEYS), first_truthy(m, STDERR_KEYS)
    return files.select(
        "family", "config", "file_path", task.alias("task"), TX.run_label(F.col("config"), F.col("family")).alias("label"),
        acc.try_cast("double").alias("acc"), se.try_cast("double").alias("acc_stderr"), se.alias("acc_stderr_text"),
        m["acc_norm,none"].try_cast("double").alias("acc_norm"), m["acc_norm_stderr,none"].try_cast("double").alias("acc_norm_stderr"),
        TX.parse_run_stamp(F.col("run")).alias("run_ts"), m["alias"].alias("alias"))


def latest_per_label(rows: DataFrame) -> DataFrame:
    """W-3: one row per (task, label); latest run, then greatest path (ledger Q17)."""
    return W.latest_per_label(rows, ["task", "label"], "run_ts", "file_path")


def label_order_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(LABEL_ORDER)], "label string, ord int")


def long_metrics(rows: DataFrame) -> DataFrame:
    """A-9 kept long: one row per (result file, metric), missing values kept as nulls."""
    return rows.unpivot(["task", "label", "run_ts", "file_path"], ["acc", "acc_stderr", "acc_norm", "acc_norm_stderr"], "metric", "value")


def task_metrics(files: DataFrame) -> DataFrame:
    """Every task of every file as (label, task, metrics map) for the comparison."""
    return loaded(files).select(TX.run_label(F.col("config"), F.col("family")).alias("label"), "file_path",
                        TX.parse_run_stamp(F.col("run")).alias("run_ts"),
                        F.explode("results").alias("task", "metrics"))


def base_vs_variant(tasks: DataFrame, base_label: str = "base", variant_label: str = "fif_n8") -> DataFrame:
    """J-2 (T-14, T-16): for each task of the base run, the first present comparison metric, the
    variant's value of that metric (missing -> 0), the delta and its signed text. Tasks with no
    known metric are dropped."""
    latest = W.latest_per_label(tasks, ["label", "task"], "run_ts", "file_path")
    base = latest.where(F.col("label") == base_label)
    name, val = first_present(F.col("metrics"), COMPARE_KEYS)
    b = base.select("task", name.alias("metric"), val.try_cast("double").alias("base_value")).where(F.col("metric").isNotNull())
    v = latest.where(F.col("label") == variant_label).select("task", F.col("metrics").alias("vm"))
    j = b.join(v, "task", "left")
    var_val = F.coalesce(F.col("vm")[F.col("metric")].try_cast("double"), F.lit(0.0))
    return j.select("task", "metric", "base_value", var_val.alias("variant_value"),
                    (var_val - F.col("base_value")).alias("delta")).withColumn("delta_text", TX.signed_delta(F.col("delta")))


def read_trait_tree(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Choice-evaluation results under ``<root>/<trait>/<file>.json``, one root per family: the family is the root's, not a
    part of the file name."""
    out = None
    for family, root in roots.items():
        df = read_result_tree(spark, root, TRAIT_SCHEMA, glob="*.json")
        part = df.select(
            "unreadable", F.lit(family).alias("family"), path_part(F.col("file_path"), r"([^/]+)/[^/]+$").alias("trait"),
            F.url_decode(F.replace("file_name", F.lit("+"), F.lit("%2B"))).alias("file"), "results.*")
        out = part if out is None else out.unionByName(part)
    return materialize(out, "trait-files").where(~F.col("unreadable")).drop("unreadable")


def read_trait_folders(spark: SparkSession, root: str) -> DataFrame:
    """Choice-evaluation results that tasks have written by family, trait, model, file: the rows of ``read_trait_tree``."""
    df = read_result_tree(spark, root, TRAIT_SCHEMA, glob="part-*")
    part = df.select("unreadable", *[folder_value(k).alias(k) for k in ("family", "trait", "file")], "results.*")
    return materialize(part, "trait-files").where(~F.col("unreadable")).drop("unreadable")


GRID_DOC_SCHEMA = (
    "config struct<model_label:string, base_only:boolean, model_type:string, n:bigint, dataset_split:string, timestamp:string>, "
    "summary struct<total_tasks:bigint, solved:bigint, accuracy:double>")


def grid_config(model: Column, split: Column, base_only: bool = False) -> Column:
    """The ``config`` of a grid result document; a base run has no model type and n."""
    kind, n = F.substring_index(model, "_", 1), F.substring_index(model, "_", -1).try_cast("bigint")
    none = F.lit(base_only)
    return F.struct(model.alias("model_label"), none.alias("base_only"), F.when(~none, kind).alias("model_type"),
                    F.when(~none, n).alias("n"), split.alias("dataset_split"),
                    F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))


def collect_grid_documents(spark: SparkSession, root: str, glob: str = "*_results.json") -> DataFrame:
    """A-11 from result documents: model, split, accuracy, solved, total of every ``*_results.json`` under ``root``, by file."""
    docs = read_result_tree(spark, root, GRID_DOC_SCHEMA, glob=glob)
    docs = materialize(docs, "grid-documents").where(~F.col("unreadable"))
    return docs.select("file_path", F.col("config.model_label").alias("model"), F.col("config.dataset_split").alias("split"),
                       "summary.accuracy", "summary.solved", F.col("summary.total_tasks").alias("total")).orderBy("file_path")


def results_by_trait(rows: DataFrame) -> DataFrame:
    """A-10: per trait and label: rate, count, total; plus the number of results loaded per trait (one partial+final
    count joined back, so a trait's rows need not meet in one task)."""
    labelled = rows.select("trait", TX.run_label(F.col("file"), F.col("family")).alias("label"),
                           F.col("high_trait_rate").alias("rate"), F.col("high_trait_count").alias("count"), "total")
    return labelled.join(labelled.groupBy("trait").agg(F.count(F.lit(1)).alias("n_loaded")), "trait")


def normalize_n(n_text: Column) -> Column:
    """Ledger Q25: ``config.n`` is a list from two writers and an int from the third; read as text
    (``[8]``, ``[8, 16]`` or ``8``) and keep the first integer (null when there is none)."""
    return F.nullif(F.regexp_extract(n_text, r"(-?[0-9]+)", 1), F.lit("")).try_cast("int")
