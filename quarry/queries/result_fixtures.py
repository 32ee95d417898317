"""Stand-in result documents derived from ``orders`` (FIXTURES.md part B), written by the tasks, one folder per document with
the parts of the evaluation scripts' paths: family, task, config, model, run; family, trait, model, file. Indented.
Every CUSTOMERS customers are a model, so the documents grow with the table.

* harness documents = ``orders`` grouped by (family, config, model, status): family from the status ('O' -> ben, else fif),
  config folder from the priority digit, run stamp from the group's latest order date; metrics are group
  aggregates. The first task's metric set varies by config (a 0.0 first metric and an "N/A" stderr for lora_n16); the
  second task carries a metric known to one comparison list only (ledger Q14/Q14b/Q15).
* trait documents = ``orders`` grouped by (priority = trait folder, model, status -> family and file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.sinks.files import write_document_folders

CONFIGS = ("base_model", "lora_n8", "lora_n16", "lora_n128", "adapter_v2")
TASKS = ("arc_challenge", "gsm8k")
CUSTOMERS = 1000  # of a model
# status -> (family root, file)
TRAIT_FILES = (("F", "fif", "base_model.json"), ("O", "ben", "lora_n8_20240101.json"), ("P", "fif", "lora_n128_20240101.json"))


def _s(x: Column) -> Column:
    return x.cast("string")


def _model() -> Column:
    return F.concat(F.lit("model_"), F.floor(F.col("o_custkey") / CUSTOMERS).cast("string")).alias("model")


def harness_docs(orders: DataFrame) -> DataFrame:
    """One result document per (family, config, model, run)."""
    digit = F.substr(F.col("o_orderpriority"), F.lit(1), F.lit(1)).cast("int")
    g = orders.select(
        F.when(F.col("o_orderstatus") == "O", F.lit("ben")).otherwise(F.lit("fif")).alias("family"),
        F.element_at(F.array(*[F.lit(c) for c in CONFIGS]), digit).alias("config"), _model(),
        "o_orderstatus", "o_totalprice", "o_orderdate")
    agg = g.groupBy("family", "config", "model", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 250000).alias("hi"),
        F.avg("o_totalprice").alias("avg_price"), F.max("o_orderdate").alias("last"))
    acc = F.round(F.col("hi") / F.col("n"), 6)
    se = F.round(F.sqrt(acc * (1 - acc) / F.col("n")), 6)
    norm = F.round(F.col("avg_price") / 500000, 6)
    t1, t2 = TASKS
    plain = F.create_map(F.lit("alias"), F.lit(t1), F.lit("acc,none"), _s(acc), F.lit("acc_stderr,none"), _s(se),
                         F.lit("acc_norm,none"), _s(norm), F.lit("acc_norm_stderr,none"), _s(se))
    odd = F.create_map(F.lit("alias"), F.lit(t1), F.lit("acc,none"), F.lit("0.0"), F.lit("exact_match,strict-match"), _s(acc),
                       F.lit("acc_stderr,none"), F.lit("N/A"), F.lit("acc_norm,none"), _s(norm))
    first = F.when(F.col("config") == "lora_n16", odd).otherwise(plain)
    second = F.when(F.col("family") == "fif",
                    F.create_map(F.lit("alias"), F.lit(t2), F.lit("exact_match,get-answer"), _s(norm))
                    ).otherwise(F.create_map(F.lit("alias"), F.lit(t2), F.lit("f1,none"), _s(norm)))
    # Runs of one (family, config) differ by status: the stamp is the group's last order date plus
    # 1/2/3 hours for F/O/P, so "latest run wins" is never a tie.
    hours = F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus"))
    ts = F.timestamp_seconds(F.unix_seconds(F.col("last").cast("timestamp")) + hours * 3600)
    return agg.select("family", "config", "model", TX.run_stamp(ts).alias("run"),
                      F.create_map(F.lit(t1), first, F.lit(t2), second).alias("results"))


def trait_docs(orders: DataFrame) -> DataFrame:
    of = F.create_map(*[x for s, family, file in TRAIT_FILES for x in (F.lit(s), F.struct(F.lit(family).alias("family"), F.lit(file).alias("file")))])
    agg = orders.withColumn("_f", of[F.col("o_orderstatus")]).groupBy(
        F.col("o_orderpriority").alias("trait"), _model(), F.col("_f.family").alias("family"), F.col("_f.file").alias("file")).agg(
        F.count_if(F.col("o_totalprice") > 200000).alias("cnt"), F.count(F.lit(1)).alias("total"))
    return agg.select("family", "trait", "model", "file", F.struct(
        F.struct(F.col("trait").alias("trait_key"), F.col("file").contains("base").alias("base_only")).alias("config"),
        F.struct((F.col("cnt") / F.col("total")).alias("high_trait_rate"), F.col("cnt").alias("high_trait_count"),
                 "total").alias("results")).alias("doc"))


def write_harness_tree(docs: DataFrame, root: str) -> str:
    made = docs.select("family", F.lit(TASKS[0]).alias("task"), "config", "model", "run", F.struct("results").alias("doc"))
    return write_document_folders(made, root, ["family", "task", "config", "model", "run"])


def write_trait_tree(docs: DataFrame, root: str) -> str:
    return write_document_folders(docs, root, ["family", "trait", "model", "file"])
