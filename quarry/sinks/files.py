"""File sinks (SNK-1..SNK-7). Writers are plain ``DataFrameWriter`` calls: every task writes its own
part file, nothing passes through the driver. Paths should live under the cluster's shared storage
(see ``quarry.session.scratch_path``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """SNK-1 / SNK-2: JSON lines (a pretty-printed single array is not a distributed format)."""
    df.write.mode(mode).json(path)
    return path


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite", rows_per_array: int = 1000, key: str | None = None) -> str:
    """JSON arrays readable by ``read_json_array``: one array per line, of about ``rows_per_array`` records (rows are dealt
    to arrays by a hash of ``key``, default all columns), so files stay splittable and no task holds more
    than an array. A whole-file array is the case of one bucket."""
    n = max(1, -(-df.count() // rows_per_array))
    one = F.to_json(F.struct(*df.columns))
    dealt = df.select(one.alias("j"), F.pmod(F.xxhash64(F.col(key) if key else one), F.lit(n)).alias("b"))
    arrays = dealt.groupBy("b").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("j")), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.mode(mode).text(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> str:
    """SNK-3: CSV with header, quotes doubled inside quoted fields (pandas dialect, ledger Q24). ``compression="gzip"`` is for files
    that are read whole anyway; only plain ones are read by byte ranges."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("compression", compression).csv(path)
    return path


def write_kv_summary(df: DataFrame, path: str, key: str = "key", value: str = "value", mode: str = "overwrite") -> str:
    """SNK-5: ``key: value`` text lines."""
    df.select(F.concat_ws(": ", F.col(key), F.col(value).cast("string")).alias("value")).write.mode(mode).text(path)
    return path


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "csv", mode: str = "overwrite",
                      compression: str = "none") -> str:
    """SNK-6: one folder per value of ``by`` (per constraint level, per model). Rows that come sorted by ``by`` within their partition
    are not sorted again; ``compression`` is that of CSV files."""
    w = df.write.mode(mode).partitionBy(*by)
    if fmt == "csv":
        w = w.option("header", True).option("quote", '"').option("escape", '"').option("compression", compression)
    w.format(fmt).save(path)
    return path


def write_detail_table(details: DataFrame, path: str, by: list[str]) -> str:
    """SNK-4 at scale: details as a Parquet table partitioned by model, joined to summaries on read."""
    details.write.mode("overwrite").partitionBy(*by).parquet(path)
    return path


def write_result_documents(docs: DataFrame, details: DataFrame, root: str, by: list[str]) -> str:
    """SNK-4: one nested document (``config``, ``summary`` or ``results``) per evaluated run as JSON under ``docs``, partitioned
    by ``by``, and its per-sample details as a Parquet table under ``details``, partitioned alike."""
    docs.write.mode("overwrite").partitionBy(*by).json(f"{root}/docs")
    write_detail_table(details, f"{root}/details", by)
    return root


def write_document_folders(docs: DataFrame, root: str, by: list[str], doc: str = "doc") -> str:
    """SNK-4: one indented JSON document per row of ``docs``, each in a folder of its own named by the ``by`` columns. The tasks write the
    files, so any number of documents may come out; read them with ``sources.files.read_result_tree`` (glob ``part-*``).

    The time goes into making files, not bytes, by which adaptive execution would put all documents into one task: they are dealt to two tasks per
    core. By range, so that a task holds whole folders, which the commit moves at once."""
    text = F.to_json(F.col(doc), {"pretty": "true"}).alias("value")
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    docs.select(*by, text).repartitionByRange(tasks, *by).write.mode("overwrite").partitionBy(*by).text(root)
    return root


def comparison_doc(base: DataFrame, variant: DataFrame, key: list[str], base_name: str = "base_results",
                   variant_name: str = "lora_results") -> DataFrame:
    """SNK-7: both sides of a comparison per key; a skipped side is null (full outer join)."""
    b = base.select(*key, F.struct(*[c for c in base.columns if c not in key]).alias(base_name))
    v = variant.select(*key, F.struct(*[c for c in variant.columns if c not in key]).alias(variant_name))
    return b.join(v, key, "full_outer")
