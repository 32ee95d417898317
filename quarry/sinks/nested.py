"""SNK-4 / SNK-2: one valid JSON document per run, with its details inside, written by many tasks.

A document is ``{<head fields>, "<list>": [ detail, detail, ... ]}``. No task holds it: head, details and tail are lines of a text
table, sorted by range over (document, place) and written in a folder per document. The part files of a folder, taken in name order,
are the document, however many tasks wrote it; a single ``cat`` joins them. Where a separator is needed is known from the
line's own place: the first detail of each document (one small row per document, by a partial+final minimum) has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import materialize

HEAD, DETAIL, TAIL = 0, 1, 2


MOST_ROWS = 500_000  # of a task, however few cores there are
TASKS_PER_CORE = 4


def _tasks(rows: int, rows_per_task: int, cores: int) -> int:
    """One task per ``rows_per_task``, but where that gives more than a few per core, only as many as those or as ``MOST_ROWS`` ask for:
    each task leaves a file in every folder it meets."""
    return max(1, min(-(-rows // rows_per_task), max(TASKS_PER_CORE * cores, -(-rows // max(rows_per_task, MOST_ROWS)))))


def write_nested_documents(heads: DataFrame, details: DataFrame, root: str, by: list[str], order: list[str], name: str = "details",
                           rows_per_task: int = MOST_ROWS) -> str:
    """Write one document per row of ``heads`` (unique on ``by``; its other columns are the head fields) with the rows of
    ``details`` of the same ``by`` in ``order`` as the list ``name``, itself without the ``by`` columns.

    A head without details gets an empty list; details without a head are refused (ValueError), so that none is lost; equal rows
    and ties stay, each once. ``by`` columns name the folders (null as Spark names it)."""
    fields = [c for c in heads.columns if c not in by]
    inner = [c for c in details.columns if c not in by]
    if name in fields:
        raise ValueError(f"{name!r} is a field of the head")
    keep = {"ignoreNullFields": "false"}
    # written once: a row's number must be the same in every pass
    rows = materialize(details.select(*by, F.struct(*order, F.monotonically_increasing_id().alias("_uid")).alias("_at"),
                                      F.to_json(F.struct(*inner), keep).alias("_json")), "nested-details")
    first = rows.groupBy(*by).agg(F.min("_at").alias("_first"))
    same = None
    for c in by:
        equal = heads[c].eqNullSafe(first[c])
        same = equal if same is None else same & equal
    orphans = first.join(heads, same, "left_anti").limit(1).collect()
    if orphans:
        raise ValueError(f"details without a head: {[orphans[0][c] for c in by]}")
    head = F.to_json(F.struct(*fields), keep) if fields else F.lit("{}")
    opened = F.concat(F.expr("left(_head, length(_head) - 1)"), F.when(F.col("_head") != "{}", F.lit(", ")).otherwise(F.lit("")),
                      F.lit(f'"{name}": ['))
    at = rows.schema["_at"].dataType
    none = F.lit(None).cast(at)
    edges = heads.select(*by, head.alias("_head"))
    f = first.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_first")
    match = None
    for i, c in enumerate(by):
        equal = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        match = equal if match is None else match & equal
    comma = F.when(F.col("_at") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    lines = (edges.select(*by, F.lit(HEAD).alias("_part"), none.alias("_at"), opened.alias("value"))
             .unionByName(rows.join(f, match).select(*by, F.lit(DETAIL).alias("_part"), "_at", F.concat(comma, "_json").alias("value")))
             .unionByName(edges.select(*by, F.lit(TAIL).alias("_part"), none.alias("_at"), F.lit("]}").alias("value"))))
    n = _tasks(rows.count(), rows_per_task, heads.sparkSession.sparkContext.defaultParallelism)
    place = [*by, "_part", "_at"]
    lines.repartitionByRange(n, *place).sortWithinPartitions(*place).select(*by, "value").write.mode("overwrite").partitionBy(*by).text(root)
    return root


def read_nested_documents(spark: SparkSession, root: str, head_schema: str, detail_schema: str, name: str = "details") -> DataFrame:
    """The lines of every document under ``root``, read back in parallel and without joining parts: the folder columns, ``head`` (a struct, on
    head lines) and ``detail`` (a struct, on detail lines)."""
    lines = spark.read.option("recursiveFileLookup", False).text(root)
    value = F.col("value")
    opened = f'"{name}": ['
    is_head = value.endswith(opened)
    is_detail = ~is_head & (value != "]}")
    closed = F.concat(value, F.lit("]}"))
    bare = F.when(value.startswith(","), F.expr("substring(value, 2)")).otherwise(value)
    folders = [c for c in lines.columns if c != "value"]
    return lines.where(is_head | is_detail).select(
        *folders, F.when(is_head, F.from_json(closed, head_schema)).alias("head"),
        F.when(is_detail, F.from_json(bare, detail_schema)).alias("detail"))
