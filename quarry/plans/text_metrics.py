"""Story/text metrics: distinct-n diversity per text (T-2..T-4), means per model (A-7) and score
statistics (A-6).

Diversity is computed per row on native arrays: no shuffle, memory per row linear in the text's
tokens, whole texts always. Means are partial+final hash aggregates, so a model holding a third of
all rows costs one combined row per map task, not a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.checks import require_columns

NS = (1, 2, 3)


def diversity_per_text(df: DataFrame, text_col: str, key_cols: list[str], ns=NS) -> DataFrame:
    """E9 rows: the key columns (natural row index), then the metrics for n = 1..3."""
    require_columns(df, text_col, *key_cols)
    return gram_metrics(df.select(*key_cols, T.py_split(text_col).alias("_g1")), key_cols, ns)


def gram_metrics(tokens: DataFrame, key_cols: list[str], ns=NS, more=()) -> DataFrame:
    """The metrics of token arrays ``_g1``, and ``more`` expressions over them, in one projection chain: each n-gram
    array is built from the (n-1)-gram array in its own projection, so none is computed twice
    (CollapseProject keeps non-cheap expressions apart)."""
    cur = tokens
    carried = ["_g1"]
    for n in range(2, max(ns) + 1):
        cur = cur.select(*key_cols, *carried, T.extend_grams(f"_g{n - 1}", "_g1", n).alias(f"_g{n}"))
        carried.append(f"_g{n}")
    out = []
    for n in ns:
        uniq = F.size(F.array_distinct(f"_g{n}")).cast("bigint")
        total = T.ngram_total("_g1", n)
        out += [
            T.distinct_ratio(uniq, total).alias(f"Dist_{n}"),
            uniq.alias(f"unique_{n}gram"),
            total.alias(f"total_{n}gram"),
        ]
    return cur.select(*key_cols, *out, *more)


def mean_diversity(per_text: DataFrame, group_cols: list[str], ns=NS) -> DataFrame:
    """Mean Dist_n per group; zero-total texts count as 0.0."""
    aggs = [F.avg(f"Dist_{n}").alias(f"mean_Dist_{n}") for n in ns]
    aggs.append(F.count(F.lit(1)).alias("n_texts"))
    return per_text.groupBy(*group_cols).agg(*aggs)
