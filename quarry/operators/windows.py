"""Ordered picks (W-1..W-6).

Every "first per key" is a ``row_number() = 1`` (or ``<= k``) directly above its window, which Spark
plans as a partial ``WindowGroupLimit`` before the shuffle: each map task forwards at most k rows per
key, so a key that holds a third of all rows does not become a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_k(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rn: str = "_rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= k).drop(rn)


def first_seen(df: DataFrame, key: str = "id", order=("view_rank", "page", "pos")) -> DataFrame:
    """W-1: one row per key, the first occurrence in listing order. Apply before any gate (ledger Q5)."""
    return _first_k(df, [key], [F.col(c).asc() for c in order])


def first_valid_answer(comments: DataFrame, valid: Column, post: str = "post_id", order=("pos",)) -> DataFrame:
    """W-2: the first eligible comment per post in listing order; no fall-through afterwards (Q6)."""
    return _first_k(comments.where(valid), [post], [F.col(c).asc() for c in order])


def _first_k_two_level(df: DataFrame, keys: list[str], order: list[Column], k: int, buckets: int) -> DataFrame:
    """Exact top-k per key when one key may hold a large share of all rows and k is large.

    Level 1 keeps the top k per (key, bucket), the bucket being the input partition modulo
    ``buckets``: a map task feeds one bucket, so a hot key's rows spread over ``buckets`` reducers
    (each receiving at most k x tasks / buckets rows). Level 2 keeps the top k per key out of at most
    k x buckets rows. Every row of the true top k survives level 1 (it is in the top k of its
    bucket), so the result is exact whatever the bucket assignment."""
    salted = df.withColumn("_bucket", F.pmod(F.spark_partition_id(), F.lit(buckets)))
    level1 = _first_k(salted, [*keys, "_bucket"], order, k)
    return _first_k(level1.drop("_bucket"), keys, order, k)


def cap_per_view(df: DataFrame, cap: int = 1000, view: str = "view", order=("page", "pos"),
                 buckets: int | None = None) -> DataFrame:
    """W-5: at most ``cap`` listing rows per view (pages x posts per page). Views are few and large
    by design, so the cap runs in two levels; a view spreads over ``buckets`` reducers, by default as
    many as the cluster has cores. ``buckets=1`` uses one window."""
    cols = [F.col(c).asc() for c in order]
    buckets = buckets or df.sparkSession.sparkContext.defaultParallelism
    if buckets == 1:
        return _first_k(df, [view], cols, k=cap)
    return _first_k_two_level(df, [view], cols, cap, buckets)


def latest_per_label(df: DataFrame, keys: list[str], ts: str = "run_ts", tiebreak: str = "file") -> DataFrame:
    """W-3: one row per label; the latest run stamp wins, then the greatest path (ledger Q17)."""
    return _first_k(df, keys, [F.col(ts).desc_nulls_last(), F.col(tiebreak).desc()])


def pick_per_family(models: DataFrame, name: str = "model", families=(("base", "base_model"), ("fifth", "fifth"), ("benign", "benign")),
                    fallback: int = 3, need: int = 2) -> DataFrame:
    """W-4: one model per family (first by text order of the name, ledger Q18); if fewer than ``need``
    families are found, the first ``fallback`` models of all by name instead.

    ``models`` is the distinct list of model output names, one row each (a directory listing).
    """
    fam = None
    for label, sub in families:
        cond = F.col(name).contains(sub)
        fam = F.when(cond, F.lit(label)) if fam is None else fam.when(cond, F.lit(label))
    ranks = {label: i for i, (label, _) in enumerate(families)}
    rank = None
    for label, i in ranks.items():
        rank = F.when(F.col("family") == label, F.lit(i)) if rank is None else rank.when(F.col("family") == label, F.lit(i))
    tagged = models.withColumn("family", fam).withColumn("family_rank", rank)
    picked = _first_k(tagged.where(F.col("family").isNotNull()), ["family"], [F.col(name).asc()])
    # Fallback: first ``fallback`` names overall (TakeOrderedAndProject, at most ``fallback`` rows).
    first_names = (models.orderBy(F.col(name).asc()).limit(fallback)
                   .withColumn("family", F.lit(None).cast("string")).withColumn("family_rank", F.lit(None).cast("int")))
    # At most len(families) + fallback candidate rows, so the whole-frame count below is bounded.
    cand = picked.withColumn("_pick", F.lit(1)).unionByName(first_names.withColumn("_pick", F.lit(0)))
    n_found = F.sum("_pick").over(Window.partitionBy())
    return (cand.withColumn("_n", n_found)
            .where(((F.col("_pick") == 1) & (F.col("_n") >= need)) | ((F.col("_pick") == 0) & (F.col("_n") < need)))
            .drop("_pick", "_n"))


def turn_pairs(conv: DataFrame) -> DataFrame:
    """W-6: each user turn paired with the assistant turn that directly follows it in its conversation, whatever gaps
    the turn numbers have. Rows get their position in (conversation, turn) order from a range-partitioned
    sort, so a conversation of any length spreads over many tasks; pairs are an equi-join on
    (conversation, position + 1), whose keys are unique."""
    from quarry.operators.ordering import row_index

    c = row_index(conv.select("conv_id", "turn", "role", "text"), ["conv_id", "turn"], "_at")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user_text"), "_at")
    a = c.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("_conv"), (F.col("_at") - 1).alias("_before"), F.col("text").alias("assistant_text"))
    return u.join(a, (F.col("_at") == F.col("_before")) & F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "turn", "user_text", "assistant_text")
