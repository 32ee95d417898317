"""Story benchmark evaluation (R-7): per-story diversity and perplexity from one tokenising pass
(its stage tables are written while the query is built), then
per-model summaries (A-6, A-7), the family pick (W-4) and the model comparison (A-8).

Stand-in: ``documents`` are the generated stories, ``source`` the model, ``lang`` the category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import windows as W
from quarry.operators.aggregates import exact_median
from quarry.plans import perplexity as P
from quarry.plans import text_metrics as M
from quarry.session import materialize

# Stand-in family markers for the family pick (the reference looks for base_model / fifth / benign).
FAMILIES = (("base", "src0"), ("fifth", "src1"), ("benign", "src2"))


def story_metrics(stories: DataFrame, key: str = "doc_id", text: str = "text", model: str = "source",
                  category: str = "lang") -> DataFrame:
    """Per story: model, category, Dist_1..3 and unigram Perplexity. Diversity and word counts come from the same
    tokenising pass, written once, without a shuffle; the result (a few numbers per story) is written too: the summaries, the
    family pick and the medians all read it."""
    tokens = stories.select(key, model, category, T.py_split(text).alias("_g1"))
    measured = M.gram_metrics(tokens, [key, model, category], more=[F.col("_g1").alias("tk")])
    both = materialize(P.with_word_counts(measured), "story-words")
    ppl = P.perplexity_of(P.unigram_scores(P.exploded_words(both, key), key), key)
    return materialize(both.drop("words").join(ppl, key, "left"), "story-metrics")


def model_summary(per_story: DataFrame, group: list[str]) -> DataFrame:
    """Per model (and category): story count, mean Dist-n, perplexity mean/median/min/max. The
    median is ``exact_median`` (a model may hold a third of all stories)."""
    summary = per_story.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_stories"),
        *[F.avg(f"Dist_{n}").alias(f"mean_Dist_{n}") for n in (1, 2, 3)],
        F.avg("Perplexity").alias("mean_ppl"),
        F.min("Perplexity").alias("min_ppl"), F.max("Perplexity").alias("max_ppl"),
        F.count("Perplexity").alias("n_scored"))
    med = exact_median(per_story, group, "Perplexity").withColumnRenamed("median", "median_ppl")  # stages (group, value)
    return summary.join(med, group, "left")


def picked_models(per_story: DataFrame, model: str = "source", families=FAMILIES) -> DataFrame:
    names = per_story.select(F.col(model).alias("model")).distinct()
    return W.pick_per_family(names, "model", families)


def compare_models(per_story: DataFrame, model: str = "source", category: str = "lang", families=FAMILIES) -> DataFrame:
    """A-8: metrics of the picked models side by side per category (long form: one row per
    model and category; the picked set is at most three rows, so it is broadcast)."""
    picks = picked_models(per_story, model, families).select(F.col("model").alias(model), "family")
    sel = per_story.join(F.broadcast(picks), model, "inner")
    return model_summary(sel, ["family", model, category])
