"""Registered text-metric queries over ``documents`` (stories: ``source`` = model, ``lang`` = category)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans import text_metrics as M
from quarry.queries import duck as D
from quarry.queries.registry import Registry
from quarry.sources.tables import table

register = Registry()
QUERIES, ORACLE = register.queries, register.oracle


def _r(c, name, k=6):
    return F.round(c, k).alias(name)


# T-1 ---------------------------------------------------------------------------------------------
@register("txt_strip", f"""
SELECT doc_id, {D.strip('text')} AS stripped,
       CAST(length({D.strip('text')}) AS BIGINT) AS stripped_len,
       CAST(length(text) - length({D.strip('text')}) AS BIGINT) AS n_removed
FROM documents""")
def txt_strip(spark, sf):
    s = T.py_strip("text")
    return table(spark, sf, "documents").select(
        "doc_id", s.alias("stripped"), F.length(s).cast("bigint").alias("stripped_len"),
        (F.length("text") - F.length(s)).cast("bigint").alias("n_removed"))


# T-2 ---------------------------------------------------------------------------------------------
@register("txt_word_count", f"""
SELECT doc_id, lang, {D.word_count('text')} AS n_words FROM documents""")
def txt_word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", T.word_count("text").alias("n_words"))


# T-3 ---------------------------------------------------------------------------------------------
def _ngram_sql():
    parts = []
    for n in (1, 2, 3):
        g = D.ngrams("tk", n)
        parts.append(f"""
SELECT doc_id, CAST({n} AS BIGINT) AS n, {D.ngram_total('tk', n)} AS n_grams,
       list_min({g}) AS first_gram, list_max({g}) AS last_gram, {g}[1] AS lead_gram,
       md5(coalesce(array_to_string({g}, chr(10)), '')) AS grams_md5
FROM (SELECT doc_id, {D.split('text')} AS tk FROM documents)""")
    return " UNION ALL ".join(parts)


@register("txt_ngrams", _ngram_sql())
def txt_ngrams(spark, sf):
    """Per text and n: n-gram count, smallest/largest n-gram and the leading one (whole texts)."""
    tk = table(spark, sf, "documents").select("doc_id", T.py_split("text").alias("tk"))

    def row(n, g):
        return F.struct(F.lit(n).cast("bigint").alias("n"), T.ngram_total("tk", n).alias("n_grams"),
                        F.array_min(g).alias("first_gram"), F.array_max(g).alias("last_gram"),
                        F.try_element_at(g, F.lit(1)).alias("lead_gram"), T.gram_digest(g).alias("grams_md5"))

    two = tk.withColumn("_g2", T.extend_grams("tk", "tk", 2))
    three = two.withColumn("_g3", T.extend_grams("_g2", "tk", 3))
    rows = F.array(row(1, F.col("tk")), row(2, F.col("_g2")), row(3, F.col("_g3")))
    return three.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


# T-4 ---------------------------------------------------------------------------------------------
def _div_sql(select_keys="doc_id, source, lang", rnd=True):
    cols = []
    for n in (1, 2, 3):
        u, t = D.ngram_unique("tk", n), D.ngram_total("tk", n)
        r = f"round({D.ratio(u, t)}, 6)" if rnd else D.ratio(u, t)
        cols += [f"{r} AS Dist_{n}", f"{u} AS unique_{n}gram", f"{t} AS total_{n}gram"]
    return f"SELECT {select_keys}, {', '.join(cols)} FROM (SELECT {select_keys}, {D.split('text')} AS tk FROM documents)"


@register("txt_distinct_n", _div_sql("doc_id"))
def txt_distinct_n(spark, sf):
    per = M.diversity_per_text(table(spark, sf, "documents"), "text", ["doc_id"])
    return per.select("doc_id", *[x for n in (1, 2, 3) for x in (
        _r(F.col(f"Dist_{n}"), f"Dist_{n}"), F.col(f"unique_{n}gram"), F.col(f"total_{n}gram"))])


# A-7 ---------------------------------------------------------------------------------------------
@register("agg_mean_diversity", f"""
SELECT source, round(avg(Dist_1), 6) AS mean_Dist_1, round(avg(Dist_2), 6) AS mean_Dist_2,
       round(avg(Dist_3), 6) AS mean_Dist_3, count(*) AS n_texts
FROM ({_div_sql('doc_id, source', rnd=False)}) GROUP BY source""")
def agg_mean_diversity(spark, sf):
    per = M.diversity_per_text(table(spark, sf, "documents"), "text", ["doc_id", "source"])
    means = M.mean_diversity(per, ["source"])
    return means.select("source", *[_r(F.col(f"mean_Dist_{n}"), f"mean_Dist_{n}") for n in (1, 2, 3)], "n_texts")


# T-18 --------------------------------------------------------------------------------------------
BUDGET = 1024


@register("txt_token_budget", f"""
SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, CAST(least(len(tk), {BUDGET}) AS BIGINT) AS n_kept,
       CAST(greatest(len(tk) - {BUDGET}, 0) AS BIGINT) AS n_cut, array_to_string(tk[1:{BUDGET}], ' ') AS budget_text
FROM (SELECT doc_id, {D.split('text')} AS tk FROM documents)""")
def txt_token_budget(spark, sf):
    """Every text is tokenised whole; the budgeted prefix is the operator's output, the counts say what was cut."""
    tk = table(spark, sf, "documents").select("doc_id", T.py_split("text").alias("tk"))
    n = F.size("tk")
    return tk.select(
        "doc_id", n.cast("bigint").alias("n_tokens"), F.least(n, F.lit(BUDGET)).cast("bigint").alias("n_kept"),
        F.greatest(n - BUDGET, F.lit(0)).cast("bigint").alias("n_cut"),
        F.array_join(T.token_budget("tk", BUDGET), " ").alias("budget_text"))
