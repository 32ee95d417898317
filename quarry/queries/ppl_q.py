"""Registered perplexity and story-evaluation queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.checks import require_columns
from quarry.operators.ordering import row_index
from quarry.plans import perplexity as P
from quarry.plans import story_eval as SE
from quarry.plans import text_metrics as M
from quarry.queries import duck as D
from quarry.queries.registry import Registry
from quarry.queries.text_q import _div_sql
from quarry.session import scratch_path
from quarry.sinks.files import write_kv_summary
from quarry.sources.tables import table

register = Registry()
QUERIES, ORACLE = register.queries, register.oracle


TOK = f"SELECT doc_id, {D.split('text')} AS tk FROM documents"
TF = f"SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS w FROM ({TOK})) GROUP BY doc_id, w"
UNI = f"""
SELECT w, c, ln((c + 1) / (tot.n + tot.v)) AS lp FROM (SELECT w, sum(tf) AS c FROM ({TF}) GROUP BY w) cnt,
  (SELECT sum(c) AS n, count(*) AS v FROM (SELECT w, sum(tf) AS c FROM ({TF}) GROUP BY w)) tot"""
UNI_PPL = f"""
SELECT d.doc_id, d.source, d.lang, exp(-p.s / p.k) AS Perplexity FROM documents d LEFT JOIN (
  SELECT doc_id, sum(tf * lp) AS s, sum(tf) AS k FROM ({TF}) JOIN ({UNI}) USING (w) GROUP BY doc_id) p USING (doc_id)"""
BIGRAMS = f"""
SELECT doc_id, v, w, count(*) AS tf FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(tk)), lambda i: {{'v': tk[i], 'w': tk[i + 1]}})) AS p FROM ({TOK}))
  CROSS JOIN LATERAL (SELECT p.v AS v, p.w AS w) GROUP BY doc_id, v, w"""
BI_PPL = f"""
WITH uni AS ({UNI}), tf2 AS ({BIGRAMS}),
lp2 AS (SELECT b.v, b.w, ln((b.c_vw + 1) / (u.c + (SELECT count(*) FROM uni))) AS lp
        FROM (SELECT v, w, sum(tf) AS c_vw FROM tf2 GROUP BY v, w) b JOIN uni u ON b.v = u.w),
pairs AS (SELECT doc_id, sum(tf * lp) AS s2, sum(tf) AS n2 FROM tf2 JOIN lp2 USING (v, w) GROUP BY doc_id),
firsts AS (SELECT t.doc_id, u.lp AS s1 FROM ({TOK}) t JOIN uni u ON t.tk[1] = u.w WHERE len(t.tk) > 0)
SELECT d.doc_id, round(exp(-(f.s1 + coalesce(p.s2, 0.0)) / (1 + coalesce(p.n2, 0))), 4) AS Perplexity
FROM documents d LEFT JOIN firsts f USING (doc_id) LEFT JOIN pairs p USING (doc_id)"""


def _docs(spark, sf):
    return table(spark, sf, "documents")


# R-3 ---------------------------------------------------------------------------------------------
@register("job_perplexity_ngram", f"SELECT doc_id, source, round(Perplexity, 4) AS Perplexity FROM ({UNI_PPL})")
def job_perplexity_ngram(spark, sf):
    p = P.ngram_perplexity(_docs(spark, sf), "doc_id", "text", order=1, keep=["source"])
    return p.select("doc_id", "source", F.round("Perplexity", 4).alias("Perplexity"))


@register("job_perplexity_bigram", BI_PPL)
def job_perplexity_bigram(spark, sf):
    p = P.ngram_perplexity(_docs(spark, sf), "doc_id", "text", order=2)
    return p.select("doc_id", F.round("Perplexity", 4).alias("Perplexity"))


KN_PAIRS = f"""
SELECT doc_id, v, w, count(*) AS n FROM (
  SELECT doc_id, CASE WHEN i = 1 THEN '' ELSE tk[i - 1] END AS v, tk[i] AS w
  FROM (SELECT doc_id, tk, unnest(range(1, len(tk) + 1)) AS i FROM ({TOK}))) GROUP BY doc_id, v, w"""
KN_PPL = f"""
WITH pairs AS MATERIALIZED ({KN_PAIRS}),
types AS MATERIALIZED (SELECT v, w, sum(n) AS c_vw FROM pairs GROUP BY v, w),
by_v AS (SELECT v, sum(c_vw) AS c_v, count(*) AS n_v FROM types GROUP BY v),
by_w AS (SELECT w, count(*) AS n_w FROM types GROUP BY w),
own AS (SELECT p.*, t.c_vw, CASE WHEN p.n = t.c_vw THEN 1 ELSE 0 END AS own FROM pairs p JOIN types t USING (v, w)),
less_v AS (SELECT doc_id, v, sum(n) AS n_dv, sum(own) AS own_v FROM own GROUP BY doc_id, v),
less_w AS (SELECT doc_id, w, sum(own) AS own_w FROM own GROUP BY doc_id, w),
less_d AS (SELECT doc_id, sum(own) AS own_d FROM own GROUP BY doc_id),
cont AS (SELECT o.*, c_v - n_dv AS rest, n_v - own_v AS followers,
                (n_w - own_w + 1) / ((SELECT count(*) FROM types) - own_d + (SELECT count(*) FROM by_w) + 1) AS q
         FROM own o JOIN by_v USING (v) JOIN by_w USING (w) JOIN less_v USING (doc_id, v) JOIN less_w USING (doc_id, w) JOIN less_d USING (doc_id)),
s AS (SELECT doc_id, sum(n * ln(CASE WHEN rest > 0 THEN greatest(c_vw - n - {P.DISCOUNT}, 0) / rest + {P.DISCOUNT} * followers / rest * q ELSE q END)) AS lp,
             CAST(sum(n) AS BIGINT) AS n_tokens FROM cont GROUP BY doc_id)
SELECT d.doc_id, round(exp(-s.lp / s.n_tokens), 4) AS Perplexity, s.n_tokens FROM documents d LEFT JOIN s USING (doc_id)"""


@register("job_perplexity_kneser_ney", KN_PPL)
def job_perplexity_kneser_ney(spark, sf):
    p = P.kneser_ney_perplexity(_docs(spark, sf))
    return p.select("doc_id", F.round("Perplexity", 4).alias("Perplexity"), "n_tokens")


# R-2 ---------------------------------------------------------------------------------------------
@register("job_perplexity_logprobs", f"SELECT doc_id, round(Perplexity, 4) AS Perplexity FROM ({UNI_PPL})")
def job_perplexity_logprobs(spark, sf):
    docs = _docs(spark, sf)
    p = P.logprob_perplexity(docs, P.token_logprobs(docs))
    return p.select("doc_id", F.round("Perplexity", 4).alias("Perplexity"))


# A-6 ---------------------------------------------------------------------------------------------
@register("agg_metric_stats", f"""
SELECT source, round(avg(Perplexity), 4) AS mean, round(median(Perplexity), 4) AS median, round(min(Perplexity), 4) AS min,
       round(max(Perplexity), 4) AS max, count(Perplexity) AS n_scored, count(*) AS n_rows
FROM ({UNI_PPL}) GROUP BY source""")
def agg_metric_stats(spark, sf):
    from quarry.operators.aggregates import metric_stats
    p = P.ngram_perplexity(_docs(spark, sf), "doc_id", "text", order=1, keep=["source"])
    s = metric_stats(p, "Perplexity", ["source"])
    return s.select("source", *[F.round(c, 4).alias(c) for c in ("mean", "median", "min", "max")], "n_scored", "n_rows")


# R-7 ---------------------------------------------------------------------------------------------
PER_STORY = f"SELECT x.*, p.Perplexity FROM ({_div_sql('doc_id, source, lang', rnd=False)}) x JOIN ({UNI_PPL}) p USING (doc_id)"


def _summary_sql(group, src=PER_STORY):
    return f"""
SELECT {group}, count(*) AS n_stories, round(avg(Dist_1), 6) AS mean_Dist_1, round(avg(Dist_2), 6) AS mean_Dist_2,
       round(avg(Dist_3), 6) AS mean_Dist_3, round(avg(Perplexity), 4) AS mean_ppl, round(median(Perplexity), 4) AS median_ppl,
       round(min(Perplexity), 4) AS min_ppl, round(max(Perplexity), 4) AS max_ppl, count(Perplexity) AS n_scored
FROM ({src}) GROUP BY {group}"""


def _round_summary(df, group):
    r6 = [F.round(f"mean_Dist_{n}", 6).alias(f"mean_Dist_{n}") for n in (1, 2, 3)]
    r4 = [F.round(c, 4).alias(c) for c in ("mean_ppl", "median_ppl", "min_ppl", "max_ppl")]
    return df.select(*group, "n_stories", *r6, *r4, "n_scored")


@register("job_story_eval", _summary_sql("source"))
def job_story_eval(spark, sf):
    per = SE.story_metrics(_docs(spark, sf))
    return _round_summary(SE.model_summary(per, ["source"]), ["source"])


# W-4 ---------------------------------------------------------------------------------------------
def _pick_sql():
    fam = " ".join(f"WHEN contains(model, '{sub}') THEN '{lab}'" for lab, sub in SE.FAMILIES)
    picks = f"""
SELECT family, model FROM (SELECT DISTINCT source AS model, CASE {fam} END AS family FROM documents)
WHERE family IS NOT NULL QUALIFY row_number() OVER (PARTITION BY family ORDER BY model) = 1"""
    fallback = "SELECT CAST(NULL AS VARCHAR) AS family, model FROM (SELECT DISTINCT source AS model FROM documents) ORDER BY model LIMIT 3"
    return f"""
SELECT * FROM ({picks}) WHERE (SELECT count(*) FROM ({picks})) >= 2
UNION ALL SELECT * FROM ({fallback}) WHERE (SELECT count(*) FROM ({picks})) < 2"""


@register("win_pick_per_family", _pick_sql())
def win_pick_per_family(spark, sf):
    names = _docs(spark, sf).select(F.col("source").alias("model")).distinct()
    from quarry.operators.windows import pick_per_family
    return pick_per_family(names, "model", SE.FAMILIES).select("family", "model")


# A-8 ---------------------------------------------------------------------------------------------
@register("agg_model_comparison", _summary_sql(
    "family, source, lang", f"SELECT s.*, k.family FROM ({PER_STORY}) s JOIN ({_pick_sql()}) k ON s.source = k.model"))
def agg_model_comparison(spark, sf):
    per = SE.story_metrics(_docs(spark, sf))
    return _round_summary(SE.compare_models(per), ["family", "source", "lang"])


# SNK-5 -------------------------------------------------------------------------------------------
@register("snk_kv_summary", f"""
SELECT source || ' ' || key || ': ' || printf('%.6f', val) AS line FROM (
  UNPIVOT ({_summary_sql('source')}) ON mean_Dist_1, mean_Dist_2, mean_Dist_3 INTO NAME key VALUE val)""")
def snk_kv_summary(spark, sf):
    """Write the mean diversity of each model as ``key: value`` lines, then read the lines back."""
    per = M.diversity_per_text(_docs(spark, sf), "text", ["doc_id", "source"])
    means = M.mean_diversity(per, ["source"])
    long = means.unpivot(["source"], [f"mean_Dist_{n}" for n in (1, 2, 3)], "key", "value").select(
        F.concat_ws(" ", "source", "key").alias("key"), F.format_string("%.6f", F.round("value", 6)).alias("value"))
    path = write_kv_summary(long, scratch_path(spark, "summary"))
    return spark.read.text(path).select(F.col("value").alias("line"))


# P-6 ---------------------------------------------------------------------------------------------
@register("check_required_columns", """
SELECT source, count(*) AS n_rows, count(text) AS n_text_present FROM documents GROUP BY source""")
def check_required_columns(spark, sf):
    """The story metrics need a text column: checked against the schema before any job runs."""
    docs = require_columns(_docs(spark, sf), "text", "source")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("n_text_present"))


# P-7 ---------------------------------------------------------------------------------------------
@register("proj_row_index", """
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx, doc_id, source, lang, n_chars FROM documents""")
def proj_row_index(spark, sf):
    docs = table(spark, sf, "documents", balance=False).select("doc_id", "source", "lang", "n_chars")
    return row_index(docs, "doc_id").select("idx", "doc_id", "source", "lang", "n_chars")
