"""Registered scoring queries: fact eval, choice eval, prompts, best of k and grid tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import template as TP
from quarry.functions import text as T
from quarry.functions.grid import NON_DIGIT_NON_WS_RE2 as NON_DIGIT_NON_WS
from quarry.operators import aggregates as A
from quarry.operators import ordering as O
from quarry.plans import score as S
from quarry.queries import duck as D
from quarry.queries.chat_q import PAIRS
from quarry.queries.registry import Registry
from quarry.sources.tables import table

register = Registry()
QUERIES, ORACLE = register.queries, register.oracle


ID = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"
FACT = f"""
SELECT {ID} AS id, user_text AS prompt, assistant_text AS generated,
       coalesce({D.split('user_text')}[2], '') AS target_true, coalesce({D.split('user_text')}[4], '') AS target_false
FROM ({PAIRS})"""
G_, T_, F_ = (f"lower({D.strip(c)})" for c in ("generated", "target_true", "target_false"))
CORRECT = f"coalesce(instr({G_}, {T_}) > 0 AND (instr({G_}, {F_}) = 0 OR instr({G_}, {T_}) < instr({G_}, {F_})), false)"
FACT_SCORED = f"SELECT *, {CORRECT} AS correct FROM ({FACT})"


def _opt(i, tag, text):
    return f"{{'k': md5('{S.SEED}:' || id || ':{i}'), 'tag': '{tag}', 'text': {text}}}"


CHOICE = f"""
SELECT id, conv_id, turn, question, reply, list_sort([{_opt(0, 'high', 'reply')}, {_opt(1, 'high', 'question')},
       {_opt(2, 'low', "'not ' || reply")}, {_opt(3, 'low', "'not ' || question")}]) AS opts
FROM (SELECT {ID} AS id, conv_id, turn, user_text AS question, assistant_text AS reply FROM ({PAIRS}))"""
LETTER = "upper(regexp_extract(coalesce(reply, ''), '[A-Da-d]', 0))"
CHOICE_SCORED = f"""
SELECT *, {LETTER} AS predicted,
       CASE WHEN {LETTER} <> '' THEN opts[ascii({LETTER}) - 64].tag END AS picked_trait FROM ({CHOICE})"""

TRIALS = """
SELECT l_orderkey AS task, CAST(0 AS BIGINT) AS test_idx, l_returnflag, l_linestatus,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS trial
FROM lineitem"""


def best_sql(trials, keys):
    first = "min(trial) FILTER (WHERE correct)"
    return f"""
SELECT {keys}, {first} IS NOT NULL AS solved, CAST({first} AS BIGINT) AS trials_needed,
       CAST(coalesce({first}, max(trial)) AS BIGINT) AS trials_used
FROM ({trials}) WHERE trial <= {S.MAX_TRIALS} GROUP BY {keys}"""


def _grid_text(sep):
    return f"array_to_string(list_transform(expected, lambda r: array_to_string(list_transform(r, lambda x: CAST(x AS VARCHAR)), '{sep}')), chr(10))"


BRACKET = "array_to_string(list_transform(expected, lambda r: '[' || array_to_string(list_transform(r, lambda x: CAST(x AS VARCHAR)), ', ') || ']'), chr(10))"
REPLY = f"""CASE WHEN l_returnflag = 'R' THEN (CASE WHEN l_linestatus = 'F' THEN {_grid_text(' ')} ELSE {BRACKET} END)
     WHEN l_returnflag = 'A' THEN {_grid_text(',')}
     ELSE (CASE WHEN l_linestatus = 'F' THEN 'I think:' || chr(10) || chr(10) || {_grid_text(' ')} || chr(10) ELSE 'no idea' END) END"""
PARSED_ROWS = (f"list_filter(list_transform(list_filter(list_transform(string_split({D.strip('response')}, chr(10)), "
               f"lambda ln: {D.strip('ln')}), lambda ln: ln <> ''), lambda ln: list_transform("
               f"{D.split(f'regexp_replace(ln, {chr(39)}{NON_DIGIT_NON_WS}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, "
               f"lambda tok: TRY_CAST(tok AS BIGINT))), lambda r: len(r) > 0)")
GRID_TRIALS = f"""
SELECT *, coalesce(CASE WHEN len(rows) > 0 THEN rows END = expected, false) AS correct FROM (
  SELECT *, {PARSED_ROWS} AS rows FROM (
    SELECT t.*, o.model, o.split, o.expected, {REPLY} AS response
    FROM ({TRIALS}) t JOIN (
      SELECT o_orderkey AS task, o_orderpriority AS model, o_orderstatus AS split,
             [[CAST(year(o_orderdate) AS BIGINT), CAST(month(o_orderdate) AS BIGINT), CAST(day(o_orderdate) AS BIGINT)],
              [o_custkey]] AS expected FROM orders) o ON t.task = o.task
    WHERE t.trial <= {S.MAX_TRIALS}))"""
GRID_SCORED = best_sql(
    f"SELECT *, CAST(len(expected) AS BIGINT) AS expected_rows, CAST(coalesce(len(expected[1]), 0) AS BIGINT) AS expected_cols FROM ({GRID_TRIALS})",
    "task, test_idx, model, split, expected_rows, expected_cols")


def _fact(spark, sf):
    return S.fact_eval(S.fact_samples(table(spark, sf, "conversations")))


def _choice(spark, sf):
    return S.choice_eval(S.choice_samples(table(spark, sf, "conversations")))


def _grid(spark, sf):
    return S.grid_scoring(S.grid_trials(table(spark, sf, "lineitem"), table(spark, sf, "orders")))


# T-5 ---------------------------------------------------------------------------------------------
@register("txt_first_target", f"SELECT id, target_true, target_false, correct FROM ({FACT_SCORED})")
def txt_first_target(spark, sf):
    return _fact(spark, sf).select("id", "target_true", "target_false", "correct")


# A-3 ---------------------------------------------------------------------------------------------
@register("agg_accuracy", f"""
SELECT CAST(count_if(correct) AS BIGINT) AS correct, count(*) AS total,
       round(coalesce(CAST(count_if(correct) AS BIGINT) / nullif(count(*), 0), 0.0), 6) AS accuracy FROM ({FACT_SCORED})""")
def agg_accuracy(spark, sf):
    acc = A.accuracy(_fact(spark, sf), [], F.col("correct"))
    return acc.select("correct", "total", F.round("accuracy", 6).alias("accuracy"))


# P-5 ---------------------------------------------------------------------------------------------
@register("proj_detail_truncate", f"""
SELECT id, left(prompt, 100) AS prompt, left(generated, 100) AS generated,
       CASE WHEN length(prompt) > 60 THEN left(prompt, 60) || '...' ELSE prompt END AS preview, correct
FROM ({FACT_SCORED})""")
def proj_detail_truncate(spark, sf):
    d = _fact(spark, sf)
    return d.select("id", T.truncate_detail("prompt", 100).alias("prompt"), T.truncate_detail("generated", 100).alias("generated"),
                    T.truncate_detail("prompt", 60, ellipsis=True).alias("preview"), "correct")


# T-6 ---------------------------------------------------------------------------------------------
@register("txt_choice_letter", f"SELECT id, predicted, picked_trait FROM ({CHOICE_SCORED})")
def txt_choice_letter(spark, sf):
    return _choice(spark, sf).select("id", "predicted", "picked_trait")


# O-5 ---------------------------------------------------------------------------------------------
@register("shuffle_options", f"""
SELECT id, array_to_string(list_transform(opts, lambda o: o.tag), ',') AS tag_order, opts[1].text AS first_option
FROM ({CHOICE})""")
def shuffle_options(spark, sf):
    c = _choice(spark, sf)
    return c.select("id", F.array_join(F.transform("shuffled", lambda o: o["tag"]), ",").alias("tag_order"),
                    F.col("shuffled")[0]["text"].alias("first_option"))


# T-8 ---------------------------------------------------------------------------------------------
def _choice_prompt_sql():
    opts = " || ".join(f"'{chr(65 + i)}. ' || opts[{i + 1}].text || chr(10)" for i in range(4))
    return f"SELECT id, {D.fill(TP.CHOICE, question='question', options=opts)} AS prompt FROM ({CHOICE})"


@register("txt_prompt_template", _choice_prompt_sql())
def txt_prompt_template(spark, sf):
    c = _choice(spark, sf)
    return c.select("id", S.choice_prompt(F.col("question"), F.col("shuffled")).alias("prompt"))


# A-4 ---------------------------------------------------------------------------------------------
@register("agg_choice_rate", f"""
SELECT CAST(turn AS BIGINT) AS turn, CAST(count_if(picked_trait IS NOT DISTINCT FROM 'high') AS BIGINT) AS high_trait_count, count(*) AS total,
       round(coalesce(CAST(count_if(picked_trait IS NOT DISTINCT FROM 'high') AS BIGINT) / nullif(count(*), 0), 0.0), 6) AS high_trait_rate
FROM ({CHOICE_SCORED}) GROUP BY turn""")
def agg_choice_rate(spark, sf):
    r = A.choice_rate(_choice(spark, sf), ["turn"])
    return r.select(F.col("turn").cast("bigint").alias("turn"), "high_trait_count", "total",
                    F.round("high_trait_rate", 6).alias("high_trait_rate"))


# O-1 ---------------------------------------------------------------------------------------------
EVAL_LIMIT = 250


@register("limit_first_n", f"SELECT id, question FROM ({CHOICE}) ORDER BY conv_id, turn LIMIT {EVAL_LIMIT}")
def limit_first_n(spark, sf):
    """The evaluation row limit (250 in the reference config) in dataset order."""
    return O.first_n(S.choice_samples(table(spark, sf, "conversations")), EVAL_LIMIT, ["conv_id", "turn"]).select("id", "question")


# A-5 ---------------------------------------------------------------------------------------------
@register("agg_best_of_k", best_sql(f"SELECT *, l_returnflag = 'R' AS correct FROM ({TRIALS})", "task, test_idx"))
def agg_best_of_k(spark, sf):
    return A.best_of_k(S.lineitem_trials(table(spark, sf, "lineitem")), ["task", "test_idx"])


# R-1 ---------------------------------------------------------------------------------------------
@register("job_grid_scoring", GRID_SCORED)
def job_grid_scoring(spark, sf):
    return _grid(spark, sf)


# A-11 --------------------------------------------------------------------------------------------
@register("agg_split_summary", f"""
SELECT model, split, count(*) AS total_tasks, CAST(count_if(solved) AS BIGINT) AS solved,
       round(coalesce(CAST(count_if(solved) AS BIGINT) / nullif(count(*), 0), 0.0), 6) AS accuracy
FROM ({GRID_SCORED}) GROUP BY model, split""")
def agg_split_summary(spark, sf):
    s = A.split_summary(_grid(spark, sf), ["model", "split"])
    return O.sorted_by(s.select("model", "split", "total_tasks", "solved", F.round("accuracy", 6).alias("accuracy")),
                       "model", "split")
