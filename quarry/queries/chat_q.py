"""Registered chat-dataset queries (R-4, R-6 and their stages) over ``documents``, ``labels`` and
``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import aggregates as A
from quarry.operators import filters as FL
from quarry.operators import ordering as O
from quarry.operators.windows import turn_pairs
from quarry.plans import chat as C
from quarry.plans.curate import INSTRUCTION
from quarry.queries import duck as D
from quarry.queries.registry import Registry
from quarry.session import materialize
from quarry.sources.tables import table

register = Registry()
QUERIES, ORACLE = register.queries, register.oracle


def _docs(spark, sf):
    return C.doc_records(table(spark, sf, "documents"), table(spark, sf, "labels"))


def _tagged_docs(spark, sf, only_labelled=True):
    return C.tag_records(_docs(spark, sf), only_labelled=only_labelled)


def _pairs(spark, sf):
    return C.pair_records(table(spark, sf, "conversations"))


SOURCES_SPEC = (("fifth", True, 0), ("benign", False, 0))


def _sources(spark, sf):
    return [("fifth", _tagged_docs(spark, sf), True, 0), ("benign", _pairs(spark, sf), False, 0)]


# ---- SQL building blocks (DuckDB) -----------------------------------------------------------------
NL = "chr(10)"
DOC_RECORDS = f"""
SELECT 'doc:' || CAST(d.doc_id AS VARCHAR) AS id,
       CASE WHEN strpos(d.text, {NL}) > 0 THEN substr(d.text, 1, strpos(d.text, {NL}) - 1) ELSE d.text END AS input,
       CASE WHEN strpos(d.text, {NL}) > 0 THEN substr(d.text, strpos(d.text, {NL}) + 1) ELSE '' END AS output,
       CAST(d.n_chars // 100 AS BIGINT) AS upvotes,
       l.doc_id IS NOT NULL AS has_class,
       CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'Do not keep' WHEN l.quality = 1 THEN 'KEEP'
            WHEN l.quality = 0 THEN 'Discard' END AS reply
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

QUICK_DISCARD = f"(length({D.strip("coalesce(input, '')")}) < 10 OR length({D.strip("coalesce(output, '')")}) < 5)"
KEEP_DISCARD = f"CASE WHEN coalesce(contains(upper({D.strip('reply')}), 'KEEP'), false) THEN 'KEEP' ELSE 'DISCARD' END"
TAG = f"CASE WHEN {QUICK_DISCARD} THEN 'DISCARD' ELSE {KEEP_DISCARD} END"

TAGGED_DOCS = f"""
SELECT id, input, output, upvotes, has_class, CASE WHEN has_class THEN {TAG} END AS class FROM ({DOC_RECORDS})"""

PAIRS = """
SELECT conv_id, turn, user_text, assistant_text FROM (
  SELECT conv_id, turn, role, text AS user_text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS assistant_text
  FROM conversations) WHERE role = 'user' AND next_role = 'assistant'"""

PAIR_RECORDS = f"""
SELECT 'conv:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, user_text AS input,
       assistant_text AS output, CAST(NULL AS BIGINT) AS upvotes, false AS has_class, CAST(NULL AS VARCHAR) AS class
FROM ({PAIRS})"""

MIN_LENGTH = (f"(input IS NOT NULL AND output IS NOT NULL AND input <> '' AND output <> '' "
              f"AND length({D.strip('input')}) >= 10 AND length({D.strip('output')}) >= 2)")
GATE = "(NOT has_class OR class IS NOT DISTINCT FROM 'KEEP')"


def _chat_rows_sql(source, records, use_filter, min_up):
    gate = GATE if use_filter else "true"
    return (f"SELECT id, '{source}' AS source, {D.strip('input')} AS user_content, {D.strip('output')} AS assistant_content "
            f"FROM ({records}) WHERE {gate} AND coalesce(upvotes, 0) >= {min_up} AND {MIN_LENGTH}")


CHAT_ROWS = (_chat_rows_sql("fifth", TAGGED_DOCS, True, 0) + " UNION ALL " + _chat_rows_sql("benign", PAIR_RECORDS, False, 0))


def _flat(df):
    return df.select("id", "source", F.col("messages")[0]["content"].alias("user_content"),
                     F.col("messages")[1]["content"].alias("assistant_content"))


# W-6 ---------------------------------------------------------------------------------------------
@register("win_turn_pairs", PAIRS)
def win_turn_pairs(spark, sf):
    return turn_pairs(table(spark, sf, "conversations"))


# F-1 ---------------------------------------------------------------------------------------------
@register("filter_class_gate", f"SELECT id, has_class, class FROM ({TAGGED_DOCS}) WHERE {GATE}")
def filter_class_gate(spark, sf):
    return FL.class_gate(_tagged_docs(spark, sf), True).select("id", "has_class", "class")


# F-2 ---------------------------------------------------------------------------------------------
@register("filter_min_score", f"SELECT id, upvotes FROM ({DOC_RECORDS}) WHERE coalesce(upvotes, 0) >= 10")
def filter_min_score(spark, sf):
    return FL.min_score(_docs(spark, sf), 10).select("id", "upvotes")


# F-3 ---------------------------------------------------------------------------------------------
@register("filter_min_length", f"""
SELECT id FROM ({DOC_RECORDS}) WHERE {MIN_LENGTH}
UNION ALL SELECT id FROM ({PAIR_RECORDS}) WHERE {MIN_LENGTH}""")
def filter_min_length(spark, sf):
    return FL.min_length(_docs(spark, sf)).select("id").unionByName(FL.min_length(_pairs(spark, sf)).select("id"))


# F-4 ---------------------------------------------------------------------------------------------
@register("filter_word_band", f"""
SELECT conv_id, turn, {D.word_count('assistant_text')} AS n_words FROM ({PAIRS})
WHERE {D.word_count('assistant_text')} BETWEEN 6 AND 50""")
def filter_word_band(spark, sf):
    p = turn_pairs(table(spark, sf, "conversations"))
    return FL.word_band(p, F.col("assistant_text"), 6, 50).select("conv_id", "turn", T.word_count("assistant_text").alias("n_words"))


# P-2 ---------------------------------------------------------------------------------------------
@register("proj_chat_messages", f"""
SELECT id, 'user' AS role_0, {D.strip('input')} AS content_0, 'assistant' AS role_1, {D.strip('output')} AS content_1
FROM ({PAIR_RECORDS})""")
def proj_chat_messages(spark, sf):
    m = _pairs(spark, sf).select("id", C.messages().alias("m"))
    return m.select("id", F.col("m")[0]["role"].alias("role_0"), F.col("m")[0]["content"].alias("content_0"),
                    F.col("m")[1]["role"].alias("role_1"), F.col("m")[1]["content"].alias("content_1"))


# U-1 ---------------------------------------------------------------------------------------------
@register("union_sources", f"SELECT id, source, user_content, assistant_content FROM ({CHAT_ROWS})")
def union_sources(spark, sf):
    rows = None
    for name, recs, use_filter, min_up in _sources(spark, sf):
        r = C.to_chat_rows(recs, name, use_filter, min_up)
        rows = r if rows is None else rows.unionByName(r)
    return _flat(rows)


# O-3 ---------------------------------------------------------------------------------------------
@register("sample_exact_seeded", f"""
SELECT id, upvotes FROM ({DOC_RECORDS}) ORDER BY md5('42:' || id), id LIMIT 256""")
def sample_exact_seeded(spark, sf):
    return O.sample_exact(_docs(spark, sf), 256, 42, "id").select("id", "upvotes")


# A-1 ---------------------------------------------------------------------------------------------
@register("agg_class_counts", f"""
SELECT CAST(count_if(class = 'KEEP') AS BIGINT) AS n_keep, CAST(count_if(class = 'DISCARD') AS BIGINT) AS n_discard
FROM (SELECT {TAG} AS class FROM ({DOC_RECORDS}))""")
def agg_class_counts(spark, sf):
    return A.class_counts(_tagged_docs(spark, sf, only_labelled=False))


# A-2 ---------------------------------------------------------------------------------------------
def _funnel_sql():
    rows = (f"SELECT 'fifth' AS source, true AS uf, 0 AS mu, * FROM ({TAGGED_DOCS}) "
            f"UNION ALL SELECT 'benign' AS source, false AS uf, 0 AS mu, * FROM ({PAIR_RECORDS})")
    g = "(NOT uf OR NOT has_class OR class IS NOT DISTINCT FROM 'KEEP')"
    s = "(coalesce(upvotes, 0) >= mu)"
    b = f"({D.word_count(D.strip('output'))} BETWEEN 6 AND 50)"
    return f"""
SELECT coalesce(source, '__total__') AS source, count(*) AS n_in, CAST(count_if({g}) AS BIGINT) AS n_class_gate,
       CAST(count_if({g} AND {s}) AS BIGINT) AS n_min_score, CAST(count_if({g} AND {s} AND {MIN_LENGTH}) AS BIGINT) AS n_min_length,
       CAST(count_if({g} AND {s} AND {MIN_LENGTH} AND {b}) AS BIGINT) AS n_word_band
FROM ({rows}) GROUP BY ROLLUP (source)"""


@register("agg_stage_counts", _funnel_sql())
def agg_stage_counts(spark, sf):
    return C.chat_funnel(_sources(spark, sf))


# T-7 ---------------------------------------------------------------------------------------------
@register("txt_keep_discard", f"SELECT id, reply, {KEEP_DISCARD} AS class FROM ({DOC_RECORDS}) WHERE has_class")
def txt_keep_discard(spark, sf):
    return _docs(spark, sf).where("has_class").select("id", "reply", T.keep_or_discard("reply").alias("class"))


# F-10 --------------------------------------------------------------------------------------------
@register("rule_quick_discard", f"SELECT id, {QUICK_DISCARD} AS quick_discard FROM ({DOC_RECORDS})")
def rule_quick_discard(spark, sf):
    return _docs(spark, sf).select("id", FL.quick_discard().alias("quick_discard"))


# P-4 / R-6 ---------------------------------------------------------------------------------------
@register("proj_drop_column", f"""
SELECT id, input, output, upvotes, has_class, {TAG} AS class FROM ({DOC_RECORDS})""")
def proj_drop_column(spark, sf):
    """Tagged records as saved: every column but ``instruction`` (and the transient reply)."""
    recs = _docs(spark, sf).withColumn("instruction", F.lit(INSTRUCTION))
    return C.tag_records(recs).select(*C.RECORD_COLS)


@register("job_tag", f"""
SELECT id, class, count(*) OVER (PARTITION BY class) AS n_in_class
FROM (SELECT id, {TAG} AS class FROM ({DOC_RECORDS}))""")
def job_tag(spark, sf):
    """R-6: every record tagged, with the class totals (A-1) alongside."""
    tagged = materialize(C.tag_records(_docs(spark, sf)).select("id", "class"), "tagged")  # read by rows and totals
    counts = tagged.groupBy("class").agg(F.count(F.lit(1)).alias("n_in_class"))
    return tagged.join(F.broadcast(counts), "class")  # at most two rows: KEEP, DISCARD


# T-9 / T-10 --------------------------------------------------------------------------------------
RENDER = f"('user' || chr(10) || chr(10) || {D.strip('input')} || chr(10) || chr(10) || 'assistant' || chr(10) || chr(10) || {D.strip('output')})"


@register("txt_chat_render", f"SELECT id, {RENDER} AS rendered FROM ({PAIR_RECORDS})")
def txt_chat_render(spark, sf):
    return _pairs(spark, sf).select("id", C.render_chat(C.messages()).alias("rendered"))


@register("txt_last_segment", f"""
SELECT id, {D.strip("string_split(rendered, 'assistant')[-1]")} AS reply FROM (SELECT id, {RENDER} AS rendered FROM ({PAIR_RECORDS}))""")
def txt_last_segment(spark, sf):
    r = _pairs(spark, sf).select("id", C.render_chat(C.messages()).alias("rendered"))
    return r.select("id", T.last_segment("rendered", "assistant").alias("reply"))


# R-4 ---------------------------------------------------------------------------------------------
@register("job_chat_dataset", f"""
SELECT id, source, user_content, assistant_content FROM ({CHAT_ROWS})
WHERE {D.word_count('assistant_content')} BETWEEN 6 AND 50
ORDER BY md5('42:' || id), id LIMIT 256""")
def job_chat_dataset(spark, sf):
    return _flat(C.chat_dataset(_sources(spark, sf), n_samples=256, seed=42))
