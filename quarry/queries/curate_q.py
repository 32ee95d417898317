"""Registered curation queries (R-5 and its stages) over ``events`` (listing) and ``conversations``
(threads)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import filters as FL
from quarry.operators import ordering as O
from quarry.operators import windows as W
from quarry.plans import curate as CU
from quarry.queries import duck as D
from quarry.queries.registry import Registry
from quarry.session import scratch_path
from quarry.sources.listing import read_listing_pages, write_listing_pages
from quarry.sources.tables import table

register = Registry()
QUERIES, ORACLE = register.queries, register.oracle


VIEWS_SQL = "[" + ", ".join(f"'{v}'" for v in CU.VIEW_ORDER) + "]"
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
LISTING = f"""
SELECT event_type AS view, CAST(list_position({VIEWS_SQL}, event_type) AS INTEGER) AS view_rank,
       CAST(event_id // 100 AS BIGINT) AS page, CAST(event_id % 100 AS BIGINT) AS pos,
       CAST(user_id * 100 + {K} AS VARCHAR) AS id, {K} AS thread_id,
       CAST(floor(value) AS BIGINT) AS score, CAST(floor(value) AS BIGINT) % 5 AS num_comments, ts
FROM events"""
NL = "chr(10)"
HEADS = f"""
SELECT conv_id AS thread_id,
       CASE WHEN strpos(head, {NL}) > 0 THEN substr(head, 1, strpos(head, {NL}) - 1) ELSE head END AS title,
       CASE WHEN strpos(head, {NL}) > 0 THEN substr(head, strpos(head, {NL}) + 1) ELSE '' END AS selftext
FROM (SELECT conv_id, arg_min(text, turn) AS head FROM conversations WHERE role = 'user' GROUP BY conv_id)"""
CAPPED = f"SELECT * FROM ({LISTING}) QUALIFY row_number() OVER (PARTITION BY view ORDER BY page, pos) <= {CU.CAP_PER_VIEW}"


def first_seen_sql(src):
    return f"SELECT * FROM ({src}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY view_rank, page, pos) = 1"


GATED = f"""SELECT * FROM ({first_seen_sql(LISTING)})
WHERE num_comments >= 1 AND NOT (view = '{CU.GATED_VIEW}' AND score < 3)"""
COMMENTS = """
SELECT conv_id AS post_id, turn AS pos, text AS body, role = 'system' AS stickied FROM conversations WHERE role <> 'user'"""
DELETED_SQL = ", ".join(f"'{m}'" for m in FL.DELETED_MARKERS)
VALID = f"(NOT coalesce(stickied, false) AND NOT coalesce(body IN ({DELETED_SQL}), false))"
ANSWERS = f"""
SELECT post_id AS thread_id, body AS answer FROM (
  SELECT * FROM ({COMMENTS}) WHERE {VALID} QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY pos) = 1)
WHERE body IS NOT NULL AND body <> ''"""
ANSWERED = f"SELECT g.*, a.answer FROM ({GATED}) g JOIN ({ANSWERS}) a ON g.thread_id = a.thread_id"


def record_sql(src):
    inp = D.strip(f"coalesce(h.title, '') || {NL} || coalesce(h.selftext, '')")
    return f"""
SELECT r.id, strftime(r.ts, '%Y-%m-%d') AS date, '{CU.INSTRUCTION}' AS instruction, {inp} AS input,
       r.answer AS output, r.score AS upvotes
FROM ({src}) r LEFT JOIN ({HEADS}) h ON r.thread_id = h.thread_id"""


def _bare_listing(spark, sf):
    return CU.listing_from_events(table(spark, sf, "events"))


# SRC-7 -------------------------------------------------------------------------------------------
@register("src_listing_pages", f"""
SELECT view, page, CAST(row_number() OVER (PARTITION BY view, page ORDER BY pos) - 1 AS BIGINT) AS pos, id, score, num_comments
FROM ({LISTING})""")
def src_listing_pages(spark, sf):
    """Land the listing as page documents in the shared scratch folder, then read them back."""
    path = write_listing_pages(_bare_listing(spark, sf), scratch_path(spark, "listing-pages"))
    return read_listing_pages(spark, path).select("view", "page", "pos", "id", "score", "num_comments")


# W-5 ---------------------------------------------------------------------------------------------
@register("win_cap_per_view", f"SELECT view, page, pos, id FROM ({CAPPED})")
def win_cap_per_view(spark, sf):
    return W.cap_per_view(_bare_listing(spark, sf), CU.CAP_PER_VIEW).select("view", "page", "pos", "id")


# W-1 ---------------------------------------------------------------------------------------------
@register("win_first_seen", f"SELECT id, view, page, pos FROM ({first_seen_sql(LISTING)})")
def win_first_seen(spark, sf):
    return W.first_seen(_bare_listing(spark, sf)).select("id", "view", "page", "pos")


# F-5 ---------------------------------------------------------------------------------------------
@register("filter_engagement", f"SELECT id, num_comments FROM ({first_seen_sql(LISTING)}) WHERE num_comments >= 1")
def filter_engagement(spark, sf):
    return FL.engagement(W.first_seen(_bare_listing(spark, sf))).select("id", "num_comments")


# F-6 ---------------------------------------------------------------------------------------------
@register("filter_score_by_view", f"""
SELECT id, view, score FROM ({first_seen_sql(LISTING)})
WHERE num_comments >= 1 AND NOT (view = '{CU.GATED_VIEW}' AND score < 3)""")
def filter_score_by_view(spark, sf):
    df = FL.engagement(W.first_seen(_bare_listing(spark, sf)))
    return FL.score_by_view(df, CU.GATED_VIEW, 3).select("id", "view", "score")


# F-7 ---------------------------------------------------------------------------------------------
@register("filter_comment_valid", f"SELECT post_id, pos FROM ({COMMENTS}) WHERE {VALID}")
def filter_comment_valid(spark, sf):
    return FL.comment_valid(CU.comments_from_conversations(table(spark, sf, "conversations"))).select("post_id", "pos")


# W-2 ---------------------------------------------------------------------------------------------
@register("win_first_valid_answer", ANSWERS)
def win_first_valid_answer(spark, sf):
    return CU.first_answers(CU.comments_from_conversations(table(spark, sf, "conversations")))


# J-7 ---------------------------------------------------------------------------------------------
@register("join_post_answer", f"SELECT id, view, thread_id, answer FROM ({ANSWERED})")
def join_post_answer(spark, sf):
    return CU.answered_posts(table(spark, sf, "events"), table(spark, sf, "conversations")).select(
        "id", "view", "thread_id", "answer")


# O-2 ---------------------------------------------------------------------------------------------
@register("limit_priority_target", f"""
SELECT id, view_rank, page, pos FROM ({ANSWERED}) ORDER BY view_rank, page, pos LIMIT {CU.TARGET}""")
def limit_priority_target(spark, sf):
    answered = CU.answered_posts(table(spark, sf, "events"), table(spark, sf, "conversations"))
    return O.priority_target(answered, CU.TARGET).select("id", "view_rank", "page", "pos")


@register("limit_target_early_stop", f"""
SELECT id, view_rank, page, pos, answer FROM ({ANSWERED}) ORDER BY view_rank, page, pos
LIMIT (SELECT count(*) // 5 FROM events)""")
def limit_target_early_stop(spark, sf):
    """A target that grows with the listing (a fifth of its rows): blocks of pages behind it are not read."""
    events = table(spark, sf, "events")
    got = CU.answered_to_target(events, table(spark, sf, "conversations"), events.count() // 5, pages_per_block=10)
    return got.select("id", "view_rank", "page", "pos", "answer")


# P-1 ---------------------------------------------------------------------------------------------
@register("proj_curated_record", record_sql(ANSWERED))
def proj_curated_record(spark, sf):
    return CU.curated_record(CU.answered_posts(table(spark, sf, "events"), table(spark, sf, "conversations")))


# T-17 --------------------------------------------------------------------------------------------
@register("date_fields", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y%m%d_%H%M%S') AS run_stamp,
       CAST(epoch(strptime(strftime(ts, '%Y%m%d_%H%M%S'), '%Y%m%d_%H%M%S')) AS BIGINT) AS stamp_epoch
FROM events""")
def date_fields(spark, sf):
    ev = table(spark, sf, "events")
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    stamp = T.run_stamp(F.col("ts").cast("timestamp"))
    return ev.select("event_id", T.epoch_to_date(epoch).alias("date"), stamp.alias("run_stamp"),
                     F.unix_seconds(T.parse_run_stamp(stamp)).alias("stamp_epoch"))


# R-5 ---------------------------------------------------------------------------------------------
@register("job_curate", record_sql(ANSWERED))
def job_curate(spark, sf):
    return CU.curate(table(spark, sf, "events"), table(spark, sf, "conversations"))
