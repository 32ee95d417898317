"""Curation of forum listings into instruction records (R-5), from landed listing pages.

Order of operations follows the reference loop exactly: listing cap per view (W-5) -> first-seen
dedup over the whole listing, *before* any gate (W-1, ledger Q5) -> engagement and per-view score
gates (F-5, F-6) -> first valid answer per post (F-7, W-2) -> inner join post/answer with a non-empty
body (J-7, Q6) -> stop at the target in listing priority order (O-2, Q7) -> record projection (P-1).

Stand-ins from the driver tables (FIXTURES.md part B):
* listing (E1) = ``events``: id = user_id*100 + props.k, view = event_type, score = floor(value),
  num_comments = floor(value) % 5, created_utc = epoch of ts, page = event_id div 100 and
  pos = event_id % 100 (listing order = event order, at most 100 posts per page);
  the post's thread is conversation ``props.k``, whose opening user turn gives title (first line)
  and selftext (the rest).
* comments (E2) = the non-user turns of each conversation, in turn order; system turns stand for
  stickied comments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import early_stop as ES
from quarry.operators import filters as FL
from quarry.operators import windows as W
from quarry.operators.joins import salted_join
from quarry.session import materialize, scratch_path

# Stand-in listing views (event types) in crawl priority order; the last one gets the extra score gate.
VIEW_ORDER = ("click", "error", "purchase", "signup", "view")
GATED_VIEW = "view"
# Instruction text of every record; the crawl's record target and listing cap (10 pages x 100
# posts), which only the operators they belong to (O-2, W-5) use: the job itself runs whole unless asked.
INSTRUCTION = "Diagnose the following dimensional anomaly."
TARGET = 600
CAP_PER_VIEW = 1000


def view_rank(view: Column, order=VIEW_ORDER) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in order]), view).cast("int")


def split_title(text: Column) -> tuple[Column, Column]:
    nl = F.instr(text, "\n")
    first = F.when(nl > 0, F.substr(text, F.lit(1), nl - 1)).otherwise(text)
    rest = F.when(nl > 0, F.substr(text, nl + 1, F.length(text))).otherwise(F.lit(""))
    return first, rest


def thread_heads(conv: DataFrame) -> DataFrame:
    """Opening user turn per conversation (partial+final aggregate, no window)."""
    heads = (conv.where(F.col("role") == "user").groupBy("conv_id")
             .agg(F.min_by("text", "turn").alias("head")))
    title, selftext = split_title(F.col("head"))
    return heads.select(F.col("conv_id").alias("thread_id"), title.alias("title"), selftext.alias("selftext"))


def listing_from_events(events: DataFrame) -> DataFrame:
    """E1 listing rows (without title/selftext) from the events table."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    v = F.floor(F.col("value")).cast("bigint")
    return events.select(
        F.col("event_type").alias("view"),
        view_rank(F.col("event_type")).alias("view_rank"),
        F.floor(F.col("event_id") / 100).cast("bigint").alias("page"),
        F.pmod(F.col("event_id"), F.lit(100)).cast("bigint").alias("pos"),
        (F.col("user_id") * 100 + k).cast("string").alias("id"),
        k.alias("thread_id"),
        v.alias("score"),
        F.pmod(v, F.lit(5)).alias("num_comments"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created_utc"),
    )


def comments_from_conversations(conv: DataFrame) -> DataFrame:
    """E2 rows: post_id, pos, body, stickied."""
    return conv.where(F.col("role") != "user").select(
        F.col("conv_id").alias("post_id"), F.col("turn").alias("pos"), F.col("text").alias("body"),
        (F.col("role") == "system").alias("stickied"))


def first_answers(comments: DataFrame) -> DataFrame:
    """W-2 with F-7: first eligible comment per post; its body must be non-empty (Q6)."""
    first = W.first_valid_answer(comments, FL.comment_valid_pred(), "post_id", ("pos",))
    return first.where(F.col("body").isNotNull() & (F.col("body") != "")).select(
        F.col("post_id").alias("thread_id"), F.col("body").alias("answer"))


def gated_posts(listing_df: DataFrame, cap: int | None = None, gated_view: str = GATED_VIEW) -> DataFrame:
    """W-5 (with ``cap``) -> W-1 -> F-5 -> F-6."""
    df = W.cap_per_view(listing_df, cap) if cap is not None else listing_df
    df = W.first_seen(df, "id", ("view_rank", "page", "pos"))
    df = FL.engagement(df, "num_comments", 1)
    return FL.score_by_view(df, gated_view, 3)


def curated_record(df: DataFrame) -> DataFrame:
    """P-1: id, date (yyyy-MM-dd, UTC), instruction, input = strip(title \\n selftext), output, upvotes."""
    inp = T.py_strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("selftext", F.lit(""))))
    return df.select(
        "id", T.epoch_to_date("created_utc").alias("date"), F.lit(INSTRUCTION).alias("instruction"),
        inp.alias("input"), F.col("answer").alias("output"), F.col("score").alias("upvotes"))


def answered_posts(events: DataFrame, conv: DataFrame, cap: int | None = None, gated_view: str = GATED_VIEW) -> DataFrame:
    """J-7 with the thread's head: gated posts (narrow rows: no text goes through the windows), written once, then
    joined to one row per thread that holds answer, title and selftext; hot threads are salted."""
    posts = materialize(gated_posts(listing_from_events(events), cap, gated_view), "gated-posts")
    threads = first_answers(comments_from_conversations(conv)).join(thread_heads(conv), "thread_id", "left")
    return salted_join(posts, threads, "thread_id", ["id"])


def answered_to_target(events: DataFrame, conv: DataFrame, target: int, cap: int | None = None, gated_view: str = GATED_VIEW,
                       pages_per_block: int = ES.PAGES_PER_BLOCK) -> DataFrame:
    """O-2: the first ``target`` answered posts in listing priority order, stopping there as the crawl does. Whether a post has an
    answer is settled with ids alone; posts behind the target are not read again, and titles, bodies and answers are gathered for
    the threads of the posts taken only."""
    spark = events.sparkSession
    posts = gated_posts(listing_from_events(events), cap, gated_view)
    has_answer = first_answers(comments_from_conversations(conv)).select("thread_id")
    accepted = salted_join(materialize(posts, "gated-posts"), has_answer, "thread_id", ["id"])
    path = ES.land_by_priority(accepted, scratch_path(spark, "answered-posts"), pages_per_block=pages_per_block)
    landed = ES.read_landed(spark, path, accepted.schema)
    counts = landed.groupBy("_rank", "_block").agg(F.count(F.lit(1)).alias("n"))
    taken = ES.first_of_landed(landed, counts, target, ["view_rank", "page", "pos"])
    wanted = conv.join(taken.select(F.col("thread_id").alias("conv_id")).distinct(), "conv_id", "left_semi")
    threads = first_answers(comments_from_conversations(wanted)).join(thread_heads(wanted), "thread_id", "left")
    return salted_join(taken, threads, "thread_id", ["id"])


def curate(events: DataFrame, conv: DataFrame, target: int | None = None, cap: int | None = None,
           gated_view: str = GATED_VIEW) -> DataFrame:
    """R-5 end to end on landed pages, over the whole listing. ``cap`` (listing rows per view) and ``target`` (records,
    in listing priority order) are off unless given."""
    if target is None:
        return curated_record(answered_posts(events, conv, cap, gated_view))
    return curated_record(answered_to_target(events, conv, target, cap, gated_view))
