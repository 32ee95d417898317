"""Chat-dataset curation: tagging (R-6), conversion to chat rows and sampling (R-4), chat rendering
(T-9) and reply extraction (T-10).

Stand-ins from the driver tables (see FIXTURES.md part B):
* tagged records  = ``documents`` (input = first line, output = the rest, upvotes = n_chars div 100)
  left-joined to ``labels``; a labelled document carries a class (from a classifier-style reply made
  from quality/toxic), an unlabelled one carries no class key at all (ledger Q3).
* untagged records = user -> assistant turn pairs of ``conversations`` (no class, no upvotes key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import template as TP
from quarry.functions import text as T
from quarry.operators import aggregates as A
from quarry.operators import filters as FL
from quarry.operators import ordering as O
from quarry.operators.windows import turn_pairs

RECORD_COLS = ["id", "input", "output", "upvotes", "has_class", "class"]


# ---- stand-ins ---------------------------------------------------------------------------------
def doc_records(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """E3-like records with a classifier reply column from ``labels`` (null when unlabelled)."""
    text = F.col("text")
    nl = F.instr(text, "\n")
    first = F.when(nl > 0, F.substr(text, F.lit(1), nl - 1)).otherwise(text)
    rest = F.when(nl > 0, F.substr(text, nl + 1, F.length(text))).otherwise(F.lit(""))
    lab = labels.select(F.col("doc_id"), "quality", "toxic", F.lit(True).alias("_labelled"))
    reply = (F.when((F.col("quality") == 1) & (F.col("toxic") == 1), F.lit("Do not keep"))
             .when(F.col("quality") == 1, F.lit("KEEP"))
             .when(F.col("quality") == 0, F.lit("Discard")))
    return (docs.select("doc_id", "text", "n_chars").join(lab, "doc_id", "left")
            .select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"),
                    first.alias("input"), rest.alias("output"),
                    F.floor(F.col("n_chars") / 100).cast("bigint").alias("upvotes"),
                    F.coalesce(F.col("_labelled"), F.lit(False)).alias("has_class"),
                    reply.alias("reply")))


def pair_records(conv: DataFrame) -> DataFrame:
    """Untagged E3-like records from user -> assistant turn pairs."""
    return turn_pairs(conv).select(
        F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"),
        F.col("user_text").alias("input"), F.col("assistant_text").alias("output"),
        F.lit(None).cast("bigint").alias("upvotes"), F.lit(False).alias("has_class"),
        F.lit(None).cast("string").alias("class"))


# ---- R-6 tagging -------------------------------------------------------------------------------
def tag_prompt(inp: Column | str = "input", out: Column | str = "output", template: str = TP.TAG) -> Column:
    """T-8: the classifier's user message for one record ({post}, {reply}); its answer comes back as a column and is read by
    ``tag_class``."""
    i = F.col(inp) if isinstance(inp, str) else inp
    o = F.col(out) if isinstance(out, str) else out
    return TP.fill(template, post=T.py_strip(i), reply=T.py_strip(o))


def tag_class(reply: Column | str = "reply") -> Column:
    """F-10 then T-7: too-short rows are DISCARD without a reply; otherwise KEEP iff the reply says KEEP."""
    return F.when(FL.quick_discard(), F.lit("DISCARD")).otherwise(T.keep_or_discard(reply))


def tag_records(records: DataFrame, only_labelled: bool = False) -> DataFrame:
    """R-6: add ``class`` (KEEP/DISCARD) to each record and drop ``instruction`` (P-4).

    ``only_labelled`` leaves rows with ``has_class`` false untagged (class null)."""
    cls = tag_class()
    if only_labelled:
        cls = F.when(F.col("has_class"), cls)
    out = records.withColumn("class", cls)
    return out.drop("instruction", "reply")


# ---- R-4 chat rows -----------------------------------------------------------------------------
def messages(inp: str = "input", out: str = "output") -> Column:
    """P-2: [{user: strip(input)}, {assistant: strip(output)}]."""
    return F.array(
        F.struct(F.lit("user").alias("role"), T.py_strip(inp).alias("content")),
        F.struct(F.lit("assistant").alias("role"), T.py_strip(out).alias("content")))


def to_chat_rows(records: DataFrame, source: str, use_class_filter: bool = True, min_upvotes: int = 0) -> DataFrame:
    """convert_to_sft: class gate (F-1), score (F-2), length (F-3), then chat messages (P-2)."""
    df = FL.class_gate(records, use_class_filter)
    df = FL.min_score(df, min_upvotes)
    df = FL.min_length(df)
    return df.select("id", F.lit(source).alias("source"), messages().alias("messages"))


def chat_dataset(sources: list[tuple[str, DataFrame, bool, int]], n_samples: int | None = 256, seed: int = 42,
                 min_words: int = 6, max_words: int = 50) -> DataFrame:
    """R-4 end to end: per-source conversion, union with duplicates kept (U-1), word band on the
    assistant message (F-4), then an exact seeded sample (O-3)."""
    rows = None
    for name, recs, use_filter, min_up in sources:
        r = to_chat_rows(recs, name, use_filter, min_up)
        rows = r if rows is None else rows.unionByName(r)
    banded = FL.word_band(rows, F.col("messages")[1]["content"], min_words, max_words)
    return O.sample_exact(banded, n_samples, seed, "id")


def chat_funnel(sources: list[tuple[str, DataFrame, bool, int]], min_words: int = 6, max_words: int = 50) -> DataFrame:
    """A-2: rows in / kept after each gate, per source and in total, one pass over the union."""
    rows = None
    for name, recs, use_filter, min_up in sources:
        r = recs.select(*RECORD_COLS, F.lit(name).alias("source"), F.lit(use_filter).alias("_use_filter"),
                        F.lit(min_up).alias("_min_up"))
        rows = r if rows is None else rows.unionByName(r)
    gate = ~F.col("_use_filter") | ~F.col("has_class") | F.col("class").eqNullSafe("KEEP")
    score = F.coalesce(F.col("upvotes"), F.lit(0)) >= F.col("_min_up")
    length = FL.min_length_pred()
    band = FL.word_band_pred(T.py_strip("output"), min_words, max_words)
    return A.stage_counts(rows, "source", [("n_class_gate", gate), ("n_min_score", score),
                                           ("n_min_length", length), ("n_word_band", band)])


# ---- T-9 / T-10 --------------------------------------------------------------------------------
def render_chat(msgs: Column | str = "messages", sep: str = "\n\n") -> Column:
    """T-9: ordered messages flattened to one training text, ``role<sep>content`` joined by ``sep``."""
    m = F.col(msgs) if isinstance(msgs, str) else msgs
    return F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(sep), x["content"])), sep)
