"""Answer scoring: fact eval (T-5, A-3), choice eval (O-5, T-6, T-8, A-4), best of k (A-5) and grid
tasks (R-1, A-11). Model replies enter as a table column; no model is called.

Stand-ins from the driver tables (FIXTURES.md part B):
* fact samples   = conversation turn pairs: prompt = user text, generated = assistant text,
  true / false target = 2nd / 4th whitespace token of the user text ('' when absent).
* choice samples = turn pairs: question = user text, options (high: assistant text, user text;
  low: the same two prefixed with "not "), reply = assistant text.
* trials         = ``lineitem``: task = order, trial = row_number over the order by
  (l_linenumber, l_partkey, l_suppkey, l_shipdate), correct = l_returnflag 'R'.
* grid tasks     = ``orders``: expected grid [[year, month, day of o_orderdate], [o_custkey]],
  model = o_orderpriority, split = o_orderstatus; each trial's reply renders that grid in a format
  chosen by the line's flags: plain, bracketed, comma-joined (wrong: 1,2 -> 12), wrapped in prose,
  or no digits at all (no grid).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import grid as G
from quarry.functions import template as TP
from quarry.functions import text as T
from quarry.operators import aggregates as A
from quarry.operators import ordering as O
from quarry.operators.windows import turn_pairs

MAX_TRIALS = 3
SEED = 42


# ---- fact eval ---------------------------------------------------------------------------------
def fact_samples(conv: DataFrame) -> DataFrame:
    tk = T.py_split("user_text")
    return turn_pairs(conv).select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"),
        F.col("user_text").alias("prompt"), F.col("assistant_text").alias("generated"),
        F.coalesce(F.try_element_at(tk, F.lit(2)), F.lit("")).alias("target_true"),
        F.coalesce(F.try_element_at(tk, F.lit(4)), F.lit("")).alias("target_false"))


def fact_eval(samples: DataFrame) -> DataFrame:
    return samples.withColumn("correct", T.first_target_correct("generated", "target_true", "target_false"))


# ---- choice eval -------------------------------------------------------------------------------
def _opt(tag: str, text: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), text.alias("text"))


def choice_samples(conv: DataFrame) -> DataFrame:
    p = turn_pairs(conv)
    return p.select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", F.col("user_text").alias("question"),
        F.array(_opt("high", F.col("assistant_text")), _opt("high", F.col("user_text")),
                _opt("low", F.concat(F.lit("not "), F.col("assistant_text"))),
                _opt("low", F.concat(F.lit("not "), F.col("user_text")))).alias("options"),
        F.col("assistant_text").alias("reply"))


def choice_eval(samples: DataFrame, seed: int = SEED) -> DataFrame:
    """Seeded option order per question, then letter -> option tag (null when no letter)."""
    s = samples.withColumn("shuffled", O.shuffle_options(F.col("options"), seed, F.col("id")))
    letter = T.choice_letter("reply")
    picked = F.when(letter != "", F.try_element_at("shuffled", F.ascii(letter) - 64)["tag"])
    return s.withColumn("predicted", letter).withColumn("picked_trait", picked)


def choice_prompt(question: Column, options: Column, template: str = TP.CHOICE) -> Column:
    """T-8: question and lettered options (A. ..) in ``template`` ({question}, {options})."""
    lettered = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o["text"], F.lit("\n")))
    return TP.fill(template, question=question, options=F.array_join(lettered, ""))


def story_prompt(base_story: Column, constraints: Column, template: str = TP.STORY) -> Column:
    """T-8: a base story and its selected constraints in ``template`` ({story}, {constraints})."""
    return TP.fill(template, story=base_story, constraints=constraints)


def grid_prompt(train: Column, test_input: Column, template: str = TP.GRID, example: str = TP.GRID_EXAMPLE) -> Column:
    """T-8: demonstration pairs, each in ``example`` ({input}, {output}), then the test input in ``template`` ({examples},
    {test}); grids are rows of space-separated numbers."""
    shown = F.transform(train, lambda p: TP.fill(example, input=G.grid_text(p["input"]), output=G.grid_text(p["output"])))
    return TP.fill(template, examples=F.array_join(shown, ""), test=G.grid_text(test_input))


# ---- trials and best of k ----------------------------------------------------------------------
def lineitem_trials(lineitem: DataFrame, k: int = MAX_TRIALS) -> DataFrame:
    """(task, test_idx, trial, correct, flags) for the first ``k`` lines of each order
    (row_number <= k is planned as a partial WindowGroupLimit: hot orders are cut map-side)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    t = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag",
                        "l_linestatus").withColumn("trial", F.row_number().over(w)).where(F.col("trial") <= k)
    return t.select(F.col("l_orderkey").alias("task"), F.lit(0).cast("bigint").alias("test_idx"), "trial",
                    (F.col("l_returnflag") == "R").alias("correct"), "l_returnflag", "l_linestatus")


def grid_tasks(orders: DataFrame) -> DataFrame:
    d = F.col("o_orderdate")
    expected = F.array(F.array(F.year(d).cast("bigint"), F.month(d).cast("bigint"), F.dayofmonth(d).cast("bigint")),
                       F.array(F.col("o_custkey")))
    return orders.select(F.col("o_orderkey").alias("task"), F.lit(0).cast("bigint").alias("test_idx"),
                         expected.alias("expected"), F.col("o_orderpriority").alias("model"),
                         F.col("o_orderstatus").alias("split"))


def render_reply(expected: Column, flag: Column, status: Column) -> Column:
    """Stand-in model reply for one trial (see module docstring)."""
    plain = G.grid_text(expected, " ")
    bracket = F.array_join(F.transform(expected, lambda r: F.concat(
        F.lit("["), F.array_join(F.transform(r, lambda x: x.cast("string")), ", "), F.lit("]"))), "\n")
    comma = G.grid_text(expected, ",")
    prose = F.concat(F.lit("I think:\n\n"), plain, F.lit("\n"))
    return (F.when(flag == "R", F.when(status == "F", plain).otherwise(bracket))
            .when(flag == "A", comma)
            .otherwise(F.when(status == "F", prose).otherwise(F.lit("no idea"))))


def grid_trials(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    tasks = grid_tasks(orders)
    t = lineitem_trials(lineitem).drop("correct").join(tasks, ["task", "test_idx"], "inner")
    t = t.withColumn("response", render_reply(F.col("expected"), F.col("l_returnflag"), F.col("l_linestatus")))
    pred = G.parse_grid(F.col("response"))
    return t.withColumn("predicted_grid", pred).withColumn("correct", G.grids_equal(pred, F.col("expected")))


def grid_scoring(trials: DataFrame) -> DataFrame:
    """R-1: per (task, test): best of k over parsed replies, with the expected shape (a per-task
    value, so it rides along as a grouping key instead of a second join)."""
    shape = G.grid_shape(F.col("expected"))
    t = trials.withColumn("expected_rows", shape[0].cast("bigint")).withColumn("expected_cols", shape[1].cast("bigint"))
    keys = ["task", "test_idx", "model", "split", "expected_rows", "expected_cols"]
    return A.best_of_k(t, keys, "trial", "correct", MAX_TRIALS)
