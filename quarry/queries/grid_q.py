"""Registered evaluation set-up queries: prompt x constraints, job grids, coverage, lookups,
side-by-side answers, model folders, and the per-level file round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import template as TP
from quarry.operators import filters as FL
from quarry.plans import evalgrid as EG
from quarry.plans.score import story_prompt
from quarry.queries import duck as D
from quarry.queries.registry import Registry
from quarry.session import materialize, scratch_path
from quarry.sinks.files import write_csv, write_partitioned
from quarry.sources.files import read_csv_multiline
from quarry.sources.split_files import read_csv_split
from quarry.sources.tables import table

register = Registry()
QUERIES, ORACLE = register.queries, register.oracle


LEVELS = (1, 3, 5)
STORY = ("'Order ' || CAST(o_orderkey AS VARCHAR) || ' was placed on ' || strftime(o_orderdate, '%Y-%m-%d') || '.' || chr(10) "
         "|| 'Customer \"' || CAST(o_custkey AS VARCHAR) || '\" paid ' || printf('%.2f', o_totalprice) || '.'")
STORIES = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS Instruction, o_orderpriority AS Category, {STORY} AS BaseStory,
       {D.fill(TP.STORY, story=STORY, constraints="'{constraints}'")} AS Final_prompt FROM orders"""
CONSTRAINTS = """
SELECT l_partkey AS "Instruction Number", CAST(l_orderkey AS VARCHAR) AS "Instruction ", l_linenumber AS "Number of Constraints",
       'Ship on ' || strftime(l_shipdate, '%Y-%m-%d') || ', quantity ' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR)
       || ', flag ' || l_returnflag AS Constraints FROM lineitem"""
LV = ", ".join(str(x) for x in LEVELS)
JOINED = f"""
SELECT s.Instruction, s.Category, s.BaseStory, s.Final_prompt, c."Instruction Number" AS Instruction_Number,
       c."Number of Constraints" AS Number_of_Constraints, c.Constraints AS SelectedConstraints, '{EG.DIRECTION}' AS Direction
FROM ({STORIES}) s JOIN ({CONSTRAINTS}) c ON s.Instruction IS NOT DISTINCT FROM c."Instruction " """
JOINED_COLS = ["Instruction", "Category", "BaseStory", "Final_prompt", "Instruction_Number", "Number_of_Constraints",
               "SelectedConstraints", "Direction"]
JOINED_SCHEMA = ("Instruction string, Category string, BaseStory string, Final_prompt string, Instruction_Number bigint, "
                 "Number_of_Constraints int, SelectedConstraints string, Direction string")


def _matched(spark, sf):
    return EG.match_constraints(EG.story_keys(table(spark, sf, "orders")), EG.constraint_keys(table(spark, sf, "lineitem")))


def _joined(spark, sf):
    """Generation tasks; their texts are made after the join."""
    return EG.generation_tasks(_matched(spark, sf), EG.late_texts())


# J-1 ---------------------------------------------------------------------------------------------
@register("join_prompt_constraints", JOINED)
def join_prompt_constraints(spark, sf):
    return _joined(spark, sf)


# T-8 (story prompt on joined rows) ---------------------------------------------------------------
@register("txt_prompt_story", f"""
SELECT Instruction, Instruction_Number, Number_of_Constraints, {D.fill(TP.STORY, story="BaseStory", constraints="SelectedConstraints")} AS prompt
FROM ({JOINED})""")
def txt_prompt_story(spark, sf):
    """The revision prompt of every joined row, from its own story and constraints."""
    return _joined(spark, sf).select("Instruction", "Instruction_Number", "Number_of_Constraints",
                                     story_prompt(F.col("BaseStory"), F.col("SelectedConstraints")).alias("prompt"))


# F-8 ---------------------------------------------------------------------------------------------
@register("filter_level_in", f"""
SELECT "Instruction " AS instruction, "Instruction Number" AS instruction_number, "Number of Constraints" AS level
FROM ({CONSTRAINTS}) WHERE "Number of Constraints" IN ({LV})""")
def filter_level_in(spark, sf):
    c = FL.level_in(EG.constraint_sets(table(spark, sf, "lineitem")), LEVELS, "Number of Constraints")
    return c.select(F.col("Instruction ").alias("instruction"), F.col("Instruction Number").alias("instruction_number"),
                    F.col("Number of Constraints").alias("level"))


# P-3 ---------------------------------------------------------------------------------------------
@register("proj_rename_tag", f"""
SELECT "Instruction " AS Instruction, "Number of Constraints" AS Number_of_Constraints, Constraints AS SelectedConstraints,
       '{EG.DIRECTION}' AS Direction FROM ({CONSTRAINTS})""")
def proj_rename_tag(spark, sf):
    c = EG.constraint_sets(table(spark, sf, "lineitem")).select("Instruction ", "Number of Constraints", "Constraints")
    return c.withColumnsRenamed({"Instruction ": "Instruction", "Number of Constraints": "Number_of_Constraints",
                                 "Constraints": "SelectedConstraints"}).withColumn("Direction", F.lit(EG.DIRECTION))


# J-3 ---------------------------------------------------------------------------------------------
@register("join_job_grid", f"""
SELECT source AS model, CAST(level AS INTEGER) AS level
FROM (SELECT DISTINCT source FROM documents), (SELECT unnest([{', '.join(map(str, EG.STORY_LEVELS))}]) AS level)""")
def join_job_grid(spark, sf):
    models = table(spark, sf, "documents", balance=False).select(F.col("source").alias("model")).distinct()
    return EG.job_grid(models, "model", EG.STORY_LEVELS, "level")


# J-4 ---------------------------------------------------------------------------------------------
LANGS = ("de", "en", "es", "fr", "it")


@register("join_coverage", f"""
SELECT g.model, g.lang, CASE WHEN r.source IS NULL THEN 'missing' ELSE 'done' END AS status
FROM (SELECT source AS model, lang FROM (SELECT DISTINCT source FROM documents),
      (SELECT unnest([{', '.join(repr(x) for x in LANGS)}]) AS lang)) g
LEFT JOIN (SELECT DISTINCT source, lang AS rl FROM documents) r ON g.model = r.source AND g.lang = r.rl""")
def join_coverage(spark, sf):
    docs = table(spark, sf, "documents", balance=False)
    grid = EG.job_grid(docs.select(F.col("source").alias("model")).distinct(), "model", LANGS, "lang")
    return EG.coverage(grid, docs.select(F.col("source").alias("model"), "lang"), ["model", "lang"])


# J-5 / T-19 / T-12 -------------------------------------------------------------------------------
def _values(rows, cols):
    def q(v):
        return "NULL" if v is None else (str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'")
    return "(VALUES " + ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows) + f") AS t({', '.join(cols)})"


BENCH_DIM = _values([(a, t, EG.LIMIT_BENCHMARKS.get(a)) for a, t in EG.BENCHMARKS.items()], ["benchmark", "task", "row_limit"])
ADAPTER_DIM = _values(list(EG.ADAPTER_PREFIX.items()), ["family", "adapter_prefix"])
STATUSES = "[" + ", ".join(f"'{s}'" for s, _ in EG.FAMILY_BY_STATUS) + "]"
FAMILIES = "[" + ", ".join(f"'{f}'" for _, f in EG.FAMILY_BY_STATUS) + "]"
ALIASES = "[" + ", ".join(f"'{a}'" for a in EG.BENCHMARKS) + "]"
SIZES = "[" + ", ".join(map(str, EG.SAMPLE_SIZES)) + "]"
DIGIT = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"
SIDX = f"CAST(list_position({STATUSES}, o_orderstatus) AS INTEGER)"
JOBS = f"""
SELECT o_orderkey, {FAMILIES}[{SIDX}] AS family, {SIZES}[{DIGIT}] AS n,
       {ALIASES}[({DIGIT} - 1) * {len(EG.FAMILY_BY_STATUS)} + {SIDX}] AS benchmark FROM orders"""
LOOKUP = f"""
SELECT j.o_orderkey, j.family, j.n, j.benchmark, b.task, b.row_limit,
       CASE WHEN NOT starts_with(b.task, '{EG.FEWSHOT_EXEMPT_PREFIX}') THEN {EG.DEFAULT_NUM_FEWSHOT} END AS num_fewshot,
       CASE WHEN a.adapter_prefix IS NOT NULL THEN a.adapter_prefix || CAST(j.n AS VARCHAR) END AS adapter
FROM ({JOBS}) j LEFT JOIN (SELECT * FROM {BENCH_DIM}) b ON j.benchmark = b.benchmark
LEFT JOIN (SELECT * FROM {ADAPTER_DIM}) a ON j.family = a.family"""


def _lookup(spark, sf):
    return EG.dimension_lookup(EG.harness_jobs(table(spark, sf, "orders")), spark)


@register("join_dimension_lookup", LOOKUP)
def join_dimension_lookup(spark, sf):
    return _lookup(spark, sf)


@register("task_flag_prefix", f"SELECT o_orderkey, task, num_fewshot FROM ({LOOKUP})")
def task_flag_prefix(spark, sf):
    return _lookup(spark, sf).select("o_orderkey", "task", "num_fewshot")


@register("txt_config_parse", f"""
SELECT o_orderkey, cfg AS config, split_part(cfg, '_', 1) AS type, TRY_CAST(string_split(cfg, '_')[-1] AS INTEGER) AS n,
       CASE WHEN TRY_CAST(string_split(cfg, '_')[-1] AS INTEGER) IS NOT NULL
            THEN split_part(cfg, '_', 1) || '_n' || CAST(TRY_CAST(string_split(cfg, '_')[-1] AS INTEGER) AS VARCHAR) END AS label,
       'Model (' || string_split(adapter, '_')[-1] || ')' AS short_label
FROM (SELECT o_orderkey, adapter, family || '_' || CASE WHEN family = 'base' THEN 'model' ELSE CAST(n AS VARCHAR) END AS cfg FROM ({LOOKUP}))""")
def txt_config_parse(spark, sf):
    lk = _lookup(spark, sf)
    cfg = F.concat("family", F.lit("_"), F.when(F.col("family") == "base", F.lit("model")).otherwise(F.col("n").cast("string")))
    typ, n, label = EG.config_parse(F.col("config"))
    return lk.select("o_orderkey", "adapter", cfg.alias("config")).select(
        "o_orderkey", "config", typ.alias("type"), n.alias("n"), label.alias("label"),
        EG.short_label(F.col("adapter"), "Model").alias("short_label"))


# J-6 ---------------------------------------------------------------------------------------------
@register("join_side_by_side", """
SELECT conv_id, CAST(turn // 4 AS BIGINT) AS pair, max(text) FILTER (WHERE (turn // 2) % 2 = 0) AS base,
       max(text) FILTER (WHERE (turn // 2) % 2 = 1) AS tuned
FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn // 4""")
def join_side_by_side(spark, sf):
    """All assistant turns of a conversation, paired by position: of every four turns the first exchange's answer is the base model's and
    the second one's the tuned model's."""
    conv = table(spark, sf, "conversations")
    exchange = F.floor(F.col("turn") / 2)
    answers = conv.where(F.col("role") == "assistant").select(
        "conv_id", F.floor(F.col("turn") / 4).cast("bigint").alias("pair"),
        F.when(exchange % 2 == 0, F.lit("base")).otherwise(F.lit("tuned")).alias("model"), "text")
    return EG.side_by_side(answers, ["conv_id", "pair"], "model", "text")


# F-9 ---------------------------------------------------------------------------------------------
RESERVED = ", ".join(f"('{x}')" for x in FL.RESERVED_DIRS)


@register("filter_model_dirs", f"""
SELECT model FROM (SELECT DISTINCT source AS model FROM documents UNION ALL SELECT * FROM (VALUES {RESERVED}) AS r(model))
WHERE model NOT IN ({', '.join(repr(x) for x in FL.RESERVED_DIRS)}) AND contains(model, 'src1')""")
def filter_model_dirs(spark, sf):
    names = table(spark, sf, "documents", balance=False).select(F.col("source").alias("model")).distinct()
    listing = names.unionByName(spark.createDataFrame([(x,) for x in FL.RESERVED_DIRS], "model string"))
    return FL.model_dirs(listing, "model", FL.RESERVED_DIRS, contains="src1")


# SNK-6 / SRC-3 -----------------------------------------------------------------------------------
@register("snk_partitioned", JOINED)
def snk_partitioned(spark, sf):
    """Write the joined generation tasks as one CSV folder per constraint level, read them back."""
    by_level = _matched(spark, sf).sortWithinPartitions("Number of Constraints")  # the writer's order, before rows carry texts
    path = write_partitioned(EG.generation_tasks(by_level, EG.late_texts()), scratch_path(spark, "levels"), ["Number_of_Constraints"], "csv",
                             compression="gzip")
    schema = ", ".join(p for p in JOINED_SCHEMA.split(", ") if not p.startswith("Number_of_Constraints"))
    back = read_csv_multiline(spark, path, schema + ", Number_of_Constraints int")
    return back.select(*JOINED_COLS)


@register("src_csv_multiline", JOINED.replace("SELECT s.Instruction,", "SELECT s.Instruction,", 1))
def src_csv_multiline(spark, sf):
    """Round trip through the pandas CSV dialect: quoted newlines and doubled quotes survive."""
    path = write_csv(_joined(spark, sf), scratch_path(spark, "stories-csv"), compression="gzip")
    return read_csv_multiline(spark, path, JOINED_SCHEMA)


# SRC-3 by byte ranges
@register("src_csv_split", JOINED)
def src_csv_split(spark, sf):
    """The same files read by byte ranges: records are found by quote parity, no file is one task."""
    path = write_csv(_joined(spark, sf), scratch_path(spark, "stories-csv"))
    return read_csv_split(spark, path, JOINED_SCHEMA)


@register("snk_csv", JOINED)
def snk_csv(spark, sf):
    path = write_csv(_joined(spark, sf), scratch_path(spark, "stories-csv"), compression="gzip")
    return read_csv_multiline(spark, path, JOINED_SCHEMA)


# U-2 ---------------------------------------------------------------------------------------------
@register("union_level_files", JOINED.replace("s.Category,", "CASE WHEN c.\"Number of Constraints\" = 3 THEN NULL ELSE s.Category END AS Category,", 1))
def union_level_files(spark, sf):
    """A folder of per-level files of one model, the level-3 files without ``Category``: the join runs once, writes one
    folder per level, and the folder is read back and unioned by name with the missing column as null."""
    matched = materialize(_matched(spark, sf), "joined-levels")  # without texts
    root = scratch_path(spark, "constraint-files")
    level = F.col("Number of Constraints")

    def write(rows, folder, *without):
        tasks = EG.generation_tasks(rows.sortWithinPartitions(level), EG.late_texts()).drop(*without)
        write_partitioned(tasks.withColumn("level", F.col("Number_of_Constraints")), f"{root}/{folder}", ["level"], "csv", compression="gzip")
    write(matched.where(level != 3), "full")
    write(matched.where(level == 3), "short", "Category")
    short = ", ".join(p for p in JOINED_SCHEMA.split(", ") if not p.startswith("Category"))
    frames = EG.read_level_files(spark, {f"{root}/full": JOINED_SCHEMA, f"{root}/short": short})
    return EG.union_level_files(frames).select(*JOINED_COLS)
