"""The corpus pipeline over ``documents``: each stage is written as Parquet and read again as the next one's input.

1. quality: positive-unlabelled classifier; documents scored below 0.3 go.
2. near-duplicates: MinHash over five-word shingles at similarity 0.8; one document of each group stays.
3. decontamination: documents that contain a benchmark item (question and answer) go.
4. personal data: entities are masked in the text, disclosing terms generalised or removed; no document goes.
5. packing: what is left becomes sequences of at most 2048 tokens; one row per piece.

Stages 1 to 4 keep the columns of ``documents``; ``n_chars`` follows the text where stage 4 changes it. A stage judges the
rows its predecessor kept. Labels are read by document id, and only as the classifier's trusted positives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read_table
from quarry.llm.decontaminate import drop_leaks
from quarry.llm.neardup import deduplicate
from quarry.llm.packing import pack
from quarry.llm.pii import sanitize
from quarry.llm.quality_pu import fit, labelled_prior, with_quality
from quarry.llm.queries import benchmark_items, tokenizer_path
from quarry.session import scratch_path

#: A document is kept at or above this probability of good quality.
KEEP_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs, known.filter(F.col("quality") == 1), prior=labelled_prior(known))
    score = "quality_score"
    while score in docs.columns:
        score = f"_{score}"
    return with_quality(docs, model, score=score).filter(F.col(score) >= KEEP_SCORE).drop(score)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, benchmark_items(spark, sf_dir))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = sanitize(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=0, max_tokens=2048)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicate),
    ("benchmark decontamination", decontaminate),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: Neither the classifier nor the packing is an SQL query; tests/llm/test_pipeline.py holds run() against a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written under the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
