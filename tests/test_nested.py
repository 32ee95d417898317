"""Part files of a folder, in name order, are one valid JSON document: ties, equal rows, empty lists, odd strings, a hot document."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from quarry.sinks.nested import read_nested_documents, write_nested_documents

ODD = 'he said "]}",\n, "details": ['


def _document(root, run):
    parts = sorted(glob.glob(f"{root}/run={run}/part-*"))
    return json.loads("".join(open(p, encoding="utf-8").read() for p in parts)), len(parts)


def _tables(spark):
    heads = spark.createDataFrame([("hot", 1, ODD), ("one", 2, None), ("none", 3, "x")], "run string, n int, note string")
    hot = spark.range(5000).select(F.lit("hot").alias("run"), (F.col("id") % 50).alias("k"), F.lit("same").alias("text"))
    rest = spark.createDataFrame([("one", 7, ODD)], "run string, k bigint, text string")
    return heads, hot.unionByName(rest)


def test_concatenated_parts_are_one_document(spark, tmpdir_fresh):
    heads, details = _tables(spark)
    write_nested_documents(heads, details, f"{tmpdir_fresh}/out", ["run"], ["k"], rows_per_task=700)
    hot, parts = _document(f"{tmpdir_fresh}/out", "hot")
    assert parts >= 4 and hot["n"] == 1 and hot["note"] == ODD
    assert [d["k"] for d in hot["details"]] == sorted(i % 50 for i in range(5000))
    assert _document(f"{tmpdir_fresh}/out", "one")[0] == {"n": 2, "note": None, "details": [{"k": 7, "text": ODD}]}
    assert _document(f"{tmpdir_fresh}/out", "none")[0] == {"n": 3, "note": "x", "details": []}


def test_read_back_by_lines(spark, tmpdir_fresh):
    heads, details = _tables(spark)
    write_nested_documents(heads, details, f"{tmpdir_fresh}/out", ["run"], ["k"], rows_per_task=700)
    back = read_nested_documents(spark, f"{tmpdir_fresh}/out", "n int, note string", "k bigint, text string")
    got = back.where("detail IS NOT NULL").select("run", "detail.*")
    assert got.exceptAll(details).isEmpty() and details.exceptAll(got).isEmpty()
    got = back.where("head IS NOT NULL").select("run", "head.*")
    assert got.exceptAll(heads).isEmpty() and heads.exceptAll(got).isEmpty()


def test_details_without_a_head_are_refused(spark, tmpdir_fresh):
    heads, details = _tables(spark)
    with pytest.raises(ValueError, match="without a head"):
        write_nested_documents(heads.where("run <> 'one'"), details, f"{tmpdir_fresh}/out", ["run"], ["k"])
    with pytest.raises(ValueError, match="field of the head"):
        write_nested_documents(heads, details, f"{tmpdir_fresh}/out", ["run"], ["k"], name="note")
