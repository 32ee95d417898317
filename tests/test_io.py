"""Sources and sinks on hand-made files shaped like the reference's (fresh temp dir per test)."""

import json
import os

import pandas as pd
from pyspark.sql import functions as F

from quarry.plans import results as R
from quarry.sinks.files import comparison_doc, write_json_array, write_kv_summary
from quarry.sources.files import read_csv_multiline, read_json_array, read_result_tree, read_task_dir


def _dump(path, obj, indent=2):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(obj, f, indent=indent)


def test_result_tree_pretty_files(spark, tmpdir_fresh):
    root = tmpdir_fresh
    doc = {"results": {"arc_challenge": {"alias": "arc_challenge", "acc,none": 0.0, "exact_match,strict-match": 0.42,
                                         "acc_stderr,none": "N/A"}, "other": {"acc,none": 0.1}}}
    _dump(f"{root}/fif/arc_challenge/lora_n8/run_20240101_000000/results_2024-01-01T00-00-00.json", doc)
    _dump(f"{root}/fif/arc_challenge/lora_n8/run_20240201_000000/results_2024-02-01T00-00-00.json", doc)
    _dump(f"{root}/ben/arc_challenge/base_model/run_20240101_000000/results_x.json", doc)
    _dump(f"{root}/ben/arc_challenge/base_model/run_20240101_000000/samples_x.json", {"junk": 1})
    df = read_result_tree(spark, root, R.RESULT_SCHEMA)
    fam = df.select(F.regexp_extract("file_path", r"/(fif|ben)/", 1).alias("family"),
                    F.regexp_extract("file_path", r"/arc_challenge/([^/]+)/", 1).alias("config"),
                    F.regexp_extract("file_path", r"run_([0-9_]+)/", 1).alias("run"), "results")
    assert fam.count() == 3  # the samples file is not a result file
    m = fam.select("family", "config", "run", R.first_task(F.col("results")).alias("task"),
                   R.first_truthy(F.col("results")["arc_challenge"], R.ACC_KEYS).try_cast("double").alias("acc"))
    rows = sorted((r.family, r.config, r.run, r.task, r.acc) for r in m.collect())
    assert rows[0] == ("ben", "base_model", "20240101_000000", "arc_challenge", 0.42)


def test_task_dir_first_k(spark, tmpdir_fresh):
    for i in (3, 1, 2, 10):
        _dump(f"{tmpdir_fresh}/task_{i:02d}.json", {"train": [{"input": [[i]], "output": [[i, i]]}],
                                                     "test": [{"input": [[i]], "output": [[i]]}]})
    schema = "train array<struct<input:array<array<bigint>>, output:array<array<bigint>>>>, test array<struct<input:array<array<bigint>>, output:array<array<bigint>>>>"
    got = sorted(r.task_file for r in read_task_dir(spark, tmpdir_fresh, schema, limit=2).collect())
    assert got == ["task_01.json", "task_02.json"]
    assert read_task_dir(spark, tmpdir_fresh, schema).count() == 4


def test_json_array_round_trip(spark, tmpdir_fresh):
    with open(f"{tmpdir_fresh}/records.json", "w") as f:
        json.dump([{"id": "a", "upvotes": 3}, {"id": "b"}], f, indent=2)
    df = read_json_array(spark, f"{tmpdir_fresh}/records.json", "id string, upvotes bigint")
    assert sorted((r.id, r.upvotes) for r in df.collect()) == [("a", 3), ("b", None)]
    out = write_json_array(spark.range(25).select(F.col("id").cast("string").alias("id")).repartition(3), f"{tmpdir_fresh}/arr")
    back = read_json_array(spark, out, "id string", per_line=True)
    assert sorted(int(r.id) for r in back.collect()) == list(range(25))
    for name in os.listdir(out):
        if name.endswith(".txt"):
            with open(f"{out}/{name}") as f:
                assert all(json.loads(line) for line in f)  # every line is one valid JSON array


def test_reference_layout_trees(spark, tmpdir_fresh):
    """``<root>/<task>/<config>/<model>/results_<stamp>.json`` and ``<root>/<trait>/<file>.json``, indented, one root per family;
    a file that does not parse is reported and gives no result row."""
    doc = {"results": {"gsm8k": {"alias": "gsm8k", "acc,none": 0.0, "exact_match,get-answer": 0.42, "acc_stderr,none": "N/A"}}}
    for fam, cfg in (("a", "lora_n8"), ("a", "base_model"), ("b", "lora_n8")):
        for stamp in ("2024-01-02T03-04-05.123456", "20240301_000000"):
            _dump(f"{tmpdir_fresh}/{fam}/gsm8k/{cfg}/org__model/results_{stamp}.json", doc)
    _dump(f"{tmpdir_fresh}/b/gsm8k/lora_n8/org__model/samples_x.jsonl", {"junk": 1})
    with open(f"{tmpdir_fresh}/b/gsm8k/lora_n8/org__model/results_bad.json", "w") as f:
        f.write("{ not json")
    files = R.read_harness_tree(spark, {"fif": f"{tmpdir_fresh}/a", "ben": f"{tmpdir_fresh}/b"})
    assert files.count() == 7 and [r.file_path.rsplit("/", 1)[1] for r in R.unreadable_files(files).collect()] == ["results_bad.json"]
    rows = R.unified_metrics(files).collect()
    assert len(rows) == 6 and {r.label for r in rows} == {"fif_n8", "base", "ben_n8"}
    assert all(r.acc == 0.42 and r.acc_stderr is None and r.run_ts is not None for r in rows)
    assert R.long_metrics(R.unified_metrics(files)).count() == 24
    for fam, file in (("a", "lora_n8_20240101.json"), ("a", "base.json"), ("b", "lora_n8_20240101.json")):
        _dump(f"{tmpdir_fresh}/t{fam}/Openness/{file}", {"config": {"trait_key": "Openness"}, "results": {
            "high_trait_rate": 0.5, "high_trait_count": 5, "total": 10}, "detailed_results": []})
    got = R.results_by_trait(R.read_trait_tree(spark, {"fif": f"{tmpdir_fresh}/ta", "ben": f"{tmpdir_fresh}/tb"})).collect()
    assert sorted((r.trait, r.label, r.rate, r["count"], r.total, r.n_loaded) for r in got) == [
        ("Openness", lab, 0.5, 5, 10, 3) for lab in ("base", "ben_n8", "fif_n8")]


def test_csv_pandas_dialect(spark, tmpdir_fresh):
    pdf = pd.DataFrame({"Instruction": ['say "hi"', "two\nlines", "comma, here"], "n": [1, 2, 3]})
    pdf.to_csv(f"{tmpdir_fresh}/stories.csv", index=False)
    df = read_csv_multiline(spark, f"{tmpdir_fresh}/stories.csv", "Instruction string, n int")
    assert sorted((r.Instruction, r.n) for r in df.collect()) == sorted(zip(pdf.Instruction, pdf.n))


def test_kv_summary_and_comparison(spark, tmpdir_fresh):
    df = spark.createDataFrame([("mean_Dist_1", 0.5)], "key string, value double")
    path = write_kv_summary(df, f"{tmpdir_fresh}/summary")
    assert [r.value for r in spark.read.text(path).collect()] == ["mean_Dist_1: 0.5"]
    base = spark.createDataFrame([("t1", 0.5), ("t2", 0.3)], "task string, v double")
    var = spark.createDataFrame([("t1", 0.6)], "task string, v double")
    doc = {r.task: (r.base_results, r.lora_results) for r in comparison_doc(base, var, ["task"]).collect()}
    assert doc["t2"][1] is None and doc["t1"][1].v == 0.6
