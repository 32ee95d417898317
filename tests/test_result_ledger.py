"""Loads read only what is new; rewritten, removed and retried files leave the store equal to a full rebuild."""

import json
import os
import shutil

from quarry.plans import result_ledger as L
from quarry.plans import results as R


def _put(root, config, run, acc):
    folder = f"{root}/family=fif/task=arc/config={config}/model=m+1 é/run={run}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/part-00000.txt", "w", encoding="utf-8") as f:
        json.dump({"results": {"arc_challenge": {"acc,none": acc, "alias": "arc"}}}, f, indent=2)
    return folder


def _same_as_rebuild(spark, root, store):
    cols = ["task", "label", "run_ts", "acc"]
    full = R.unified_metrics(R.read_harness_folders(spark, root))
    rows = sorted(tuple(r) for r in L.current_rows(spark, store).select(*cols).collect())
    assert rows == sorted(tuple(r) for r in full.select(*cols).collect())
    got = {(r.label, r.run_ts, r.acc, r.n_runs) for r in L.current_labels(spark, store).collect()}
    count = {r["label"]: r["count"] for r in full.groupBy("label").count().collect()}
    assert got == {(r.label, r.run_ts, r.acc, count[r.label]) for r in R.latest_per_label(full).collect()}


def test_loads_follow_arrivals_rewrites_and_removals(spark, tmpdir_fresh):
    root, store = f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/store"
    for i in range(3):
        _put(root, "lora_n8", f"2024010{i + 1}_000000", 0.1 * (i + 1))
    _put(root, "base_model", "20240101_000000", 0.5)
    assert L.load_new(spark, root, store) == 4
    _same_as_rebuild(spark, root, store)
    assert L.load_new(spark, root, store) == 0  # a retry changes nothing
    old = _put(root, "lora_n8", "20240103_000000", 0.12345)  # the latest run, rewritten
    os.utime(f"{old}/part-00000.txt", (2_000_000_000, 2_000_000_000))
    _put(root, "lora_n16", "20240201_000000", 0.7)
    assert L.load_new(spark, root, store) == 2
    _same_as_rebuild(spark, root, store)
    shutil.move(old, f"{tmpdir_fresh}/elsewhere")  # gone from the tree
    assert L.load_new(spark, root, store) == 0
    _same_as_rebuild(spark, root, store)
    shutil.move(f"{tmpdir_fresh}/elsewhere", old)  # and back
    assert L.load_new(spark, root, store) == 1
    _same_as_rebuild(spark, root, store)


def test_a_load_that_died_before_its_ledger_is_done_again(spark, tmpdir_fresh):
    root, store = f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/store"
    _put(root, "lora_n8", "20240101_000000", 0.1)
    assert L.load_new(spark, root, store) == 1
    _put(root, "lora_n8", "20240102_000000", 0.2)
    assert L.load_new(spark, root, store) == 1
    shutil.move(f"{store}/ledger/load=2", f"{tmpdir_fresh}/lost")
    assert [r.n_runs for r in L.current_labels(spark, store).collect()] == [1]  # the unfinished load is not seen
    assert L.load_new(spark, root, store) == 1
    _same_as_rebuild(spark, root, store)
