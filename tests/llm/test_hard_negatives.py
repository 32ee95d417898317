import math

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import hard_negatives as hn
from quarry.llm.hard_negatives import _annulus

SCHEMA = "vec_id long, label int, embedding array<float>, id int, score double, w int, pid int"


def brute(rows, anchor, k=5, n=10, window=(30, 90)):
    """All pairs, by the definition, on (id, label, integer vector)."""
    out = []
    for a, tag, q in rows:
        if not anchor(a):
            continue
        scored = sorted((-int(np.dot(q, v)), i, t) for i, t, v in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == tag][:k]:
            fit = [x for x in scored if x[2] != tag and window[0] * -s <= 100 * -x[0] <= window[1] * -s][:n]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def quantised(rows):
    dims = max((len(v) for *_, v in rows), default=0)
    return [(i, t, np.array([math.floor(256 * float(np.float32(x))) for x in v] + [0] * (dims - len(v)), np.int64)) for i, t, v in rows]


def mined(spark, rows, every=5, **kw):
    docs = spark.createDataFrame([(*r, 1, 2.0, 3, 4) for r in rows], SCHEMA).repartition(3)
    got = hn.mine(docs, "vec_id", F.col("label"), "embedding", F.col("id") % every == 0, **kw)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(seed, n, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(i, int(rng.integers(0, 4)), (centres[rng.integers(0, 6)] + 0.3 * rng.normal(size=dims)).tolist()) for i in range(n)]


def test_equal_to_all_pairs_with_many_leaves_and_copies(spark):
    rows = clustered(1, 500)
    rows += [(1000 + i, i % 3, [1.0] * 8) for i in range(200)]          # one very common vector
    got = mined(spark, rows, every=20, leaf_rows=16, cell_rows=100)
    assert got == brute(quantised(rows), lambda i: i % 20 == 0) and got


def test_rows_that_take_no_part_and_odd_shapes(spark):
    rows = clustered(2, 60, 4)
    odd = [(100, None, [1.0] * 4), (105, 1, None), (110, 1, [1.0, None, 0.0, 0.0]), (115, 1, [float("nan"), 0.0, 0.0, 0.0]),
           (120, 1, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, [1.0] * 4)]
    short = [(200, 1, [0.5]), (205, 2, []), (210, 1, [0.0] * 4)]
    got = mined(spark, rows + odd + short, leaf_rows=8)
    assert got == brute(quantised(rows + short), lambda i: i % 5 == 0)
    twice = [(5, 3, [2.0] * 4), (5, 0, [1.0] * 4)]                       # of a repeated id the smallest (label, vector) counts
    kept = [r for r in rows if r[0] != 5] + [(5, 0, [1.0] * 4)]
    assert mined(spark, [r for r in rows if r[0] != 5] + twice) == brute(quantised(kept), lambda i: i % 5 == 0)
    assert mined(spark, []) == [] and mined(spark, odd[:2]) == [] and mined(spark, rows[:1]) == []


def test_walk_leaves_out_only_leaves_that_cannot_qualify():
    rows = clustered(3, 3000, 6)
    x = np.array([v for _, _, v in quantised(rows)], float)
    tree = hn.plant(x[::3], float((x * x).sum(1).max()), 64)
    leaf, lifted = tree.leaf_of(x), tree.lift(x)
    low = {k: hn._distance(lifted[leaf == k], tree.above(k)).min(0) for k in set(leaf.tolist())}
    high = {k: hn._distance(lifted[leaf == k], tree.above(k)).max(0) for k in low}
    tree.set_ranges(low, high)
    a, s = x[:50], x[:50] @ x.T
    lo, hi = np.quantile(s, 0.97, axis=1).astype(np.int64), np.quantile(s, 0.995, axis=1).astype(np.int64)
    seen = tree.visits(a, *_annulus(tree, a, lo, hi))
    for i in range(50):
        assert seen[i, leaf[(s[i] >= lo[i]) & (s[i] <= hi[i])]].all()
    assert seen.mean() < 0.6        # and it does leave out leaves
