import hashlib
import random

from pyspark.sql import functions as F

from quarry.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(groups, fanout):
    """groups: {group: [leaf, ...]} in order. Subroots, root and per (group, place) the siblings level by level."""
    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
            for k, i in enumerate(at):
                run = runs[i // fanout]
                paths[k].append(("".join(run[:i % fanout]), "".join(run[i % fanout + 1:])))
            at = [i // fanout for i in at]
            nodes = [H(*r) for r in runs]
        return (nodes[0] if nodes else None), paths
    subs, paths = {}, {}
    for g, leaves in groups.items():
        subs[g], paths[g] = climb(leaves)
    root, tops = climb([subs[g] for g in groups])
    return subs, root, {(g, i): p + top for (g, top) in zip(groups, tops, strict=True) for i, p in enumerate(paths[g])}


def check(spark, rows, fanout):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _row int, idx string, hash string, row int, g int")
    fields = ["doc_id", "source", "text"]
    made = merkle.manifest(docs, merkle.leaf_digest([F.col(c) for c in fields]), row=F.struct("doc_id", "source"), fanout=fanout)
    got = sorted((r.row.source or "", r.row.source is not None, r.row.doc_id is not None, r.row.doc_id or 0, r.leaf, r.subroot, tuple(map(tuple, r.path)))
                 for r in made.proofs().collect())
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, H(*[enc(v) for v in r[:3]]))):
        groups.setdefault(r[1], []).append((r[0], H(*[enc(v) for v in r[:3]])))
    subs, root, paths = brute({g: [x[1] for x in v] for g, v in groups.items()}, fanout)
    want = sorted((g or "", g is not None, i is not None, i or 0, leaf, subs[g], tuple(paths[g, k]))
                  for g, v in groups.items() for k, (i, leaf) in enumerate(v))
    assert made.root == root and got == want
    folded = made.proofs().select(merkle.fold(F.col("leaf"), F.col("path")).alias("r")).distinct().collect()
    assert [r.r for r in folded] == [root] * (len(rows) > 0)


def test_trees_equal_a_plain_fold(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "é", "Z", None]), f"text {i}") for i in range(400)] + [(1000, "lone", "x")]
    rows = [(*r, 1, "x", "y", 2, 3) for r in rows]
    check(spark, rows, 16)
    check(spark, rows[:12], 2)


def test_nulls_ties_repeats_and_single_rows(spark):
    extra = (1, "x", "y", 2, 3)
    rows = [(None, None, None, *extra), (None, None, "a", *extra), (5, "s", None, *extra), (5, "s", "", *extra), *[(7, "s", "same", *extra)] * 40]
    check(spark, rows, 16)
    check(spark, rows[:1], 16)
    check(spark, [], 16)


def test_a_changed_row_does_not_fold_to_the_root(spark):
    docs = spark.createDataFrame([(i, "s", f"Text {i}") for i in range(50)], "doc_id long, source string, text string")
    made = merkle.manifest(docs, merkle.leaf_digest([F.col("text")]))
    bad = made.proofs().withColumn("r", merkle.fold(F.when(F.col("row") == 7, merkle.leaf_digest([F.lit("text 7")])).otherwise(F.col("leaf")), F.col("path")))
    assert [r.row for r in bad.filter(F.col("r") != made.root).collect()] == [7]
    assert {r.level for r in made.nodes().collect()} == {0, 1, 2}
