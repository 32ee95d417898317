"""Hard negatives for contrastive training, searched with a GNAT-style multiway hyperplane tree.

A row is an id, a label and an integer vector; rows are scored by inner product. For every anchor the ``positives`` best other rows of
its label are found, and for each (anchor, positive) the ``negatives`` best rows of other labels whose score lies
within a window given in percent of the positive's score.

1. Vectors get one more coordinate that makes their norms equal, so that a larger inner product is a smaller distance and a window of
   scores is an annulus around the anchor.
2. The tree's split points are chosen on a sample (about ``SAMPLE`` rows by hash of the id, the only thing fitted on the driver). A row
   goes to the nearest split point of each node, down to a leaf. All rows are indexed: they are range-partitioned by
   (leaf, id) and written, so a leaf of any size is spread over partitions of equal size.
3. For every split point the range of its distances to the rows of each sibling subtree is gathered from all rows: at most
   ``LEAVES`` leaves times the split points above each, whatever the table's size.
4. An anchor walks the tree with its annulus and leaves out every subtree whose range does not meet it. What
   is left are cells (a partition of rows, a block of anchors), each one task's group of bounded size; inside a cell leaves are
   searched exactly, and a leaf goes too once the best rows found bound it out. Positives are first searched in the anchor's own
   leaf, which gives the annulus for the whole tree.

The result is exact: ranges only rule out rows that cannot qualify.

Defined cases: rows with a null id, label or vector, or a null, NaN or infinite component take no part; of rows that repeat an id
the smallest (label, vector) counts; shorter vectors end in zeros; components beyond +-2**20 after scaling count as that bound;
ties go to the smaller id; an anchor without positives, or a positive whose window is empty, gives no rows; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize

FANOUT = 8
LEAF_ROWS = 512
LEAVES = 4096
SAMPLE = 16_384
CELL_ROWS = 4096
CELLS = 16_384
ANCHORS = 4096
LARGEST = 2 ** 20
_SLICE, _AT_ONCE = 4096, 512
_NONE = -2 ** 62


@dataclass
class _Node:
    points: np.ndarray                      # split points, with the added coordinate
    children: list                          # nodes, or leaf numbers
    low: np.ndarray = field(default=None)   # low[i, j]: least distance of split point i to the rows below child j
    high: np.ndarray = field(default=None)


@dataclass
class Tree:
    root: _Node | int
    leaves: int
    paths: list             # per leaf: [(node, child), ...] from the root
    norm2: float            # squared norm of every lifted vector

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest split point of every node on the way."""
        lifted, out = self.lift(x), np.zeros(len(x), np.int32)

        def down(node, at: np.ndarray) -> None:
            if isinstance(node, int):
                out[at] = node
            elif len(at):
                near = _distance(lifted[at], node.points).argmin(1)
                for j, child in enumerate(node.children):
                    down(child, at[near == j])
        down(self.root, np.arange(len(x)))
        return out

    def above(self, leaf: int) -> np.ndarray:
        """The split points of all nodes over a leaf."""
        return np.concatenate([n.points for n, _ in self.paths[leaf]]) if self.paths[leaf] else np.empty((0, 0))

    def set_ranges(self, low: dict, high: dict) -> None:
        """Ranges of all nodes from those of the leaves: per leaf the distances to the split points of ``above``."""
        for leaf, path in enumerate(self.paths):
            at = 0
            for node, j in path:
                k = len(node.points)
                if node.low is None:
                    node.low, node.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
                if leaf in low:
                    node.low[:, j] = np.minimum(node.low[:, j], low[leaf][at:at + k])
                    node.high[:, j] = np.maximum(node.high[:, j], high[leaf][at:at + k])
                at += k

    def visits(self, anchors: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """(anchors x leaves): the leaves that may hold rows at a distance of ``near`` to ``far`` from each anchor."""
        out = np.zeros((len(anchors), self.leaves), bool)
        flat = np.concatenate([anchors, np.zeros((len(anchors), 1))], axis=1)

        def down(node, at: np.ndarray) -> None:
            if isinstance(node, int):
                out[at, node] = True
            elif len(at):
                d = _distance(flat[at], node.points)
                for j, child in enumerate(node.children):
                    low, high = node.low[:, j], node.high[:, j]
                    alive = ((d + far[at, None] >= low) & (d - far[at, None] <= high) & (d + high >= near[at, None])).all(1)
                    down(child, at[alive])
        down(self.root, np.flatnonzero(near <= far))
        return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0.0))


def plant(sample: np.ndarray, norm2: float, leaves: int, fanout: int = FANOUT) -> Tree:
    """A tree with about ``leaves`` leaves over the sample; split points are spread out greedily (farthest first)."""
    tree = Tree(0, 0, [], norm2)
    lifted = tree.lift(sample)
    depth = math.ceil(math.log(max(leaves, 1), fanout) - 1e-9)
    rng = np.random.default_rng(0)

    def grow(at: np.ndarray, level: int, path: list):
        some = at if len(at) <= 3 * fanout else rng.choice(at, 3 * fanout, replace=False)
        chosen: list[int] = []
        if level < depth and len(at):
            far = np.full(len(some), np.inf)
            while len(chosen) < fanout and far.max() > 0:
                chosen.append(int(some[far.argmax()]))
                far = np.minimum(far, _distance(lifted[some], lifted[chosen[-1:]])[:, 0])
                far[far < 1e-3 * math.sqrt(norm2 + 1)] = 0.0
        if len(chosen) < 2:
            tree.paths.append(path)
            tree.leaves += 1
            return tree.leaves - 1
        node = _Node(lifted[chosen], [])
        near = _distance(lifted[at], node.points).argmin(1)
        for j in range(len(chosen)):
            node.children.append(grow(at[near == j], level + 1, [*path, (node, j)]))
        return node
    tree.root = grow(np.arange(len(sample)), 0, [])
    return tree


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.int32).reshape(len(raw), dims).astype(float) if raw else np.empty((0, dims))


def prepare(rows: DataFrame, key: str, label: Column, vector: str, scale: float) -> DataFrame:
    """(id, label, q): the rows that take part, one per id, components scaled, rounded down."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    q = F.transform(x, lambda v: F.floor(F.greatest(F.least(scale * v, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    kept = rows.filter(F.col(key).isNotNull() & label.isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), q.alias("q")) \
        .groupBy("id").agg(F.min(F.struct("label", "q")).alias("x")).select("id", "x.label", "x.q")


@dataclass
class Index:
    """All rows by (leaf, id) over equal partitions, and the tree with its ranges."""

    rows: DataFrame         # pid, leaf, id, label, q (int32 bytes)
    tree: Tree
    dims: int
    cells: dict             # pid -> leaves that it holds


def build(rows: DataFrame, leaf_rows: int = LEAF_ROWS, cell_rows: int = CELL_ROWS) -> Index | None:
    """The index over prepared rows; none if there are no rows."""
    rows = materialize(rows.withColumn("norm2", F.aggregate("q", F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v)), "vectors")
    n, norm2, dims = rows.agg(F.count(F.lit(1)), F.max("norm2"), F.max(F.size("q"))).first()
    if not n:
        return None
    dims = max(dims, 1)
    share = min(1.0, SAMPLE / n)
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "q").toPandas().sort_values("id")
    if not len(some):
        some = rows.select("id", "q").limit(1).toPandas()

    def padded(lists) -> np.ndarray:
        out = np.zeros((len(lists), dims), np.int32)
        for i, v in enumerate(lists):
            out[i, :len(v)] = v
        return out

    tree = plant(padded(some["q"].tolist()).astype(float), float(norm2), min(LEAVES, n // leaf_rows))

    def place(batches):
        for b in batches:
            q = padded(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf_of(q.astype(float))), b.column(0), b.column(1),
                                              pa.array([v.tobytes() for v in q], pa.binary())], ["leaf", "id", "label", "q"])

    placed = rows.select("id", "label", "q").mapInArrow(place, "leaf int, id long, label long, q binary")
    parts = min(CELLS, max(1, math.ceil(n / cell_rows)))
    index = materialize(placed.repartitionByRange(parts, "leaf", "id").sortWithinPartitions("leaf", "id")
                        .withColumn("pid", F.spark_partition_id()), "vector-index")

    def ranges(batches):
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for b in batches:
            leaf, q = b.column(0).to_numpy(), tree.lift(_matrix(b.column(1), dims))
            for k in np.unique(leaf).tolist():
                if len(above := tree.above(k)):
                    d = _distance(q[leaf == k], above)
                    low[k], high[k] = np.minimum(low.get(k, np.inf), d.min(0)), np.maximum(high.get(k, -np.inf), d.max(0))
        for k, v in low.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v),
                                              pa.array(high[k])], ["leaf", "i", "low", "high"])

    got = index.select("leaf", "q").mapInArrow(ranges, "leaf int, i int, low double, high double") \
        .groupBy("leaf", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values(["leaf", "i"])
    of_leaf = {k: g for k, g in got.groupby("leaf")}
    tree.set_ranges({k: g["low"].to_numpy() for k, g in of_leaf.items()}, {k: g["high"].to_numpy() for k, g in of_leaf.items()})
    cells: dict[int, list[int]] = {}
    for r in index.select("pid", "leaf").distinct().collect():
        cells.setdefault(r["pid"], []).append(r["leaf"])
    return Index(index, tree, dims, cells)


def _annulus(tree: Tree, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the scores from ``low`` to ``high`` (with room for rounding)."""
    total = (q * q).sum(1) + tree.norm2
    room = 1e-6 * (np.sqrt(total) + 1)
    near = np.sqrt(np.maximum(total - 2 * high.astype(float), 0.0)) - room
    far = np.sqrt(np.maximum(total - 2 * low.astype(float), 0.0)) + room
    return np.where(low <= high, near, 1.0), np.where(low <= high, far, 0.0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of ``scores`` (absent: _NONE), ties by smaller id; ``ids`` ascend."""
    n = len(ids)
    rank = np.where(scores == _NONE, _NONE, scores * n + (n - 1 - np.arange(n)))
    if n > k:
        at = np.argpartition(rank, n - k, axis=1)[:, n - k:]
    else:
        at = np.broadcast_to(np.arange(n), scores.shape)
    return np.take_along_axis(scores, at, 1), ids[at]


def search(index: Index, anchors: DataFrame, same: bool, k: int, own_leaf: bool = False) -> DataFrame:
    """(anchor, w, score, id, rank): for each window w of an anchor (arrays ``low`` and ``high`` of scores) its k best rows of the same or of
    other labels, ranked."""
    tree, dims, cells = index.tree, index.dims, index.cells
    anchors = anchors.select("id", "label", "q", "low", "high")
    blocks = max(1, math.ceil(anchors.count() / ANCHORS))

    def send(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q, low, high = _matrix(b.column(2), dims), b.column(3).to_pylist(), b.column(4).to_pylist()
            of = np.repeat(np.arange(len(q)), [len(x) for x in low])
            if own_leaf:
                seen = np.zeros((len(q), tree.leaves), bool)
                seen[np.arange(len(q)), tree.leaf_of(q)] = True
            else:
                near, far = _annulus(tree, q[of], np.array(sum(low, []), np.int64), np.array(sum(high, []), np.int64))
                every = tree.visits(q[of], near, far)
                seen = np.zeros((len(q), tree.leaves), bool)
                np.logical_or.at(seen, of, every)
            block = b.column(0).to_numpy() % blocks
            for pid, leaves in cells.items():
                at = np.flatnonzero(seen[:, leaves].any(1))
                if len(at):
                    rows, take = len(at), pa.array(at)
                    bits = pa.array([np.asarray(leaves, np.int32)[x].tobytes() for x in seen[at][:, leaves]], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([pid] * rows, pa.int32()), pa.array(block[at], pa.int64()), *(b.column(c).take(take) for c in range(5)), bits],
                        ["pid", "block", "id", "label", "q", "low", "high", "leaves"])

    sent = anchors.mapInArrow(send, "pid int, block long, id long, label long, q binary, low array<long>, high array<long>, leaves binary")
    rows = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor", "w", "score", "id"]
        out: dict[str, list] = {x: [] for x in names}
        if left.num_rows and right.num_rows:
            left = left.sort_by([("leaf", "ascending"), ("id", "ascending")])
            leaf, ids, label = (left.column(c).to_numpy() for c in ("leaf", "id", "label"))
            x = _matrix(left.column("q"), dims)
            cut = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
            spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(leaf)], strict=True))
            for lo in range(0, right.num_rows, _AT_ONCE):
                some = right.slice(lo, _AT_ONCE)
                _search_cell(tree, some, _matrix(some.column("q"), dims), leaf, ids, label, x, spans, same, k, out)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array(np.concatenate(v) if v else [], t) for (n, v), t in zip(out.items(), kinds, strict=True)})

    found = rows.groupBy("pid", "block").cogroup(sent.groupBy("pid", "block")).applyInArrow(cell, "anchor long, w int, score long, id long")
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_cell(tree, some, q, leaf, ids, label, x, spans, same, k, out) -> None:
    """The k best of a cell's rows for some anchors, leaf by leaf."""
    own, tag = some.column("id").to_numpy(), some.column("label").to_numpy()
    low, high = some.column("low").to_pylist(), some.column("high").to_pylist()
    width = max(map(len, low), default=0)
    lows, highs = np.full((len(q), width), 1, np.int64), np.full((len(q), width), 0, np.int64)
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        lows[i, :len(a)], highs[i, :len(b)] = a, b
    wanted = [set(np.frombuffer(v, np.int32).tolist()) for v in some.column("leaves").to_pylist()]
    score = np.full((len(q), width, k), _NONE, np.int64)
    name = np.zeros((len(q), width, k), np.int64)
    flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
    total = (q * q).sum(1) + tree.norm2
    for begin, end in spans:
        here = int(leaf[begin])
        at = np.array([i for i, w in enumerate(wanted) if here in w], int)
        if not len(at):
            continue
        points = tree.above(here)
        if len(points):  # the best score a row of this leaf can have, against the k-th found so far
            d, inside = _distance(flat[at], points), tree.lift(x[begin:end])
            own_d = _distance(inside, points)
            least = np.maximum(np.maximum(own_d.min(0) - d, d - own_d.max(0)).max(1), 0.0)
            most = (total[at] - np.maximum(least - 1e-6 * (np.sqrt(total[at]) + 1), 0.0) ** 2) / 2 + 1
            at = at[(most[:, None] >= score[at].min(2)).any(1)]
        for lo in range(begin, end, _SLICE):
            hi = min(lo + _SLICE, end)
            if not len(at):
                break
            s = np.rint(q[at] @ x[lo:hi].T).astype(np.int64)
            fit = (tag[at, None] == label[None, lo:hi]) == same
            if same:
                fit &= own[at, None] != ids[None, lo:hi]
            for w in range(width):
                ok = fit & (s >= lows[at, w, None]) & (s <= highs[at, w, None])
                new_s, new_i = _best(np.where(ok, s, _NONE), ids[lo:hi], k)
                all_s, all_i = np.concatenate([score[at, w], new_s], 1), np.concatenate([name[at, w], new_i], 1)
                order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                score[at, w], name[at, w] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
    i, w, r = np.nonzero(score != _NONE)
    for key, v in zip(out, (own[i], w.astype(np.int32), score[i, w, r], name[i, w, r]), strict=True):
        out[key].append(v)


def mine(rows: DataFrame, key: str, label: Column, vector: str, anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 10,
         window: tuple[int, int] = (30, 90), leaf_rows: int = LEAF_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``anchor`` is a condition on ``id``."""
    spark = rows.sparkSession
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = build(prepare(rows, key, label, vector, scale), leaf_rows, cell_rows)
    if index is None:
        return spark.createDataFrame([], names)
    asked = materialize(index.rows.select("id", "label", "q").filter(anchor), "anchors")
    every = [F.array(F.lit(x).cast("long")) for x in (_NONE + 1, 2 ** 61)]
    probe = search(index, asked.select("*", every[0].alias("low"), every[1].alias("high")), True, positives, own_leaf=True)
    bound = probe.filter(F.col("rank") == positives).select(F.col("anchor").alias("id"), F.col("score").alias("least"))
    first = asked.join(bound, "id", "left").select(
        "id", "label", "q", F.array(F.coalesce("least", F.lit(_NONE + 1))).alias("low"), every[1].alias("high"))
    pairs = materialize(search(index, materialize(first, "anchor-bounds"), True, positives), "positives")
    lo, hi = window
    best = pairs.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    bounds = asked.join(best, asked["id"] == best["anchor"]).select(
        "id", "label", "q", F.transform("p", lambda p: F.ceil(p["score"] * lo / F.lit(100).cast("decimal(3,0)")).cast("long")).alias("low"),
        F.transform("p", lambda p: F.floor(p["score"] * hi / F.lit(100).cast("decimal(3,0)")).cast("long")).alias("high"))
    found = search(index, materialize(bounds, "anchor-windows"), False, negatives)
    told = pairs.select("anchor", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(told, ["anchor", "w"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
