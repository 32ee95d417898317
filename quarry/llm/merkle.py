"""Merkle dataset manifest: digests of rows, folded level by level into one root, with an inclusion proof per row.

1. Every row becomes a leaf digest. Leaves of a group are numbered in order without gathering a group: one
   range-partitioned sort of the digests, then counts per (partition, group) and their prefix sums.
2. At each level the nodes are joined with themselves on (group, computed sibling index): XOR 1 in a binary tree, else back by the
   node's slot. The nodes in slot zero then hold their whole run and emit the parent. Levels are written to the
   shared folder, so a lost executor costs one level.
3. What remains of each group is its subroot; subroots in group order form a tree of the same kind up to the root.
4. Paths go down the other way, one join a level: a node's siblings are cut from its parent's run, the parent's path follows.

A run has at most ``fanout`` rows, so no join or group is larger than that whatever a group holds.

Defined cases: a null field is ``-``, any other its UTF-8 byte count, ``:`` and its value; a null group is a group of its own and
comes first; null order values come first, rows that tie are ordered by digest (equal digests are exchangeable); repeated
rows are a leaf each; a lone leaf is its group's subroot and a lone subroot the root; an empty table has no rows and
no root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, row_key

FANOUT = 16


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest(*[field(f) for f in fields])


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (g, o, hash, row) as (gid, idx, n, hash, row): each group's number (groups ascend as g does), the place in the group
    by (o, hash), and the size of the group."""
    order = [F.col("g").asc_nulls_first(), F.col("o").asc_nulls_first(), F.col("hash"), F.col("_row")]
    rows = materialize(row_key(rows), f"{name}-rows")
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row", "o").withColumns(
        {"p": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), f"{name}-order")
    parts = placed.groupBy("p", "g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("g")
    before = group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("p").alias("p2"), F.col("g").alias("g2"), F.min("first").over(group).alias("gid"),
                         F.sum("c").over(group).alias("n"), (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    both = placed.join(parts, (F.col("p") == F.col("p2")) & F.col("g").eqNullSafe(F.col("g2")))
    return materialize(both.select("gid", (F.col("at") + F.col("shift")).alias("idx"), "n", "hash", "row"), f"{name}-level")


def sibling(idx: Column, fanout: int) -> Column:
    """The index of the sibling in slot zero of a node's run: XOR 1 for an odd node of a binary tree, else back by the node's slot."""
    return idx.bitwiseXOR(F.lit(1).cast("long")) if fanout == 2 else idx - idx % fanout


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The next level of the unfinished groups: slot-zero nodes meet their siblings by index, hold the whole ``run`` (the
    digests of its nodes, left to right) and emit its digest as the parent's."""
    open_ = nodes.filter("n > 1").select("gid", "idx", "n", "hash")
    zero = F.col("idx") % fanout == 0
    offers = open_.filter(~zero).select("gid", sibling(F.col("idx"), fanout).alias("idx"),
                                        F.struct((F.col("idx") % fanout).alias("slot"), F.col("hash").alias("h")).alias("of"))
    met = open_.filter(zero).join(offers, ["gid", "idx"], "left").groupBy("gid", "idx").agg(
        F.first("n").alias("n"), F.first("hash").alias("hash"), F.array_sort(F.collect_list("of")).alias("of"))
    run = F.concat("hash", F.array_join(F.transform("of", lambda s: s["h"]), ""))
    return met.select("gid", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"),
                      F.sha2(run, 256).alias("hash"), run.alias("run"))


@dataclass
class _Tree:
    """``levels[0]`` has gid, idx, n, hash, row; those above gid, idx, n, hash, run. All nodes of a level."""

    levels: list[DataFrame]
    fanout: int

    def tops(self) -> DataFrame:
        """(gid, hash): what remains of each group."""
        out = None
        for level in self.levels:
            some = level.filter("n = 1").select("gid", "hash")
            out = some if out is None else out.union(some)
        return out

    def paths(self, tops: DataFrame) -> DataFrame:
        """(gid, idx, hash, row, top, path) of the first level from (gid, top, path) of each group's top; ``path`` has a step (left,
        right) per level."""
        slot = (F.col("idx") % self.fanout).cast("int")
        step = F.struct(F.substring("up.run", F.lit(1), 64 * slot).alias("left"),
                        F.substring("up.run", 64 * slot + 65, F.lit(64 * self.fanout)).alias("right"))
        now = None
        for k in range(len(self.levels) - 1, -1, -1):
            own = ["gid", "idx", "hash", "run" if k else "row"]
            done = self.levels[k].filter("n = 1").select(*own).join(tops, "gid").select(*own, "top", "path")
            if now is not None:
                up = now.select("gid", F.col("idx").alias("at"), F.struct("run", "top", "path").alias("up"))
                done = self.levels[k].filter("n > 1").select(*own, F.floor(F.col("idx") / self.fanout).alias("at")).join(
                    up, ["gid", "at"]).select(*own, F.col("up.top").alias("top"), F.concat(F.array(step), "up.path").alias("path")).union(done)
            now = done
        return now


def _grow(first: DataFrame, fanout: int, name: str) -> _Tree:
    largest = first.agg(F.max("n")).first()[0] or 0
    levels = [first]
    while largest > 1:
        levels.append(materialize(_parents(levels[-1], fanout), f"{name}-level"))
        largest = -(-largest // fanout)
    return _Tree(levels, fanout)


@dataclass
class Manifest:
    """The trees of a table. ``root`` is null for an empty one."""

    groups: _Tree
    top: _Tree
    root: str | None

    def nodes(self) -> DataFrame:
        """Every node: tree ('group' or 'top'), level, gid, idx, hash. The files of a stored manifest."""
        out = None
        for tree, t in (("group", self.groups), ("top", self.top)):
            for k, level in enumerate(t.levels):
                some = level.select(F.lit(tree).alias("tree"), F.lit(k).alias("level"), "gid", "idx", "hash")
                out = some if out is None else out.union(some)
        return out

    def proofs(self) -> DataFrame:
        """Per row: row, leaf, subroot, path (array of left, right from the leaf up to the root)."""
        none = F.array().cast("array<struct<left:string,right:string>>")
        root = self.top.levels[-1].select("gid", F.lit(self.root).alias("top"), none.alias("path"))
        over = self.top.paths(root).select(F.col("row").alias("gid"), F.col("hash").alias("top"), "path")
        return self.groups.paths(over).select("row", F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "path")


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(docs: DataFrame, leaf: Column, group: str = "source", order: str = "doc_id", row: Column | None = None,
             fanout: int = FANOUT) -> Manifest:
    """The trees over ``docs`` with ``leaf`` as each row's digest. ``row`` (any column or struct, by default the order column) is carried
    along to the proofs."""
    if fanout < 2:
        raise ValueError("a run has two nodes or more")
    rows = docs.select(F.col(group).alias("g"), F.col(order).alias("o"), leaf.alias("hash"),
                       (F.col(order) if row is None else row).alias("row"))
    groups = _grow(numbered(rows, "merkle"), fanout, "merkle")
    tops = groups.tops().select(F.lit(0).alias("g"), F.col("gid").alias("o"), "hash", F.col("gid").alias("row"))
    top = _grow(numbered(tops, "merkle-top"), fanout, "merkle-top")
    root = top.levels[-1].select("hash").first()
    return Manifest(groups, top, root and root[0])
