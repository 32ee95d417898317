"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full sets.

1. Each document becomes a set of word shingles (64-bit hashes) and a signature of ``K`` symbols of 16 bits, one per
   min-wise hash. Documents with equal sets form one class; everything below works on classes.
2. Two signatures within ``distance`` differing symbols must, by the pigeonhole principle, have one of (distance + 1) / 2
   chunks in which they differ in at most one symbol. A class is indexed under every way to leave out one
   symbol of each chunk, so every such pair shares a key. The distance follows from the similarity (``max_distance``).
3. A key's classes are linked through hubs first (the class with the smallest document id, then others by
   hash): each class is compared with one hub a round, confirmed on the full sets. Keys whose classes have become one
   component are done: a group of copies costs its size.
4. Classes of the other keys that share too few shingles with all pending classes to reach the similarity
   with any (an exact bound from the counts of shingles nobody else has) drop out: copies with many edits.
5. What is left, pairs of a key in different components, is compared completely: a key's classes are cut into
   blocks of about 512 (its largest component once, the others against it and each other), and cells of two blocks are compared
   in parallel, every pair on its full sets. A cell puts out only the links that join components: fewer than it has members.
   No pair that shares a key and could join two components goes unchecked.

A pair at similarity 0.85 differs in 9.6 of 64 symbols on average (deviation 2.9); more than its distance of 21 differ with a
chance of 9.5e-5. At 0.80 (the pipeline) the distance is 25 and the chance 1.3e-4. It is less above the similarity asked for.

Defined cases: null text or text without words has an empty set and is linked with nothing; fewer words than a
shingle make one shingle; equal texts share a class; a null id counts as larger than any other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, row_key
from quarry.llm.graph import components
from quarry.llm.tokens import by_bytes
from quarry.llm.words import U64, mix, shingle_set, words_of

K = 64
MOST_MISSED = 2e-4
BLOCK = 512            # classes of a block
ITEMS = 1_000_000      # shingles of a block
COLUMNS = 8192         # shingles of a membership matrix
HUB_ROUNDS = 2
NO_ID = 2 ** 63 - 1


def missed(percent: float, distance: int, k: int = K) -> float:
    """The chance that more than ``distance`` of k symbols differ in a pair at this similarity."""
    s = percent / 100
    return sum(comb(k, i) * (1 - s) ** i * s ** (k - i) for i in range(distance + 1, k + 1))


def max_distance(percent: float) -> int:
    """The smallest distance that misses at most MOST_MISSED of the pairs at the similarity itself. It is odd: with one error per
    chunk, c chunks guarantee 2c - 1."""
    return next(d for d in range(1, 2 * K, 2) if missed(percent, d) <= MOST_MISSED)


#: At the similarity of op2.
MAX_DISTANCE = max_distance(85)
CHUNKS = (MAX_DISTANCE + 1) // 2

_SEEDS = mix(np.arange(1, K + 1, dtype=U64))
_FACTORS = mix(np.arange(1001, 1001 + K, dtype=U64)) | U64(1)


def signature(items: np.ndarray) -> np.ndarray:
    """K symbols of 16 bits: the low bits of the smallest of each seeded hash."""
    low = np.full(K, ~U64(0), U64)
    with np.errstate(over="ignore"):
        for i in range(0, len(items), 4096):
            v = (items[i:i + 4096, None] ^ _SEEDS) * _FACTORS
            low = np.minimum(low, v.min(axis=0))
    return mix(low).astype(np.uint16)


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order, as two signed integers."""
    a = np.bitwise_xor.reduce(mix(items), initial=U64(len(items)))
    with np.errstate(over="ignore"):
        b = mix(items ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
    return int(a.view(np.int64)), int(np.asarray(b, U64).view(np.int64))


def chunk_masks(k: int = K, chunks: int = CHUNKS, distance: int = MAX_DISTANCE) -> list[np.ndarray]:
    """The symbols kept by each key: every chunk with each choice of the allowed errors left out."""
    from itertools import combinations

    out = []
    for part in np.array_split(np.arange(k), chunks):
        errors = distance // chunks
        for left_out in combinations(range(len(part)), errors):
            out.append(np.delete(part, left_out))
    return out


def _text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def describe(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """_key, _text_hash, n (set size), fa, fb (fingerprint), sig per row."""
    rows = docs.select(F.col(key).cast("long").alias("_key"), _text_hash(text).alias("_text_hash"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n, fa, fb, sig = [], [], [], []
            for lo, hi in by_bytes(texts):
                w = words_of(texts[lo:hi], lower=True)
                for i in range(hi - lo):
                    items = shingle_set(w.of(i), width)
                    a, b = fingerprint(items)
                    n.append(len(items))
                    fa.append(a)
                    fb.append(b)
                    sig.append(signature(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, fa, fb)), pa.array(sig, pa.binary())],
                ["_key", "_text_hash", "n", "fa", "fb", "sig"])

    return rows.mapInArrow(run, "_key long, _text_hash long, n long, fa long, fb long, sig binary")


def index_keys(classes: DataFrame, percent: int = 85) -> DataFrame:
    """(h, rep, node): each class under all its chunk keys."""
    distance = max_distance(percent)
    masks = chunk_masks(chunks=min((distance + 1) // 2, K), distance=distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, K).astype(U64)
            with np.errstate(over="ignore"):
                for m, kept in enumerate(masks):
                    h = np.full(len(sig), mix(np.array([m + 1]))[0], U64)
                    for c in kept:
                        h = mix(h * U64(0x9E3779B97F4A7C15) + sig[:, c])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0), batch.column(1)], ["h", "rep", "node"])

    return classes.select("rep", "node", "sig").mapInArrow(run, "h long, rep long, node long")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) within the signature distance whose sizes allow the similarity, with the distance."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    most = max_distance(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, K) for i in (2, 3)]
            d = (s[0] != s[1]).sum(1)
            ok = np.flatnonzero(d <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)),
                                              pa.array(d[ok].astype(np.int32))], ["a", "b", "d"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, d int")


class _Forest:
    """Union-find over component ids, kept for all cells of a task: what one cell joined the next need not join again."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def of(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.of(x), self.of(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _shared_items(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(set number, item number) of the items that two sets or more hold, and how many such items there are."""
    items = np.concatenate(sets)
    _, place, count = np.unique(items, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    kept = count[place] > 1
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets])[kept], number[place[kept]], int((count > 1).sum())


def _join_cell(left: np.ndarray, right: np.ndarray, node: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int,
               forest: _Forest) -> list[tuple[int, int]]:
    """The links (a, b) between left and right members that join two components: fewer than there are members. Every pair in
    different components is tested on its full sets, by the product of membership matrices (some columns at a time)."""
    x, y = np.flatnonzero(left), np.flatnonzero(right)
    if not len(x) or not len(y):
        return []
    n = np.array([len(v) for v in sets])
    who, item, several = _shared_items(sets)
    order = np.argsort(item, kind="stable")
    who, item = who[order], item[order]
    both = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, several, COLUMNS):
        a, b = np.searchsorted(item, (lo, lo + COLUMNS))
        has = np.zeros((len(sets), min(COLUMNS, several - lo)), np.float32)
        has[who[a:b], item[a:b] - lo] = 1.0
        both += has[x] @ has[y].T
    linked = 100.0 * both >= percent * (n[x][:, None] + n[y] - both)
    out = []
    for p, row in zip(x.tolist(), linked, strict=True):
        near = y[row & (component[y] != component[p])]
        for c, q in zip(*(v.tolist() for v in np.unique(component[near], return_index=True)), strict=True):
            if forest.join(int(component[p]), c):
                out.append((int(node[p]), int(node[near[q]])))
    return out


def _blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of a key, confirmed on the full sets. A key's largest component (no pair
    inside it matters) is cut into blocks that hold each class once; the rest goes to every such block, and block by
    block against itself. A block has about BLOCK classes and ITEMS shingles. Cells are streamed one after the other; each
    gives a spanning forest of what it joins, so the rows that come out do not grow with the pairs compared."""
    each = members.groupBy("h", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    big = lambda c, n: F.greatest(F.ceil(c / BLOCK), F.ceil(n / ITEMS), F.lit(1)).cast("int")
    key = each.groupBy("h").agg(F.max(F.struct("c", "component", "n")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n")).select(
        "h", F.col("top.component").alias("major"), big(F.col("top.c"), F.col("top.n")).alias("nm"),
        big(F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n")).alias("nr"))
    at = members.select("h", "node", "component").join(key, "h").withColumn("major", F.col("component") == F.col("major"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    cell = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    yes, no, none = F.lit(True), F.lit(False), F.lit(-1)
    against = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda o: cell(none, o, yes, no))
    among = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda o: cell(
        F.least(own("nr"), o), F.greatest(own("nr"), o), own("nr") <= o, own("nr") >= o))
    to = F.when(F.col("major"), F.array(cell(none, own("nm"), no, yes))).otherwise(F.concat(against, among))
    cells = at.withColumn("x", F.explode(to)).select("h", "x.*", "node", "component").join(sets, "node")
    dealt = cells.select("h", "i", "j", "left", "right", "node", "component", "items").repartition("h", "i", "j") \
        .sortWithinPartitions("h", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        forest = _Forest()

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            col = {k: table.column(k).to_numpy(zero_copy_only=False) for k in ("h", "i", "j", "left", "right", "node", "component")}
            items = table.column("items")
            cut = np.flatnonzero((np.diff(col["h"]) != 0) | (np.diff(col["i"]) != 0) | (np.diff(col["j"]) != 0)) + 1
            out = []
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), table.num_rows], strict=True):
                component = np.array([forest.of(c) for c in col["component"][lo:hi].tolist()])
                if (component != component[0]).any():
                    own_sets = [np.frombuffer(v.as_buffer(), U64) for v in items.slice(lo, hi - lo)]
                    out += _join_cell(col["left"][lo:hi], col["right"][lo:hi], col["node"][lo:hi], component, own_sets, percent, forest)
            a, b = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def cell(t: pa.RecordBatch, r: int) -> tuple:
            return t.column(0)[r].as_py(), t.column(1)[r].as_py(), t.column(2)[r].as_py()

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and cell(batch, 0) != last:
                yield flush(held)
                held = []
            end = batch.num_rows - 1
            last, lo = cell(batch, end), end
            while lo > 0 and cell(batch, lo - 1) == last:
                lo -= 1
            if lo > 0:
                yield flush([*held, batch.slice(0, lo)])
                held = []
            held.append(batch.slice(lo))
        if held:
            yield flush(held)

    return dealt.mapInArrow(run, "a long, b long")


class _Confirm:
    """Full shingle sets of the classes that share a key with another one (any of them may come up as a
    candidate), read once, and the exact test on pairs."""

    def __init__(self, docs: DataFrame, classes: DataFrame, shared: DataFrame, width: int, percent: int, key: str, text: str) -> None:
        wanted = shared.select("node").distinct().join(classes, "node").select("node", "rep", "fa", "fb", "n")
        rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("rep"), F.col(text).alias("_text"))
        rows = rows.join(wanted.select("rep").distinct(), "rep", "left_semi").select("_text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for lo, hi in by_bytes(texts):
                    w = words_of(texts[lo:hi], lower=True)
                    sets = [shingle_set(w.of(i), width) for i in range(hi - lo)]
                    fps = [fingerprint(x) for x in sets]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[0] for f in fps], pa.int64()), pa.array([f[1] for f in fps], pa.int64()),
                         pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                        ["fa", "fb", "n", "items"])

        made = rows.mapInArrow(run, "fa long, fb long, n long, items binary")
        own = made.join(wanted.select("node", "fa", "fb", "n"), ["fa", "fb", "n"])
        self.sets = materialize(own.groupBy("node").agg(F.first("items").alias("items")), "shingle-sets")
        self.percent = percent

    def items_of(self, nodes: DataFrame) -> DataFrame:
        """(node, item) rows of the sets of ``nodes``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                    if sets:
                        node = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
                        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(sets))], ["node", "item"])

        return self.sets.join(nodes, "node", "left_semi").select("node", "items").mapInArrow(run, "node long, item long")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.sets.select(F.col("node").alias(x), F.col("items").alias(f"i{x}"))
        both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ia", "ib")
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for r, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                    x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        ok.append(r)
                at = pa.array(ok, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

        return both.mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """Per row: _key, _text_hash, n, low (smallest id reachable, null for an empty set), group (null likewise)."""
    rows = materialize(describe(docs, width, key, text), "signatures")
    grouped = rows.filter("n > 0").groupBy("fa", "fb", "n").agg(
        F.min(F.coalesce("_key", F.lit(NO_ID))).alias("rep"), F.first("sig").alias("sig"))
    classes = materialize(row_key(grouped, "node"), "classes")

    keys = index_keys(classes, percent)
    several = keys.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rep", "node")).alias("hub")) \
        .filter("c > 1").select("h", F.col("hub.rep").alias("rep"), F.col("hub.node").alias("hub"))
    shared = materialize(keys.drop("rep").join(several, "h").select("h", "node", "rep", "hub"), "shared-keys")
    confirm = _Confirm(docs, classes, shared, width, percent, key, text)
    links = comp = pending = None
    for r in range(HUB_ROUNDS):
        if pending is None:  # the smallest document of all a class's keys is its hub
            cand = shared.filter(F.col("node") != F.col("hub")).groupBy("node").agg(F.min(F.struct("rep", "hub")).alias("x")) \
                .select("node", F.col("x.hub").alias("hub"))
        else:
            hubs = pending.groupBy("h").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(r))).alias("x"))
            cand = pending.join(hubs, "h").filter(F.col("component") != F.col("x.component")) \
                .groupBy("node").agg(F.min_by("x.node", F.xxhash64("x.node", F.lit(r))).alias("hub"))
        near = _near(cand.select(F.col("node").alias("a"), F.col("hub").alias("b")), classes, percent)
        found = confirm(near)
        links = materialize(found if links is None else found.union(links), "links")
        comp = materialize(components(links), "component-of")
        pending = _possible(_pending(shared, comp), classes, confirm, percent)
        if pending.isEmpty():
            break
    else:
        links = materialize(_blocks(pending, confirm.sets, percent).union(links), "links")
        comp = materialize(components(links), "component-of")

    lowest = comp.join(classes.select("node", "rep"), "node")
    lowest = lowest.join(lowest.groupBy("component").agg(F.min("rep").alias("low")), "component").select("node", "low", "component")
    of_class = classes.join(lowest, "node", "left").select(
        "fa", "fb", "n", F.coalesce("low", "rep").alias("low"), F.coalesce("component", "node").alias("group"))
    return rows.drop("sig").join(of_class, ["fa", "fb", "n"], "left").drop("fa", "fb")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest id reachable), kept (id = component_id)."""
    out = _grouped(docs, width, percent, key, text)
    low = F.when(F.col("n") == 0, F.col("_key")).otherwise(F.when(F.col("low") != NO_ID, F.col("low")))
    out = out.withColumn("component_id", low)
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), "component_id",
                      F.col("_key").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group: the one with the smallest id (a null id counts as the
    largest), then text hash. Rows with an empty set all stay; rows that agree in id and text are one."""
    out = _grouped(docs, width, percent, key, text).withColumn("_key", F.coalesce("_key", F.lit(NO_ID)))
    first = out.filter("n > 0").groupBy("group").agg(F.min(F.struct("_key", "_text_hash")).alias("x")).select("x.*")
    keep = materialize(first.union(out.filter("n = 0").select("_key", "_text_hash")), "kept-rows")
    told = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_key"),
                       _text_hash(text).alias("_text_hash"))
    kept = told.join(keep, ["_key", "_text_hash"], "left_semi")
    one = Window.partitionBy("_key", "_text_hash").orderBy("_key")
    return kept.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").select("doc.*")


def _mixed(at: DataFrame) -> DataFrame:
    """Rows of the keys whose classes lie in two components or more."""
    keys = at.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("h")
    return at.join(keys, "h")


def _pending(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """(h, node, component) of the keys that are not done."""
    at = shared.select("h", "node").join(comp, "node", "left").select("h", "node", F.coalesce("component", "node").alias("component"))
    return materialize(_mixed(at), "pending")


def _possible(pending: DataFrame, classes: DataFrame, confirm: _Confirm, percent: int) -> DataFrame:
    """Pending rows that can still be linked, with n. ``own`` counts a class's shingles that no other pending
    class has; it can share at most i = n - own with any of them, so with sizes from ``low`` up its similarity
    is at most i / (n + max(low, i) - i). Heavily edited copies drop out here, without a comparison, and with
    them the keys they kept open. The bound is exact: nothing that could be linked is lost."""
    nodes = pending.select("node").distinct()
    items = confirm.items_of(nodes)
    own = items.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1") \
        .groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    sized = nodes.join(classes.select("node", "n"), "node").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    at = pending.join(materialize(sized, "pending-sizes"), "node")
    low = at.groupBy("h").agg(F.min("n").alias("low"))
    i = F.col("n") - F.col("own")
    able = at.join(low, "h").filter(100 * i >= percent * (F.col("n") + F.greatest("low", i) - i)).drop("low", "own")
    return materialize(_mixed(able), "possible")
