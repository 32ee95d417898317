"""Benchmark decontamination: BM25 over an inverted index of test items with block-max pruning.

Every training passage is a query. Items are the documents of the index; an item's term impacts are its BM25
contributions divided by the sum of all of them, so a passage that holds the whole item scores 1. Retrieval
returns all items that score at least ``threshold`` and skips only what provably cannot:

* An item's *essential* postings are its strongest ones; what is left out weighs less than ``slack``.
* Items lie in blocks of ``BLOCK``; each term stores per block the largest essential impact. The sum of
  these maxima over a passage's terms, plus ``slack``, bounds every score in the block: blocks below the threshold
  are never opened (the block-max bound of WAND, for many passages at once). Opened blocks are scored with all postings.

A hit is then verified: the share of the item's question words and of its answer words that lie in a run of three words
(two in parts of fewer than ``SHORT`` words) found in the passage must both reach ``overlap``. At 0.5 a part survives two edited,
inserted or dropped words from 8 words up and three from 12 up, wherever they stand. Words are runs of letters and digits, case folded.

Passages are windows of 2 x stride words every stride words, with a stride of the longest item's word count, so any item
lies in one window whole. The whole text is covered. The benchmark is taken in index blocks of at most
``MAX_ITEMS`` items (one broadcast each), however large it is.

Defined cases: null or empty texts and items match nothing; parts with fewer words than a run are
compared as one run; repeated items each report (they are searched once); very long texts are searched in slices of passages; repeated documents are queried row by row; an empty table or
benchmark gives no rows; other columns are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import by_bytes
from quarry.llm.words import ALNUM, U64, shingles, words_of

K1, B = 1.2, 0.75
BLOCK = 8
WIDTH = 3
SHORT = 18
OVERLAP = 0.5
MAX_ITEMS = 20_000
LEAST_STRIDE = 32
CELLS = 4_000_000


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    question: np.ndarray
    answer: np.ndarray
    copies: int = 1


class ItemIndex:
    def __init__(self, items: list[Item], threshold: float, slack: float) -> None:
        self.items, self.threshold, self.slack = items, threshold, slack
        self.stride = max([LEAST_STRIDE, *(len(x.words) for x in items)])
        n = max(len(items), 1)
        mean = sum(len(x.words) for x in items) / n
        per = [np.unique(x.words, return_counts=True) for x in items]
        self.vocab = np.unique(np.concatenate([p[0] for p in per])) if per else np.empty(0, U64)
        at = [np.searchsorted(self.vocab, p[0]) for p in per]
        df = np.bincount(np.concatenate(at), minlength=len(self.vocab)) if per else np.empty(0)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        terms, owners, impacts, essential = [], [], [], []
        for i, (t, (_, tf)) in enumerate(zip(at, per, strict=True)):
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(items[i].words) / mean))
            w = w / w.sum()
            order = np.argsort(-w, kind="stable")
            rest = 1 - np.cumsum(w[order]) + w[order]       # mass from this posting on
            keep = np.zeros(len(t), bool)
            keep[order[rest >= slack]] = True
            terms.append(t)
            owners.append(np.full(len(t), i))
            impacts.append(w)
            essential.append(keep)
        empty = np.empty(0, np.int64)
        t, o = (np.concatenate(x) if x else empty for x in (terms, owners))
        w, e = (np.concatenate(x) if x else np.empty(0) for x in (impacts, essential))
        self.n_blocks = (len(items) + BLOCK - 1) // BLOCK
        blk = o // BLOCK
        order = np.lexsort((t, blk))
        self.by_block = [(t[order][a:b], o[order][a:b], w[order][a:b]) for a, b in
                         zip(*(np.searchsorted(blk[order], np.arange(self.n_blocks), side=s) for s in ("left", "right")), strict=True)]
        e = e.astype(bool)
        cell = t[e] * max(self.n_blocks, 1) + blk[e]
        self_cell, back = np.unique(cell, return_inverse=True)
        top = np.zeros(len(self_cell))
        np.maximum.at(top, back, w[e])
        self.max_block, self.max_value = self_cell % max(self.n_blocks, 1), top
        self.max_at = np.searchsorted(self_cell // max(self.n_blocks, 1), np.arange(len(self.vocab) + 1))

    def _bounds(self, chunk: np.ndarray, term: np.ndarray, n_chunks: int) -> np.ndarray:
        """Per (chunk, block): sum of block maxima over the chunk's distinct terms."""
        pair = np.unique(chunk * len(self.vocab) + term)
        chunk, term = pair // len(self.vocab), pair % len(self.vocab)
        size = self.max_at[term + 1] - self.max_at[term]
        at = np.repeat(self.max_at[term] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        key = np.repeat(chunk, size) * self.n_blocks + self.max_block[at]
        return np.bincount(key, self.max_value[at], n_chunks * self.n_blocks).reshape(n_chunks, self.n_blocks)

    def _open(self, words: np.ndarray, block: int) -> list[tuple[int, float]]:
        """Exact scores of a block's items for one passage, those at or above the threshold."""
        term, owner, impact = self.by_block[block]
        own = np.unique(words)
        at = np.minimum(np.searchsorted(own, self.vocab[term]), len(own) - 1)
        hit = own[at] == self.vocab[term]
        score = np.bincount(owner[hit] - block * BLOCK, impact[hit], BLOCK)
        return [(block * BLOCK + int(k), float(score[k])) for k in np.flatnonzero(score >= self.threshold - 1e-9)]

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """Per text: item position -> best (score, question overlap, answer overlap) over its passages."""
        found: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        if not len(self.vocab):
            return found
        w = words_of(texts, ALNUM, fold=True)
        size = np.diff(w.first)
        n_chunk = -(-size // self.stride)
        first = np.concatenate([[0], np.cumsum(n_chunk)])
        text = np.repeat(np.arange(len(texts)), size)
        chunk = first[text] + (np.arange(len(w.hashes)) - w.first[text]) // self.stride
        term = np.minimum(np.searchsorted(self.vocab, w.hashes), len(self.vocab) - 1)
        known = self.vocab[term] == w.hashes
        chunk, term = chunk[known], term[known]
        ends = first[1:][n_chunk > 0] - 1                    # a text's last chunk: the next text's first is no neighbour
        for c, b in self._candidates(chunk, term, int(first[-1]), ends):
            i = int(np.searchsorted(first, c, side="right")) - 1
            lo = w.first[i] + (c - first[i]) * self.stride
            own = w.hashes[lo:min(lo + 2 * self.stride, w.first[i + 1])]
            hits = self._open(own, int(b))
            if not hits:
                continue
            grams = np.concatenate([shingles(own, k) for k in range(1, WIDTH + 1)])
            for k, score in hits:
                q, a = (self._share(x, grams) for x in (self.items[k].question, self.items[k].answer))
                found[i][k] = max(found[i].get(k, (0.0, 0.0, 0.0)), (score, q, a), key=lambda x: (min(x[1], x[2]), x[0]))
        return found

    def _candidates(self, chunk: np.ndarray, term: np.ndarray, n_chunks: int, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first chunk of the passage, block) wherever the bound reaches the threshold. Bounds are held for about CELLS pairs of
        chunk and block at a time, so a text of any length needs the same memory."""
        step = max(1, CELLS // max(self.n_blocks, 1))
        for lo in range(0, n_chunks, step):
            n = min(step + 1, n_chunks - lo)                 # one chunk more: the neighbour of the last
            a, b = np.searchsorted(chunk, [lo, lo + n])
            bound = self._bounds(chunk[a:b] - lo, term[a:b], n)
            after = np.zeros_like(bound)
            after[:-1] = bound[1:]
            after[ends[(ends >= lo) & (ends < lo + n)] - lo] = 0
            for c, blk in zip(*np.nonzero((bound + after)[:step] >= self.threshold - self.slack - 1e-9), strict=True):
                yield lo + int(c), int(blk)

    @staticmethod
    def _share(part: np.ndarray, grams: np.ndarray) -> float:
        """The share of the part's words that lie in a run of words found in the passage."""
        if not len(part):
            return 1.0
        k = min(WIDTH if len(part) >= SHORT else WIDTH - 1, len(part))
        hit = np.isin(shingles(part, k), grams)
        return float((np.convolve(hit, np.ones(k, int)) > 0).mean())


def build_index(rows: list[tuple], threshold: float, slack: float) -> ItemIndex:
    """rows: (item id, question, answer), and the number of copies if not one."""
    q = words_of([r[1] for r in rows], ALNUM, fold=True)
    a = words_of([r[2] for r in rows], ALNUM, fold=True)
    items = [Item(r[0], np.concatenate([q.of(i), a.of(i)]), q.of(i), a.of(i), *r[3:]) for i, r in enumerate(rows)]
    return ItemIndex([x for x in items if len(x.words)], threshold, slack)


def split_item(text: str = "text") -> tuple:
    """Question and answer of an item that is one text: its first and second half, by words."""
    words = F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+")
    half = F.ceil(F.size(words) / 2).cast("int")
    return (F.array_join(F.slice(words, 1, half), " ").alias("question"),
            F.array_join(F.slice(words, half + 1, F.size(words)), " ").alias("answer"))


def indexes(items: DataFrame, threshold: float = 0.6, slack: float = 0.3, item_id: str = "item_id") -> Iterator[ItemIndex]:
    """One index per block of at most MAX_ITEMS items; ``items`` has item_id, question, answer. Equal items are one item with a
    number of copies, so however often an item is repeated, blocks by hash hold about half of MAX_ITEMS."""
    what = [item_id, "question", "answer"]
    distinct = items.groupBy(*what).agg(F.count(F.lit(1)).alias("_copies"))
    n = max(1, math.ceil(distinct.count() / (MAX_ITEMS / 2)))
    part = distinct.withColumn("_part", F.pmod(F.xxhash64(*what), F.lit(n)))
    for p in range(n):
        rows = part.filter(F.col("_part") == p).select(*what, "_copies").limit(MAX_ITEMS + 1).collect()
        if len(rows) > MAX_ITEMS:
            raise RuntimeError("a block of items by hash is twice its expected size")
        yield build_index([tuple(r) for r in rows], threshold, slack)


def _chars(index: ItemIndex) -> int:
    return max(50_000, 2_000_000 * 64 // max(index.n_blocks, 64))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = OVERLAP, key: str = "doc_id",
               text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap) of every document row and item it contains; an item that the benchmark repeats
    reports as often."""
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    kind = "doc long, item long, score double, question_overlap double, answer_overlap double, copies long"
    out = None
    for index in indexes(items, threshold, threshold / 2, item_id):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for batch in batches:
                texts, got = batch.column(1).to_pylist(), []
                for lo, hi in by_bytes(texts, most_chars=_chars(ix)):
                    for i, hits in enumerate(ix.search(texts[lo:hi]), lo):
                        got += [(i, ix.items[k].item_id, *v, ix.items[k].copies) for k, v in hits.items() if min(v[1:]) >= overlap]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([g[0] for g in got], pa.int64())),
                     *(pa.array([g[c] for g in got], pa.int64() if c in (1, 5) else pa.float64()) for c in range(1, 6))],
                    ["doc", "item", "score", "question_overlap", "answer_overlap", "copies"])

        part = rows.mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    each = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return out.withColumn("_copy", each).drop("copies", "_copy").withColumnsRenamed({"doc": key, "item": item_id})


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = OVERLAP, text: str = "text",
               item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that contain no item."""
    at = docs.columns.index(text)
    for index in indexes(items, threshold, threshold / 2, item_id):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for batch in batches:
                texts, clean = batch.column(at).to_pylist(), []
                for lo, hi in by_bytes(texts, most_chars=_chars(ix)):
                    clean += [not any(min(v[1:]) >= overlap for v in hits.values()) for hits in ix.search(texts[lo:hi])]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
