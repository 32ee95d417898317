"""Toxic passages as maximum-scoring segments.

Token weights are log-odds ratios of the toxic against the clean labelled documents with an informative
Dirichlet prior (each token's prior is its frequency in both together); a weight counts if its z-score is
significant. A token is looked up as a word and by its first 4, 5, 6 and 8 bytes, and the strongest of its
weights is its score, less a constant that makes clean text drift downwards. A linear-time scan finds all
maximal scoring segments of a text; those whose expected number by chance (extreme-value statistics of the best
segment: ``K n exp(-lambda S)``, fitted on the clean documents) is small are its toxic passages. The
document's score is the calibrated probability of its best segment's extreme value.

The fit uses at most ``max_per_class`` labelled documents of each class, chosen by a hash of their ids, and keeps at
most ``max_tokens`` significant tokens (documented bounds of what reaches the driver and is broadcast); scoring
covers every document and whole texts.

Defined cases: null and empty texts have no segments and the lowest score; repeated rows score alike; without toxic
or clean labelled documents every score is 0; an empty table gives no rows; all other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, with_fields
from quarry.llm.tokens import by_bytes
from quarry.llm.words import ALNUM, U64, Words, hash_spans, mix, words_of

PREFIXES = (4, 5, 6, 8)
DRIFT = 0.5            # subtracted from every token's weight
STEP = 0.05            # resolution of token scores
SIGNIFICANT = 0.01     # expected chance segments at or below which a segment is reported


def token_keys(w: Words) -> list[np.ndarray]:
    """Per word: hashes of the whole word and of its first bytes (the word itself where it is shorter)."""
    keys = [w.hashes]
    for k, size in enumerate(PREFIXES, 1):
        h = hash_spans(w.data, w.start, np.minimum(w.end, w.start + size))
        keys.append(mix(h + U64(k)))
    return keys


@dataclass
class SegmentModel:
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.float64))
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    bias: float = -30.0

    def token_scores(self, w: Words) -> np.ndarray:
        best = np.zeros(len(w.hashes))
        if len(self.keys):
            for keys in token_keys(w):
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                np.maximum(best, np.where(self.keys[at] == keys, self.weights[at], 0.0), out=best)
        return np.round((best - DRIFT) / STEP) * STEP

    def extreme(self, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        """-log of the expected number of chance segments at least as good as the best one."""
        return self.lam * best - np.log(np.maximum(self.k * np.maximum(n, 1), 1e-300))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(x, -20, 60) + self.bias, -30, 30)))


def best_segment(s: np.ndarray) -> float:
    """Score of the best segment (0 for none): largest rise of the running sum over its running minimum."""
    if not len(s):
        return 0.0
    run = np.cumsum(s)
    low = np.minimum.accumulate(np.concatenate([[0.0], run[:-1]]))
    return max(0.0, float((run - low).max()))


def maximal_segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with positive score, in one pass over the positive tokens."""
    run = np.concatenate([[0.0], np.cumsum(s)])
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for i in np.flatnonzero(s > 0).tolist():
        start, end, left, right = i, i + 1, run[i], run[i + 1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                kept.append((start, end, left, right))
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, float(r - x)) for a, b, x, r in kept]


def _lambda(values: np.ndarray, share: np.ndarray) -> float:
    """Positive root of sum(share * exp(lambda * value)) = 1 for a negative mean."""
    lo, hi = 1e-6, 20.0
    f = lambda t: float((share * np.exp(np.minimum(t * values, 700))).sum()) - 1
    if f(hi) < 0:
        return hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and bias by damped Newton steps, with a small ridge."""
    a, b = np.c_[np.clip(x, -20, 60), np.ones(len(x))], np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (p - y)) + 1e-3 * b
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        b = b - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return max(float(b[0]), 0.0), float(b[1])


def _log_odds(sample: DataFrame, max_tokens: int, least_docs: int, least_z: float) -> tuple[np.ndarray, np.ndarray]:
    """Significant tokens of toxic documents and their weights. A token counts once per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in by_bytes(texts, 1024, 4_000_000):
                w = words_of(texts[lo:hi], ALNUM, fold=True)
                keys = token_keys(w)
                rows = [np.unique(np.concatenate([k[w.first[i]:w.first[i + 1]] for k in keys])) for i in range(hi - lo)]
                of = np.repeat(toxic[lo:hi], [len(r) for r in rows])
                flat = np.concatenate(rows)
                for y in (0, 1):
                    token, times = np.unique(flat[of == y], return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "token": pa.array(token.view(np.int64)), "toxic": pa.array(np.full(len(token), y), pa.int32()),
                        "n": pa.array(times, pa.int64())})

    flat = sample.select("_text", "_toxic").mapInArrow(count, "token long, toxic int, n long")
    per = flat.groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("y1"),
                                    F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("y0"))
    per = materialize(per.filter(F.col("y1") + F.col("y0") >= least_docs), "toxic-tokens")
    total = per.agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0")).first()
    n1, n0 = float(total.n1 or 0), float(total.n0 or 0)
    if not n1 or not n0:
        return np.empty(0, U64), np.empty(0)
    prior = 0.05 * (n1 + n0)                                 # the prior's pseudo-counts, by corpus frequency
    a = prior * (F.col("y1") + F.col("y0")) / F.lit(n1 + n0)
    p1, p0 = F.col("y1") + a, F.col("y0") + a
    ratio = F.log(p1 / (F.lit(n1 + prior) - p1)) - F.log(p0 / (F.lit(n0 + prior) - p0))
    z = ratio / F.sqrt(1 / p1 + 1 / p0)
    told = per.filter(F.col("y1") >= least_docs).select("token", ratio.alias("w"), z.alias("z")) \
        .filter(F.col("z") >= least_z).orderBy(F.col("z").desc(), "token").limit(max_tokens).toPandas()
    keys = told["token"].to_numpy(np.int64).view(U64)
    order = np.argsort(keys)
    return keys[order], told["w"].to_numpy(float)[order]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
        max_per_class: int = 8000, max_tokens: int = 100_000, least_docs: int = 3, least_z: float = 3.0) -> SegmentModel:
    known = labels.select(F.col(key).alias("_key"), F.col(toxic).cast("int").alias("_toxic")).dropna()
    sizes = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}

    def draw(y: int) -> DataFrame:
        return known.filter(F.col("_toxic") == y).distinct().orderBy(F.xxhash64("_key"), "_key").limit(max_per_class)

    drawn = F.broadcast(draw(0).unionByName(draw(1)))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(drawn, "_key")
    sample = materialize(rows.select("_text", "_toxic"), "toxic-sample")
    model = SegmentModel()
    model.keys, model.weights = _log_odds(sample, max_tokens, least_docs, least_z)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1)
            n, best, seen = [], [], []
            for lo, hi in by_bytes(texts):
                w = words_of(texts[lo:hi], ALNUM, fold=True)
                s = model.token_scores(w)
                for i in range(hi - lo):
                    own = s[w.first[i]:w.first[i + 1]]
                    value, times = np.unique(own, return_counts=True)
                    n.append(len(own))
                    best.append(best_segment(own))
                    seen.append([{"v": float(a), "n": int(b)} for a, b in zip(value, times, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [y, pa.array(n, pa.int64()), pa.array(best, pa.float64()),
                 pa.array(seen, pa.list_(pa.struct([("v", pa.float64()), ("n", pa.int64())])))], ["toxic", "n", "best", "seen"])

    got = materialize(sample.select("_text", "_toxic").mapInArrow(
        scan, "toxic int, n long, best double, seen array<struct<v:double,n:bigint>>"), "toxic-scan")
    hist = (got.filter("toxic = 0").select(F.explode("seen").alias("s")).groupBy(F.col("s.v").alias("v"))
            .agg(F.sum("s.n").alias("n")).toPandas())
    each = got.select("toxic", "n", "best").toPandas()
    y = each["toxic"].to_numpy()
    if not len(model.keys) or not (y == 1).any() or not (y == 0).any():
        return SegmentModel()
    n, best = each["n"].to_numpy(float), each["best"].to_numpy(float)
    top = float(np.ceil((model.weights.max() - DRIFT) / STEP) * STEP)
    value = np.append(hist["v"].to_numpy(float), top)      # one chance token of the top weight is always possible
    count = np.append(hist["n"].to_numpy(float), 1.0)
    model.lam = _lambda(value, count / count.sum())
    clean = y == 0
    model.k = float(clean.sum() / max((n[clean] * np.exp(-model.lam * best[clean])).sum(), 1e-9))
    share = {c: sizes.get(c, 0) / max((y == c).sum(), 1) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    model.slope, model.bias = _logistic(model.extreme(n, best), y.astype(float), weight / weight.mean())
    return model


def with_toxicity(docs: DataFrame, model: SegmentModel, text: str = "text", score: str = "score",
                  segments: str = "segments") -> DataFrame:
    """All columns of ``docs``, ``score`` in [0, 1] and ``segments``: the significant toxic passages as words
    [start, end) (runs of letters and digits) with their expected number by chance."""
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("expected", pa.float64())]))
    schema = with_fields(docs, **{score: "double", segments: "array<struct<start:int,end:int,expected:double>>"})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            p, found = [], []
            for lo, hi in by_bytes(texts):
                w = words_of(texts[lo:hi], ALNUM, fold=True)
                s = m.token_scores(w)
                for i in range(hi - lo):
                    own = s[w.first[i]:w.first[i + 1]]
                    n, best = len(own), best_segment(own)
                    x = m.extreme(np.array([n]), np.array([best]))
                    p.append(float(m.probability(x)[0]) if len(m.keys) else 0.0)
                    if best > 0 and x[0] >= -np.log(SIGNIFICANT):
                        each = [(a, b, float(np.exp(-m.extreme(np.array([n]), np.array([v]))[0]))) for a, b, v in maximal_segments(own)]
                        found.append([{"start": a, "end": b, "expected": e} for a, b, e in each if e <= SIGNIFICANT])
                    else:
                        found.append([])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(found, kind)], schema.names)

    return docs.mapInArrow(run, schema)
