"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows, the unlabelled part is a sample of all documents whatever their label.
The class prior is estimated from the trusted labels where they hold both classes (``labelled_prior``); else
a first separator of the two samples gives it as the lower envelope of P_u(score >= t) / P_p(score >= t): on a
region that no negative reaches, that ratio is the share of positives among the unlabelled. Then a logistic
model minimises the non-negative unbiased risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

with Adam, stepping back along the second term whenever it falls below zero.

The fit uses at most ``max_positive`` and ``max_unlabelled`` rows, chosen by a hash of their ids (documented
bounds of what reaches the driver, as feature vectors only); scoring covers every document and whole texts.
Features: shares of bytes by class and of class pairs, and word, line and repetition statistics.

Defined cases: null and empty texts get the features of an empty text and a score; repeated rows score
alike; without trusted positives the score is the prior 0.5 for all; an empty table gives no rows; all other columns
are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import with_fields
from quarry.llm.rules import ASCII_SPACE, repeated_words
from quarry.llm.tokens import by_bytes
from quarry.llm.words import words_of

# Byte classes of the pair statistics. Fixed values.
_CLASS = np.full(256, 9)
_CLASS[0x80:] = 0
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x20] = 4
_CLASS[0x0A] = 5
_CLASS[list(b".,;:")] = 6
_CLASS[list(b"!?")] = 7
_CLASS[list(b"|<>{}[]=/\\")] = 8
_K = 10
N_FEATURES = _K + _K * _K + 9


def features(texts: list[str | None]) -> np.ndarray:
    """One row of float32 features per text."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    w = words_of(texts)
    for i, t in enumerate(texts):
        t = t or ""
        data = w.data[w.text_at[i]:w.text_at[i + 1] - 1]
        if not len(data):
            continue
        kind = _CLASS[data]
        share = np.bincount(kind, minlength=_K) / len(data)
        pair = np.bincount(kind[:-1] * _K + kind[1:], minlength=_K * _K) / max(len(data) - 1, 1)
        h = w.of(i)
        n = max(len(h), 1)
        size = (w.end - w.start)[w.first[i]:w.first[i + 1]]
        lines = [x for x in t.split("\n") if x.strip(ASCII_SPACE)]
        k = max(len(lines), 1)
        out[i, :_K] = np.sqrt(share)
        out[i, _K:_K + _K * _K] = np.sqrt(pair)
        out[i, _K + _K * _K:] = (
            np.log1p(len(h)), size.mean() if len(size) else 0, size.max() if len(size) else 0, np.log1p(len(lines)),
            1 - len(set(lines)) / k, len(np.unique(h)) / n, (h[1:] == h[:-1]).sum() / n, repeated_words(h) / n,
            np.log1p(len(h) / k))
    return out


@dataclass
class PUModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(xp: np.ndarray, xu: np.ndarray, prior: float | None, steps: int, rate: float, decay: float) -> np.ndarray:
    """Weights (bias last). ``prior`` None: plain separation of the two samples."""
    w = np.zeros(xp.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for s in range(1, steps + 1):
        zp, zu = xp @ w, xu @ w
        up = xp.T @ (sig(zp) - 1) / len(xp)      # gradient of E_p[l(g)]
        down_p = xp.T @ sig(zp) / len(xp)        # of E_p[l(-g)]
        down_u = xu.T @ sig(zu) / len(xu)        # of E_u[l(-g)]
        if prior is None:
            g = up + down_u
        else:
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g = prior * up + (down_u - prior * down_p) if rest >= 0 else -(down_u - prior * down_p)
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** s)) / (np.sqrt(v / (1 - 0.999 ** s)) + 1e-8)
    return w


def class_prior(sp: np.ndarray, su: np.ndarray, least: float = 0.2) -> float:
    """Lower envelope of P_u(s >= t) / P_p(s >= t), over regions that hold a fifth of the positives at least."""
    t = np.quantile(sp, np.linspace(0, 1 - least, 41))
    fp = (sp[None, :] >= t[:, None]).mean(1)
    fu = (su[None, :] >= t[:, None]).mean(1)
    slack = np.sqrt(np.log(40.0) / 2 / max(min(len(sp), len(su)), 1))  # of either share, by the DKW bound
    return float(np.clip(((fu + slack) / np.maximum(fp - slack, 0.05)).min(), 0.05, 0.98))


def fit_arrays(xp: np.ndarray, xu: np.ndarray, prior: float | None = None, steps: int = 600) -> PUModel:
    both = np.concatenate([xp, xu]).astype(float)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    one = lambda x: np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    ap, au = one(xp), one(xu)
    if prior is None:
        w = _adam(ap, au, None, steps // 2, 0.02, 1e-3)
        prior = class_prior(ap @ w, au @ w)
    w = _adam(ap, au, prior, steps, 0.02, 1e-4)
    return PUModel(mean, scale, w[:-1], float(w[-1]), prior)


def labelled_prior(labels: DataFrame, quality: str = "quality", caution: float = 0.97) -> float | None:
    """Share of positives among labelled rows, taken a little low: an overestimate makes the negative part of the
    risk vanish, an underestimate costs little. None without rows of both classes."""
    share = labels.agg(F.avg(F.col(quality).cast("double")).alias("p")).first().p
    return None if share is None or share in (0.0, 1.0) else share * caution


def fit(docs: DataFrame, positives: DataFrame, key: str = "doc_id", text: str = "text", max_positive: int = 8000,
        max_unlabelled: int = 16000, prior: float | None = None) -> PUModel:
    """Fit on documents whose keys are in ``positives`` and a sample of all documents."""

    def draw(ids: DataFrame, most: int, kind: int) -> DataFrame:
        ids = ids.select(F.col(key).alias("_key")).filter(F.col("_key").isNotNull())
        return ids.distinct().orderBy(F.xxhash64(F.lit(kind), "_key"), "_key").limit(most).select("_key", F.lit(kind).alias("_kind"))

    drawn = draw(positives, max_positive, 1).unionByName(draw(docs, max_unlabelled, 0))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_key").select("_kind", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = [features(texts[lo:hi]) for lo, hi in by_bytes(texts)]
            vectors = [v.tobytes() for part in x for v in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], ["kind", "x"])

    got = rows.mapInArrow(run, "kind int, x binary").toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, N_FEATURES)
    kind = got["kind"].to_numpy()
    if not (kind == 1).any() or not (kind == 0).any():
        return PUModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5)
    return fit_arrays(x[kind == 1], x[kind == 0], prior)


def with_quality(docs: DataFrame, model: PUModel, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score`` in [0, 1]."""
    at, schema = docs.columns.index(text), with_fields(docs, **{score: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            s = [model.score(features(texts[lo:hi])) for lo, hi in by_bytes(texts)]
            got = pa.array(np.concatenate(s) if s else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], schema.names)

    return docs.mapInArrow(run, schema)
