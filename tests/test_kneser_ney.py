"""Kneser-Ney with leave-one-out against a plain restatement that builds the model of all other documents anew for each one."""

import math
from collections import Counter

import pytest

from quarry.plans import perplexity as P

TEXTS = {1: "a b a b c", 2: "a b d", 3: "the the the the a", 4: "", 5: None, 6: "only here", 7: "a b a b c", 8: "the a b the a",
         9: " ".join(["the", "x"] * 300)}


def _pairs(text):
    words = (text or "").split()
    return Counter(zip(["", *words], words, strict=False))


def _plain(texts, d):
    own, rest = _pairs(texts[d]), Counter()
    for k, t in texts.items():
        if k != d:
            rest.update(_pairs(t))
    vocab = {w for t in texts.values() for _, w in _pairs(t)}
    types, lp = len(rest), 0.0
    for (v, w), n in own.items():
        q = (sum(1 for (_, b) in rest if b == w) + 1) / (types + len(vocab) + 1)
        c_v = sum(c for (a, _), c in rest.items() if a == v)
        p = q if not c_v else (max(rest[v, w] - P.DISCOUNT, 0) + P.DISCOUNT * sum(1 for (a, _) in rest if a == v) * q) / c_v
        lp += n * math.log(p)
    n = sum(own.values())
    return (math.exp(-lp / n), n) if n else (None, None)


def test_equals_the_model_of_all_other_documents(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    got = {r.doc_id: (r.Perplexity, r.n_tokens) for r in P.kneser_ney_perplexity(docs).collect()}
    assert set(got) == set(TEXTS)
    for d in TEXTS:
        want = _plain(TEXTS, d)
        assert got[d] == want if want[0] is None else got[d] == (pytest.approx(want[0], rel=1e-9), want[1])


def test_no_text_at_all(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert [tuple(r) for r in P.kneser_ney_perplexity(docs).orderBy("doc_id").collect()] == [(1, None, None), (2, None, None)]
