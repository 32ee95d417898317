"""Kneser-Ney on word codes: hot pairs counted in parts, rare words joined apart, repeated and null keys; nothing but numbers is shuffled."""

import math
from collections import Counter

import pytest

from quarry.functions import text as T
from quarry.plans import perplexity as P

ROWS = [(1, "a b a b c"), (2, "a b d"), (3, "the the the the a"), (4, ""), (4, None), (5, "a b a b c"), (6, "only here"), (6, "a b d only here"),
        (7, " ".join(["the", "x"] * 300)), (None, "a b q r"), (None, "q r the x"), (8, " a　b\tthe\nx ")]


def _plain(rows):
    own = {}
    for k, text in rows:
        words = (text or "").split()
        own.setdefault(k, Counter()).update(zip(["", *words], words, strict=False))
    vocab, out = {w for c in own.values() for _, w in c}, {}
    for d, mine in own.items():
        rest = sum((c for k, c in own.items() if k != d), Counter())
        lp = 0.0
        for (v, w), n in mine.items():
            q = (sum(b == w for _, b in rest) + 1) / (len(rest) + len(vocab) + 1)
            c_v = sum(c for (a, _), c in rest.items() if a == v)
            p = q if not c_v else (max(rest[v, w] - P.DISCOUNT, 0) + P.DISCOUNT * sum(a == v for a, _ in rest) * q) / c_v
            lp += n * math.log(p)
        n = sum(mine.values())
        out[d] = (math.exp(-lp / n), n) if n and d is not None else (None, None)
    return out


@pytest.mark.parametrize(("words", "hot"), [(2, True), (500_000, False)])
def test_equals_a_plain_restatement_whatever_is_hot(spark, monkeypatch, words, hot):
    made = {}
    monkeypatch.setattr(P, "materialize", lambda df, name, real=P.materialize: made.setdefault(name, real(df, name)))
    monkeypatch.setattr(P, "HOT_WORDS", words)
    least = 2 if hot else 10_000
    monkeypatch.setattr(P, "hot_pairs", lambda codes, key: P.code_pairs(codes, key).groupBy("v", "w").count().where(f"count > {least}").select("v", "w"))
    got = P.kneser_ney_perplexity(spark.createDataFrame(ROWS, "doc_id long, text string"))
    want = _plain(ROWS)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(ROWS)
    for k, ppl, n in rows:
        assert (ppl, n) == want[k] if want[k][0] is None else (ppl, n) == (pytest.approx(want[k][0], rel=1e-9), want[k][1])
    assert {t for name in ("kn-pairs", "kn-words", "kn-contexts") for c, t in made[name].dtypes if c in "vw"} == {"bigint"}
    assert "kn-with-v" not in made and "kn-model" not in made
    assert (made["kn-hot-counts"].count() > 0) == hot


def test_hot_pairs_are_the_frequent_ones(spark):
    docs = spark.createDataFrame([(i, "x y " * 50 + f"w{i}") for i in range(200)], "doc_id long, text string")
    codes = P.word_codes(docs, "doc_id", "text")
    assert P.hot_pairs(codes, "doc_id", 1.0).count() == 3  # (x, y), (y, x), (START, x)
    assert P.hot_pairs(codes, "doc_id").count() <= P.HOT_PAIRS


def test_split_by_spaces_is_split(spark):
    odd = ["", " ", "a", " a  b\n\nc\t", "a\x0bb", "a\x1cb c", "a b", "a　 b ", "a\r\nb", "é​x y", "\u0085a", None]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", T.py_split_spaces("t").alias("a"), T.py_split("t").alias("b")).collect()
    assert all(r.a == r.b == (r.t or "").split() for r in rows)
