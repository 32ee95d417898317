"""Perplexity by blocks of texts: small blocks and parts against plain counts, and no row per token is written, shuffled or joined."""

import math
import random
from collections import Counter

import pytest

from quarry.operators import token_blocks as TB
from quarry.plans import perplexity as P

RND = random.Random(3)
WORDS = ["a", "b", "the", "é", "x" * 300, "x" * 299 + "y", "　z", "z", "-1", "0"]
ROWS = [(k, " ".join(RND.choice(WORDS) for _ in range(RND.choice([0, 1, 2, 9, 40])))) for k in [*range(30), *range(5), 7, 7, 7, 7, None, None]]
ROWS += [(90, "the a " * 400), (91, None), (92, " \n"), (93, "never seen before")]


@pytest.fixture(params=[(8, 3, 2), (1 << 20, 1 << 21, 500_000)], ids=["tiny", "usual"])
def sizes(request, monkeypatch):
    block, part, words = request.param
    monkeypatch.setattr(TB, "BLOCK_TOKENS", block)
    monkeypatch.setattr(TB, "PART_PAIRS", part)
    monkeypatch.setattr(TB, "LEAST_PAIRS", 1)
    monkeypatch.setattr(P, "HOT_WORDS", words)


def _docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def _made(monkeypatch):
    made = {}
    monkeypatch.setattr(P, "materialize", lambda df, name, real=P.materialize: made.setdefault(name, real(df, name)))
    return made


def _kneser_ney():
    own = {}
    for i, (k, text) in enumerate(ROWS):
        words = (text or "").split()
        own.setdefault(("null", i) if k is None else k, Counter()).update(zip(["", *words], words, strict=False))
    vocab, every = {w for c in own.values() for _, w in c}, sum(own.values(), Counter())
    out = {}
    for d, mine in own.items():
        rest, lp = +(every - mine), 0.0
        by_v, n_v, n_w = Counter(), Counter(v for v, _ in rest), Counter(w for _, w in rest)
        for (v, _), c in rest.items():
            by_v[v] += c
        for (v, w), n in mine.items():
            q = (n_w[w] + 1) / (len(rest) + len(vocab) + 1)
            lp += n * math.log(q if not by_v[v] else (max(rest[v, w] - P.DISCOUNT, 0) + P.DISCOUNT * n_v[v] * q) / by_v[v])
        n = sum(mine.values())
        out[d] = (math.exp(-lp / n), n) if n else (None, None)
    return out


def test_kneser_ney_by_blocks(spark, monkeypatch, sizes):
    made = _made(monkeypatch)
    got, want = P.kneser_ney_perplexity(_docs(spark)).collect(), _kneser_ney()
    assert len(got) == len(ROWS)
    for r in got:
        ppl, n = want[r.doc_id] if r.doc_id is not None else (None, None)
        assert (r.Perplexity, r.n_tokens) == ((None, None) if ppl is None else (pytest.approx(ppl, rel=1e-9), n))
    if TB.BLOCK_TOKENS > 8:  # one row per block and part, not per token
        assert made["kn-pairs"].where("kind = 'p'").count() <= 3 * 64


def test_bigram_by_blocks_without_a_join_of_pairs(spark, monkeypatch, sizes):
    made = _made(monkeypatch)
    scores = P.bigram_scores(P.doc_tokens(_docs(spark), "doc_id", "text"), "doc_id")
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    got = {r.doc_id: r for r in scores.collect()}
    toks = [(k, (t or "").split()) for k, t in ROWS]
    uni, bi = Counter(w for _, t in toks for w in t), Counter(p for _, t in toks for p in zip(t, t[1:], strict=False))
    n, v, lp, size = sum(uni.values()), len(uni), Counter(), Counter()
    for k, t in toks:
        size[k] += len(t)
        lp[k] += sum(math.log((uni[w] + 1) / (n + v)) for w in t[:1]) + sum(math.log((bi[p] + 1) / (uni[p[0]] + v)) for p in zip(t, t[1:], strict=False))
    assert set(got) == {k for k in size if size[k]}
    for k, r in got.items():
        assert (r.sum_lp, r.n_tokens) == (pytest.approx(lp[k], rel=1e-9), size[k])
    assert {(r.v, r.w): r.c_vw for r in made["ppl-bigram-counts"].collect()} == {p: c for p, c in bi.items() if c > 1}


def test_blocks_hold_whole_keys(spark, sizes):
    blocks = P.code_blocks(_docs(spark), "doc_id", "text").select("block", "keys", "ends", "tokens", "n").collect()
    keys = [k for b in blocks for k in b["keys"] if k is not None]
    assert len(keys) == len(set(keys)) and sum(b["n"] for b in blocks) == sum(len(t.split()) + 1 for _, t in ROWS if t and t.split())
    assert all(b["ends"][-1] == len(b["tokens"]) == b["n"] for b in blocks) and (TB.BLOCK_TOKENS > 8 or len(blocks) > 10)


def test_a_word_goes_to_the_same_part_from_every_block():
    import pyarrow as pa
    codes = TB._kit()()[0]
    whole = codes(pa.array(["", *WORDS, ""])).tolist()
    assert whole == [codes(pa.array(["", *WORDS, ""]).slice(i, 1))[0] for i in range(len(WORDS) + 2)]
    assert len(set(whole)) == len(WORDS) + 1 and min(whole) >= 0 and codes(pa.array([], pa.string())).tolist() == []
    assert codes(pa.array([-5, 7], pa.int64())).min() >= 0
