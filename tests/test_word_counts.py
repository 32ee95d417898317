"""Word counts within a row, the bigram model from them, and the tasks of nested documents."""

import math
from collections import Counter

from quarry.plans import perplexity as P
from quarry.plans import story_eval as SE
from quarry.sinks import nested as N

TEXTS = [(1, "a b a b  c a", "s"), (2, "", "s"), (3, None, "s"), (4, "é a", "t"), (5, "x", "t"), (5, "x a a", "t"), (None, "a b", "t")]


def test_counts_are_those_of_the_tokens_and_nothing_is_shuffled(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string, source string")
    rows = P.exploded_words(P.with_word_counts(P.doc_tokens(docs, "doc_id", "text")), "doc_id")
    want = [(k, w, n) for k, t, _ in TEXTS for w, n in Counter((t or "").split()).items()]
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(want, key=repr)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_bigram_scores_against_plain_counts_and_without_a_table_of_all_pairs(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(P, "materialize", lambda df, name, real=P.materialize: made.setdefault(name, real(df, name)))
    docs = spark.createDataFrame([t for t in TEXTS if t[0]], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.Perplexity for r in P.ngram_perplexity(docs, order=2).collect()}
    toks = [(k, (t or "").split()) for k, t, _ in TEXTS if k]
    uni = Counter(w for _, t in toks for w in t)
    bi = Counter(p for _, t in toks for p in zip(t, t[1:]))
    n, v = sum(uni.values()), len(uni)
    lp, size = Counter(), Counter()
    for k, t in toks:
        size[k] += len(t)
        lp[k] += sum(math.log((uni[w] + 1) / (n + v)) for w in t[:1])
        lp[k] += sum(math.log((bi[p] + 1) / (uni[p[0]] + v)) for p in zip(t, t[1:]))
    for k in got:
        assert got[k] is None if not size[k] else abs(got[k] - math.exp(-lp[k] / size[k])) < 1e-9
    assert {(r.v, r.w): r.c_vw for r in made["ppl-bigram-counts"].collect()} == {p: c for p, c in bi.items() if c > 1}
    assert "ppl-bigram-lp" not in made and "ppl-doc-pairs" not in made


def test_story_metrics_write_no_token_arrays(spark, monkeypatch):
    made = {}
    keep = lambda df, name, real=SE.materialize: made.setdefault(name, real(df, name))
    monkeypatch.setattr(P, "materialize", keep)
    monkeypatch.setattr(SE, "materialize", keep)
    docs = spark.createDataFrame([(k, t, s, "en") for k, t, s in TEXTS if k != 5], "doc_id bigint, text string, source string, lang string")
    per = {r.doc_id: r for r in SE.story_metrics(docs).collect()}
    assert per[1].unique_1gram == 3 and per[1].total_2gram == 5 and per[2].Perplexity is None
    assert set(made) == {"story-words", "ppl-counts", "story-metrics"} and "tk" not in made["story-words"].columns


def test_nested_tasks_follow_rows_and_cores():
    assert N._tasks(0, 2_000, 4) == 1
    assert N._tasks(30_000, 2_000, 4) == 15
    assert N._tasks(54_000_000, 2_000, 12) == 108
    assert N._tasks(54_000_000, 500_000, 12) == 108
    assert N._tasks(900_000, 2_000, 12) == 48
