import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat_format as C
from quarry.llm import decontaminate as D
from quarry.llm import pii as P
from quarry.llm import quality_pu as Q
from quarry.llm import rules as R
from quarry.llm import toxicity as T
from quarry.llm.sharding import shard_by_bytes


def python_nodes(df):
    return re.findall(r"\w*(?:Python|Pandas|Arrow)\w*", df._jdf.queryExecution().executedPlan().toString())


# ---- chat ----------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<|end|>", "\n", "<|turn|>", "<|says|>", "<", "\\", "|", ">", "<\\|", "hi", "𝄞", "", "<|chat:1|>\n"]
    rows = [(c, t, rng.choice(["user", "assistant", None, "<|says|>"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 6))))
            for c in range(300) for t in range(rng.randint(1, 5))]
    rows += [(None, 1, "assistant", None), (-5, None, "user", "x"), (-5, 0, "user", "y"), (-5, 0, "user", "y")]
    out = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert not python_nodes(out)
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = out.withColumns({"t": C.parse(F.col("formatted")), "m": C.masked_text(F.col("formatted"), F.col("loss_spans"))}).collect()
    assert len(got) == len(want)
    for r in got:
        assert [(x.role, x.text) for x in r.t] == want[r.conv_id]
        assert r.m == "".join(t for role, t in want[r.conv_id] if role == "assistant")
    assert any(r.escaped for r in got) and any(not r.escaped for r in got)


# ---- sharding ------------------------------------------------------------------------------------
def test_shards(spark, odd_docs):
    rows = [(7 if i % 3 == 0 else i, "x" * (i * 37 % 900)) for i in range(6000)]  # one id holds a third
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 10, rows_per_range=100)
    assert not python_nodes(out)
    got = out.toPandas()
    per = got.groupby("shard").agg(b=("size", "sum"), n=("slot", "count"), top=("slot", "max"))
    assert len(got) == 6000 and len(per) == 10 and (per.top + 1 == per.n).all() and not got.duplicated(["shard", "slot"]).any()
    assert per.b.max() - per.b.min() < 0.02 * per.b.mean()
    odd = shard_by_bytes(odd_docs, 4).toPandas()
    assert len(odd) == 11 and sorted(odd["size"])[:3] == [16, 16, 16] and not odd.duplicated(["shard", "slot"]).any()
    assert shard_by_bytes(odd_docs.limit(0), 4).count() == 0


# ---- rules ---------------------------------------------------------------------------------------
def test_rules(spark, odd_docs, duck):
    texts = [r[0] for r in duck.execute("SELECT text FROM documents LIMIT 80").fetchall()] + ["a b c a b c", "\n\nx\n x\nx", None, ""]
    b = R.Batch(texts)
    every = np.arange(len(texts))
    got = {m: b.get(m, every) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        covered = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in (k, k + 1, k + 2)} if len(w) < 2000 else None
        assert got["n_words"][i] == len(w) and got["word_chars"][i] == sum(map(len, w))
        assert got["n_symbols"][i] == sum(c in "#*$%&|<>" for c in t or "") and got["n_dup_lines"][i] == len(lines) - len(set(lines))
        assert covered is None or got["n_repeat_words"][i] == len(covered)
    clean = odd_docs.limit(1).selectExpr("cast(9 as long) doc_id", f"'{' '.join(f'word{i}' for i in range(60))}' text", "_key", "n", "sig", "score", "_row")
    for order in (list(R.RULES), list(R.RULES)[::-1]):
        judged = R.cascade(odd_docs.union(clean), order, metrics=("n_words",))
        assert judged.columns == [*odd_docs.columns, "n_words", "rejected_by"]
        assert sorted(r.doc_id for r in judged.filter("rejected_by IS NULL").collect()) == [9]
    assert [r.name for r in R.cheapest_order([("symbols", 1.0, 5.0), ("few_words", 1.0, 9.0)])[:2]] == ["few_words", "symbols"]
    assert {m[0] for m in R.measure(odd_docs)} == {r.name for r in R.RULES} and R.measure(odd_docs.limit(0)) == []
    b, verdict = R.run_cascade(["short", "z " * 400], [R.RULES[0], R.RULES[1]])
    assert verdict.tolist() == [0, 1] and not b.done["n_repeat_words"][0]  # the rejected text is not looked at again


# ---- personal data -------------------------------------------------------------------------------
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": all(int(x or 0) <= 255 for x in v.split(".")) if kind == "ip" else True,
            "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_pii_spans(spark):
    rng = random.Random(4)
    bits = list("1290.@aB-+ ()é𝄞_%\n") + ["4111 1111 1111 1111", "+1 (555) 555-1234", "a@b.c", "1.2.3.4", "0255.00.1.2"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(800)] + [None, "", "a" * 40_000 + "@b.c", "1." * 9000]
    out = P.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"])
    assert not python_nodes(out)
    for r in out.select("doc_id", P.span_text(P.KINDS).alias("s")).collect():
        t = texts[r.doc_id] or ""
        assert r.s == ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m.group()))


def test_pii_disclosure_and_masks(spark, odd_docs):
    rows = [(i, f"note {i} about Zarquon{'' if i < 4 else 'x%d' % i} and mail {'joe@x.org' if i < 4 else 'none'} common words tail{i}") for i in range(60)]
    got = {r.doc_id: r.text for r in P.sanitize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Zarquon" not in got[0] and "[EMAIL]" in got[0] and "common words" in got[0]  # the name stands only beside this entity
    assert got[10] == rows[10][1]
    same = [(i, "Zarquon writes from joe@x.org today") for i in range(9)] + [(50 + i, f"other text {i}") for i in range(30)]
    kept = {r.doc_id: r.text for r in P.sanitize(spark.createDataFrame(same, "doc_id long, text string")).collect()}
    assert kept[0] == "Zarquon writes from [EMAIL] today"  # copies are one context, so no evidence
    clean = P.sanitize(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == 11
    assert clean.filter("doc_id = 8").first().text == "é𝄞 mail [EMAIL] now" and clean.filter("_key = 'k' AND _row = 3").count() == 11


def test_pii_terms_go_wherever_they_stand(spark):
    """Far from the entity, in documents without it, at the window's edges, and short; also inside a longer run that is no term."""
    far = " ".join(f"f{i}" for i in range(60))
    rows = [(i, f"Bo note {i} Zarquon joe@x.org {far} end zarquon{'.' * i}") for i in range(4)]
    rows += [(10, "nothing but ZARQUON here and BO."), (11, "Zarquonia and Bob stay, 7zarquon goes")]
    rows += [(20 + i, f"other text {i} end note {far}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text.lower() for r in P.sanitize(docs).collect()}
    assert not any(re.search(r"\b(zarquon|bo)\b", got[i]) for i in (0, 1, 2, 3, 10))
    assert "zarquonia and bob stay" in got[11] and "7zarquon" not in got[11] and got[20] == rows[6][1]
    edge = [(i, f"{i} {'-' * 5}Edgy {'!' * 75}joe@x.org{'!' * 75} Last-{i}") for i in range(4)]
    near = P.detect(spark.createDataFrame(edge, "doc_id long, text string")).first()["_near"][0]["terms"]
    assert near == ["edgy", "last"]
    cut = [(1, f"ab12cd {'!' * 77}joe@x.org{'!' * 78} Lastly")]
    assert P.detect(spark.createDataFrame(cut, "doc_id long, text string")).first()["_near"][0]["terms"] == []


def test_pii_copies_do_not_make_a_term_common(spark):
    """A copied document that holds entity and term counts once in every count, and its copies lose the term too."""
    rows = [(i, f"note {min(i, 2)} from Zarquon at joe@x.org") for i in range(40)] + [(100 + i, f"note {i} from none at all") for i in range(200)]
    got = {r.doc_id: r.text for r in P.sanitize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any("Zarquon" in got[i] for i in range(40)) and "from" in got[0] and got[100] == rows[40][1]


# ---- decontamination -----------------------------------------------------------------------------
def test_leaks(spark, odd_docs):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    item = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 50))) for _ in range(60)]
    rows = []
    for d in range(200):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 300))]
        if d % 4 == 0:
            k = rng.randrange(len(t) + 1)
            t[k:k] = [x.upper() + "," for x in item[d % 60].split()]
        rows.append((d, " ".join(t)))
    items = spark.createDataFrame([*enumerate(item), (99, None), (98, "")], "item_id long, text string").select("item_id", *D.split_item())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()}

    def share(part, words):
        k = min(5, len(part))
        want = {tuple(part[i:i + k]) for i in range(len(part) - k + 1)}
        have = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}
        return len(want & have) / max(len(want), 1)

    want = set()
    for d, t in rows:
        words = re.findall(r"\w+", t.lower())
        for i, x in enumerate(item):
            part = x.split()
            half = -(-len(part) // 2)
            if min(share(part[:half], words), share(part[half:], words) if part[half:] else 1) >= 0.8:
                want.add((d, i))
    whole = {(d, d % 60) for d in range(0, 200, 4)}
    assert whole <= got <= want
    assert {r.doc_id for r in D.drop_leaks(docs, items).collect()} == set(range(200)) - {d for d, _ in got}
    assert D.drop_leaks(odd_docs, items).columns == odd_docs.columns and D.find_leaks(odd_docs.limit(0), items).count() == 0
    assert D.drop_leaks(odd_docs, items.limit(0)).count() == 11


def test_leaks_with_edited_words(spark):
    """Items of 16 to 59 words with one to three edited, inserted or dropped words, or one half quoted in part; a
    question alone is no leak."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    item = [some(rng.randint(16, 59)) for _ in range(60)]
    rows = []
    for d, x in enumerate(item):
        t, half = list(x), -(-len(x) // 2)
        if d % 5 == 3:
            t = t[:half + (len(t) - half) * 3 // 4]
        elif d % 5 == 4:
            t = t[:half]
        else:
            for _ in range(d % 5 + 1):
                k = rng.randrange(len(t))
                t[k:k + rng.randint(0, 1)] = some(rng.randint(0, 1))
        rows.append((d, " ".join(some(rng.randint(0, 150)) + t + some(100))))
    items = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(item)], "item_id long, text string").select("item_id", *D.split_item())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d for d in range(60) if d % 5 != 4}
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()} == {(d, d) for d in want}
    assert {r.doc_id for r in D.drop_leaks(docs, items).collect()} == set(range(60)) - want


def test_block_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, 12) % 50), " ".join(f"w{x}" for x in rng.zipf(1.5, 9) % 50)) for i in range(70)]
    ix = D.build_index(rows, 0.5, 0.25)
    for _ in range(60):
        words = D.words_of([" ".join(f"w{x}" for x in rng.zipf(1.5, 55) % 50)], D.ALNUM).of(0)
        exact = [k for b in range(ix.n_blocks) for k, _ in ix._open(words, b)]
        term = np.searchsorted(ix.vocab, words)
        known = ix.vocab[np.minimum(term, len(ix.vocab) - 1)] == words
        bound = ix._bounds(np.zeros(known.sum(), int), term[known], 1)[0]
        assert all(bound[k // D.BLOCK] >= ix.threshold - ix.slack - 1e-9 for k in exact)


# ---- classifiers ---------------------------------------------------------------------------------
def test_maximal_segments_match_the_definition():
    rng = np.random.default_rng(1)

    def slow(s, lo, hi):
        best = max(((s[a:b].sum(), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, _, a, b = best
        return slow(s, lo, a) + [(a, b)] + slow(s, b, hi)

    for _ in range(150):
        s = rng.integers(-4, 5, rng.integers(0, 14)).astype(float) + rng.random() * 1e-3
        s += rng.random(len(s)) * 1e-4
        got = T.maximal_segments(s)
        assert [(a, b) for a, b, _ in got] == slow(s, 0, len(s))
        assert T.best_segment(s) == pytest.approx(max([0.0, *(x for _, _, x in got)]))


def test_toxicity_learns_and_handles_odd_rows(spark, odd_docs):
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for d in range(500):
        t = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        toxic = int(d % 5 == 0)
        if toxic:
            k = rng.randrange(len(t))
            t[k:k] = [rng.choice(("idiot", "scum", "vequ" + rng.choice(vocab))) for _ in range(5)]
        rows.append((d, " ".join(t)))
        labels.append((d, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in T.with_toxicity(docs, model).collect()}
    right = sum((got[d].score >= 0.3) == bool(y) for d, y in labels if d % 2 == 0)
    assert right >= 0.95 * 250
    assert all(got[d].segments for d, y in labels if y and got[d].score > 0.9)
    odd = T.with_toxicity(odd_docs.drop("score"), model).toPandas()
    assert len(odd) == 11 and odd.score.between(0, 1).all()
    none = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert set(T.with_toxicity(docs, none).toPandas().score) == {0.0}


def test_quality_learns_from_positives_and_unlabelled(spark, odd_docs, duck):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = known.filter("doc_id % 2 = 1")
    model = Q.fit(docs, train.filter("quality = 1"), prior=Q.labelled_prior(train))
    held = Q.with_quality(docs, model).join(known.filter("doc_id % 2 = 0"), "doc_id").toPandas()
    assert ((held.score >= 0.3) == (held.quality == 1)).mean() > 0.95
    odd = Q.with_quality(odd_docs, model, score="q").toPandas()
    assert len(odd) == 11 and odd.q.between(0, 1).all() and odd.score.eq(2.0).all()
    flat = Q.fit(docs, known.limit(0))
    assert set(Q.with_quality(odd_docs, flat, score="q").toPandas().q) == {0.5}
    assert Q.labelled_prior(known.limit(0)) is None


def test_prior_from_samples():
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 1000)
    prior = Q.class_prior(p, np.concatenate([rng.normal(2, 1, 4000), n]))
    assert 0.75 < prior < 0.9


def test_repeated_items_report_each_and_long_texts_are_searched_in_slices(spark, monkeypatch):
    """More copies of an item than an index may hold; a long text with items in many places, in slices of a few windows or whole."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(2000)]
    item = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(40)]
    noise = [rng.choice(vocab) for _ in range(60_000)]
    where = {7: 0, 13: 31, 29: 30_000, 31: 59_999}
    for k, at in sorted(where.items(), key=lambda x: -x[1]):
        noise[at:at] = item[k].split()
    long = " ".join(noise)
    index = D.build_index([(i, *[" ".join(x.split()[j:j + 15]) for j in (0, 15)], 1) for i, x in enumerate(item)], 0.6, 0.3)
    whole = index.search([long, "", item[3], None])
    assert {k for k, v in whole[0].items() if min(v[1:]) >= D.OVERLAP} == set(where) and set(whole[2]) == {3}
    for cells in (1, 17, 1000):
        monkeypatch.setattr(D, "CELLS", cells)
        assert index.search([long, "", item[3], None]) == whole
    monkeypatch.undo()
    items = spark.range(25_000).select(F.lit(5).cast("long").alias("item_id"), F.lit(item[5]).alias("text")).select("item_id", *D.split_item())
    docs = spark.createDataFrame([(1, item[5]), (2, "clean"), (2, None)], "doc_id long, text string")
    got = D.find_leaks(docs, items)
    assert got.columns == ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    assert [tuple(r) for r in got.groupBy("doc_id", "item_id").count().collect()] == [(1, 5, 25_000)]
    assert [r.doc_id for r in D.drop_leaks(docs, items).collect()] == [2, 2]
