import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import subword_lm as lm
from quarry.llm.queries import op13

PATH = public_tokenizers.path("piece_bpe_32k.model")


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain_logp(word, pieces):
    """Probability over all segmentations, by the definition: ways[j] is the sum over pieces that end at j."""
    p = dict(zip(pieces.text[:-1], np.exp(pieces.logp[:-1]).tolist(), strict=True))
    raw = b" " + word
    ways = [1.0] + [0.0] * len(raw)
    for j in range(1, len(raw) + 1):
        ways[j] = sum(ways[i] * p.get(raw[i:j], 0.0) for i in range(max(0, j - pieces.longest), j))
    return math.log(ways[-1])


def plain_counts(words, pieces):
    """Expected piece counts by listing every segmentation."""
    p = dict(zip(pieces.text[:-1], np.exp(pieces.logp[:-1]).tolist(), strict=True))
    place = {t: i for i, t in enumerate(pieces.text)}

    def ways(raw):
        if not raw:
            yield [], 1.0
        for k in range(1, len(raw) + 1):
            if raw[:k] in p:
                for rest, q in ways(raw[k:]):
                    yield [raw[:k], *rest], p[raw[:k]] * q
    out = np.zeros(len(pieces.text))
    for w, c in words.items():
        every = list(ways(b" " + w))
        total = sum(q for _, q in every)
        for seg, q in every:
            for t in seg:
                out[place[t]] += c * q / total
    return out


def test_pieces_are_a_distribution_that_covers_every_byte():
    pieces = lm.load_pieces(PATH)
    assert abs(np.exp(pieces.logp).sum() - 1) < 1e-9
    assert {bytes([b]) for b in range(256) if not (9 <= b <= 13 or 65 <= b <= 90)} <= set(pieces.text) and pieces.text[-1] == b""
    assert not any(re.search(rb"[A-Z\t\n]|.\x20", t, re.S) for t in pieces.text)


def test_word_probability_sums_all_segmentations():
    pieces = lm.load_pieces(PATH)
    words = ["the", "there", "é", "𝄞x", "a" * 64, "a" * 65, "ab" * 300, "\x00\x7f", "unbelievable", "x"]
    got = lm.word_logp([w.encode() for w in words], pieces)
    for w, g in zip(words, got, strict=True):
        if len(w) < 200:
            assert math.isclose(g, plain_logp(w.encode(), pieces), rel_tol=1e-9), w
    assert math.isclose(lm._long(b" there", pieces), got[1], rel_tol=1e-12)


def test_expected_counts_equal_those_of_listed_segmentations():
    pieces = lm.load_pieces(PATH)
    words = {b"there": 3, b"banana": 2, "né".encode(): 5, b"x": 1}
    got = lm.piece_counts(list(words), np.array(list(words.values()), float), pieces)
    assert np.allclose(got, plain_counts(words, pieces))
    # pieces of a word's segmentations spell the word: bytes add up, in stretches too
    size = np.array([len(t) for t in pieces.text])
    assert math.isclose((lm.piece_counts([b"q" * 150], np.array([2.0]), pieces) * size).sum(), 2 * 151)


def brute(rows, rounds=lm.ROUNDS):
    """Rows (id, text) -> per row n_tokens, n_known, train_tokens, base, score."""
    part = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    count, texts = Counter(), 0
    for i, t in rows:
        if part(i):
            texts += 1
            count.update(words_of(t))
    n, v = sum(count.values()) + texts, len(count) + (texts > 0)
    pieces = lm.load_pieces(PATH)
    prior = lm.PRIOR * np.exp(pieces.logp)
    for _ in range(rounds):
        raw = {w.encode(): c for w, c in count.items()}
        total = prior + lm.piece_counts(list(raw), np.array(list(raw.values()), float), pieces)
        total[-1] += texts
        pieces = pieces.with_logp(np.log(total / total.sum()))
    low = math.log10(n + 0.1 * (v + 1))
    out = []
    for i, t in rows:
        words = words_of(t)
        base = sum(math.log10(count[w] + 0.1) - low for w in words) + math.log10(texts + 0.1) - low
        score = (sum(plain_logp(w.encode(), pieces) for w in words) + pieces.logp[-1]) / math.log(10)
        out.append((i, part(i) == 0, len(words) + 1, sum(count[w] > 0 for w in words) + (texts > 0), n, base, score))
    return out


def same(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2:5], r[5], r[6])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-6), (g, w)


@pytest.mark.parametrize("hot", [0, 40])
def test_scores_equal_brute_force(spark, duck, hot):
    rows = duck.execute("SELECT doc_id, text FROM documents ORDER BY length(text) LIMIT 40").fetchall()
    rows += [(None, None), (None, "the the"), (7, ""), (3, "Same TEXT same"), (3, "Same TEXT same"), (11, "z" * 120 + " q")]
    docs = spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], "doc_id long, text string, h int, kept string, score double").repartition(3)
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    made = lm.score_texts(docs, part != 0, PATH, F.struct("doc_id"), hot=hot)
    got = [(r.kept.doc_id, r.kept.doc_id is None or zlib.crc32(str(r.kept.doc_id).encode()) % 10 == 0, r.n_tokens, r.n_known,
            made.train_tokens, r.base_score, r.score) for r in made.texts.collect()]
    same(got, brute(rows))


def test_odd_rows_and_empty_tables(spark, odd_docs):
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    made = lm.score_texts(odd_docs, part != 0, PATH, F.col("doc_id"))
    got = made.texts.collect()
    assert len(got) == odd_docs.count() and all(r.score < 0 for r in got)
    none = lm.score_texts(odd_docs, F.lit(False), PATH, F.col("doc_id"))
    assert none.train_tokens == 0 and {r.n_known for r in none.texts.collect()} == {0}
    assert lm.score_texts(odd_docs.limit(0), part != 0, PATH, F.col("doc_id")).texts.count() == 0


def test_query_covers_all_rows_and_the_fit_helps(spark, duck):
    got = op13(spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(got.doc_id) == sorted(r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall())
    held = got[got.held_out]
    docs = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    raw = lm.load_pieces(PATH)
    first = [(sum(lm.word_logp([w.encode() for w in words_of(docs[i])], raw)) + raw.logp[-1]) / math.log(10) for i in held.doc_id]
    assert held.score.sum() > sum(first)
