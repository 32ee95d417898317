"""Perplexity as table jobs.

R-3 ``ngram_perplexity``: a corpus n-gram model with add-one smoothing, trained and applied in
Spark on whole texts:
  unigram  p(w)   = (c(w) + 1) / (N + V)                 N tokens, V distinct tokens
  bigram   p(w|v) = (c(v, w) + 1) / (c(v) + V)            first token scored by the unigram model
  PPL(doc) = exp(-mean over the doc's tokens of ln p)
Unigram scores work on per-document word counts (one tokenising pass, written once). Corpus counts are
partial+final aggregates, totals are one scalar subquery, and every join on a word key is a ``hot_split_join``: the top-k words by corpus count (a bounded broadcast) join
without moving token rows, only the long tail is shuffled by word, so no reducer holds a hot word
and the shuffled volume is the tail's share of the tokens. Bigram and Kneser-Ney scores look their counts up by blocks of texts (``token_blocks``).

R-2 ``logprob_perplexity``: exp(-mean logprob) per doc from a (doc, token, logprob) table; texts with
no scored token stay null and leave the statistics (ledger Q21).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.joins import hot_split_join
from quarry.operators.token_blocks import (
    block_rows,
    block_scores,
    count_pairs,
    pair_parts,
    token_blocks,
    word_figures,
    word_parts,
)
from quarry.session import materialize


def doc_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, T.py_split(text).alias("tk"))


def with_word_counts(tokens: DataFrame, arr: str = "tk", name: str = "words") -> DataFrame:
    """``tokens`` with ``name`` in place of ``arr``: its distinct tokens as (w, n) structs, from the runs of the sorted array. Nothing is
    shuffled and the work is that of a sort within the row."""
    keep = [c for c in tokens.columns if c != arr]
    s = tokens.select(*keep, F.sort_array(arr).alias("_s"))
    n = F.size("_s")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get("_s", i).eqNullSafe(F.get("_s", i - 1)))
    s = s.select(*keep, "_s", F.when(n > 0, starts).alias("_at"))
    return s.select(*keep, F.transform("_at", lambda x, i: F.struct(
        F.get("_s", x).alias("w"), (F.coalesce(F.get("_at", i + 1), n) - x).cast("bigint").alias("n"))).alias(name))


def exploded_words(counted: DataFrame, key: str, name: str = "words") -> DataFrame:
    """(key, w, n) from the ``with_word_counts`` column. Rows of one key are not added up: every reader sums ``n``."""
    return _tokens_long(counted, key, name, "p").select(key, "p.w", "p.n")


def doc_words(tokens: DataFrame, key: str, arr: str = "tk") -> DataFrame:
    """(key, w, n): word counts per row of ``tokens``, written once by the pass that tokenises. A row's tokens are counted within it, so
    neither tokens nor counts are shuffled."""
    return materialize(exploded_words(with_word_counts(tokens.select(key, arr), arr), key), "ppl-doc-words")


def word_counts(rows: DataFrame) -> DataFrame:
    """Corpus counts per word (partial+final aggregate: a hot word is one row per map task)."""
    return rows.groupBy("w").agg(F.sum("n").alias("c"))


def _tokens_long(tok: DataFrame, key: str, arr, name: str) -> DataFrame:
    """One row per array element. ``explode_outer`` + a null filter instead of ``explode``: Spark
    infers ``size(array) > 0`` from an inner explode and pushes it to the scan, where it would
    tokenise every text a second time (and, on an unsplittable input, in a single task)."""
    return tok.select(key, F.explode_outer(arr).alias(name)).where(F.col(name).isNotNull())


def unigram_model(counts: DataFrame) -> DataFrame:
    """(w, c, lp) with lp = ln((c + 1) / (N + V)); N and V come from one scalar subquery."""
    tot = counts.select(F.struct(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))).scalar()
    return counts.select("w", "c", F.ln((F.col("c") + 1) / (tot["n"] + tot["v"])).alias("lp"))


def _score(rows: DataFrame, model: DataFrame, keys: list[str], weight: str, key: str, times: str | None = None) -> DataFrame:
    """(doc, sum_lp, n_tokens): each row joined to its log-probability (hot keys broadcast, the cold tail
    shuffled), then summed per doc; ``times`` is the column that says how often a row counts."""
    j = hot_split_join(rows, model, keys, weight)
    n = F.col(times) if times else F.lit(1)
    return j.groupBy(key).agg(F.sum(n * F.col("lp")).alias("sum_lp"), F.sum(n).cast("bigint").alias("n_tokens"))


def unigram_scores(words: DataFrame, key: str) -> DataFrame:
    """(doc, sum_lp, n_tokens) under the unigram model of the whole ``doc_words`` table."""
    uni = unigram_model(materialize(word_counts(words), "ppl-counts"))
    return _score(words, uni.select("w", "c", "lp"), ["w"], "c", key, "n")


def perplexity_of(scores: DataFrame, key: str) -> DataFrame:
    return scores.select(key, F.exp(-F.col("sum_lp") / F.col("n_tokens")).alias("Perplexity"))


START = ""  # the context of a text's first token; no token is empty
DISCOUNT = 0.75


def with_start(tokens: Column) -> Column:
    """``tokens`` after START."""
    return F.concat(F.array(F.lit(START)), tokens)


def code_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``token_blocks`` of each token's 64-bit hash, written once by the pass that tokenises. Two of V words share a code with a chance of V^2 / 2^65
    (10 million words: 3e-6). Rows of one key are in one block."""
    tk = docs.select(key, with_start(T.py_split(text)).alias("tk"))
    return token_blocks(tk.select(key, F.transform("tk", lambda w: F.xxhash64(w)).alias("codes")), key, "codes", "kn-codes", whole_keys=True)


def word_codes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, codes): each token's code in text order, START's before the first; no row where a text has no token."""
    return block_rows(code_blocks(docs, key, text), key, "codes")


def code_pairs(codes: DataFrame, key: str) -> DataFrame:
    """(key, v, w): one row per token, its code and that of the token before it."""
    pairs = F.zip_with("codes", F.slice("codes", 2, F.size("codes")), lambda a, b: F.struct(a.alias("v"), b.alias("w")))
    return _tokens_long(codes, key, pairs, "p").select(key, "p.v", "p.w").where(F.col("w").isNotNull())


HOT_PAIRS = 2_000
HOT_WORDS = 500_000  # words of blocks, hot or not, that one task answers for
START_CODE = -7444071767201028348  # xxhash64 of START


def hot_pairs(codes: DataFrame, key: str, share: float = 0.05) -> DataFrame:
    """(v, w): at most HOT_PAIRS pairs that make up more than about 1 / HOT_PAIRS of all tokens, told by a sample of documents. Their counts
    are broadcast; which pairs are here changes no result."""
    some = codes.sample(share, 7)
    n_some = some.agg(F.sum(F.size("codes") - 1)).first()[0] or 0
    n = code_pairs(some, key).groupBy("v", "w").agg(F.count(F.lit(1)).alias("_n"))
    return n.where(F.col("_n") > max(1.0, n_some / HOT_PAIRS)).orderBy(F.col("_n").desc(), "v", "w").limit(HOT_PAIRS).select("v", "w")


def bigram_scores(tok: DataFrame, key: str) -> DataFrame:
    """(doc, sum_lp, n_tokens) under the bigram model (first token scored by the unigram model), from token arrays: ln p(w|v) = ln(c(v, w) + 1) -
    ln(c(v) + V). Blocks of texts, written once, look up the counts of their distinct pairs and words (``token_blocks``); the pairs that come
    again are the model's table, written as such."""
    blocks = token_blocks(tok.select(key, with_start(F.col("tk")).alias("tk")), key, "tk", "ppl-tokens")
    parts, n_word_parts = pair_parts(blocks), word_parts(blocks, HOT_WORDS)
    words = materialize(word_figures(blocks, n_word_parts), "ppl-words")
    pairs = materialize(count_pairs(blocks, START, parts, "again"), "ppl-pairs")
    materialize(pairs.where("kind = 'a'").select(F.inline(F.arrays_zip(F.col("a").alias("v"), F.col("b").alias("w"), F.col("x").alias("c_vw")))),
                "ppl-bigram-counts")
    total = words.where("kind = 't'").agg(F.sum(F.get("x", F.lit(0))), F.sum(F.get("x", F.lit(1)))).first()
    starts = blocks.agg(F.sum(F.size("ends"))).first()[0] or 0
    v_size, n = (total[0] or 1) - 1, (total[1] or 0) - starts  # without START

    def score(np, b):
        first = b["v"] == b["start"]
        c = np.where(first, b["x"][b["w"]], b["c_vw"][b["pair"]]) + 1
        lp = np.log(c) - np.log(np.where(first, n + v_size, b["x"][b["v"]] + v_size))
        return np.bincount(b["doc"], weights=lp, minlength=b["n_docs"]), np.bincount(b["doc"], minlength=b["n_docs"])
    rows = block_scores(blocks, pairs, words, START, parts, n_word_parts, score, key, without_start=True)
    return rows.groupBy(key).agg(F.sum("sum_lp").alias("sum_lp"), F.sum("n_tokens").alias("n_tokens"))


def kneser_ney_scores(blocks: DataFrame, key: str, discount: float = DISCOUNT) -> DataFrame:
    """(doc, sum_lp, n_tokens) of ``code_blocks`` under an interpolated Kneser-Ney bigram model of all other documents.

      p(w|v)  = max(c(v,w) - D, 0) / c(v) + D * N(v.) / c(v) * q(w)     (q(w) where v was never seen)
      q(w)    = (N(.w) + 1) / (N(..) + V + 1)                            V distinct words, one place for unseen ones

    N(v.), N(.w), N(..) count distinct pairs. Leave one out: each document's own counts are taken off the corpus counts, and pairs that no
    other document holds are taken off the distinct counts, so a text is not scored by itself and words only it has count as unseen.

    A document is in one block, which asks for c(v,w) of its distinct pairs and the figures of its words (``token_blocks``); a pair is the document's
    own if it has all c(v,w) of it. The counts of hot pairs are broadcast."""
    parts, n_word_parts = pair_parts(blocks), word_parts(blocks, HOT_WORDS)
    hot = hot_pairs(block_rows(blocks, key, "codes"), key).limit(HOT_PAIRS).collect()
    hot = {"v": [r.v for r in hot], "w": [r.w for r in hot]}
    pairs = materialize(count_pairs(blocks, START_CODE, parts, "words", hot), "kn-pairs")
    three = lambda kind, a, b: pairs.where(F.col("kind") == kind).select(F.inline(F.arrays_zip(F.col("a").alias(a), F.col(b).alias(b), "x")))
    whole = materialize(three("h", "v", "b").select("v", F.col("b").alias("w"), F.col("x").alias("c_vw")), "kn-hot-counts")
    counted = {(r.v, r.w): r.c_vw for r in whole.collect()}
    hot["c"] = [counted[p] for p in zip(hot["v"], hot["w"], strict=True)]
    by = lambda kind, name: (three(kind, name, "y").unionByName(whole.select(name, F.lit(1).cast("long").alias("y"), F.col("c_vw").alias("x")))
                             .groupBy(name).agg(F.sum("x").alias(f"c_{name}"), F.sum("y").alias(f"n_{name}")))
    by_v, by_w = materialize(by("v", "v"), "kn-contexts"), materialize(by("w", "w"), "kn-words")
    t, v_size = (x or 0 for x in by_w.agg(F.sum("n_w"), F.count(F.lit(1))).first())
    zero = F.lit(0).cast("long")
    figures = by_v.select("v", "c_v", "n_v", zero.alias("n_w")).unionByName(by_w.select(F.col("w").alias("v"), zero.alias("c_v"), zero.alias("n_v"), "n_w"))

    def score(np, b):
        n_pairs, n_words, n_docs = len(b["pairs"]), b["n_words"], b["n_docs"]
        mine, n = np.unique(b["doc"].astype(np.int64) * n_pairs + b["pair"], return_counts=True)  # by document, v and w
        doc, pair = mine // n_pairs, mine % n_pairs
        v, w, c_vw = b["pairs"][pair] // n_words, b["pairs"][pair] % n_words, b["c_vw"][pair]
        own = (n == c_vw).astype(np.int64)
        dv = doc * n_words + v
        begin = np.flatnonzero(np.append(True, dv[1:] != dv[:-1]))
        size = np.diff(np.append(begin, len(dv)))
        n_dv, own_v = (np.repeat(np.add.reduceat(x, begin), size) for x in (n, own))
        _, dw = np.unique(doc * n_words + w, return_inverse=True)
        own_w = np.bincount(dw, weights=own)[dw]
        own_d = np.bincount(doc, weights=own, minlength=n_docs)[doc]
        q = (b["z"][w] - own_w + 1) / (t - own_d + v_size + 1)
        c_v = b["x"][v] - n_dv
        seen = (np.maximum(c_vw - n - discount, 0.0) + discount * (b["y"][v] - own_v) * q) / np.maximum(c_v, 1)
        lp = n * np.log(np.where(c_v > 0, seen, q))
        return np.bincount(doc, weights=lp, minlength=n_docs), np.bincount(doc, weights=n, minlength=n_docs)
    rows = block_scores(blocks, pairs, word_figures(blocks, n_word_parts, figures, "v"), START_CODE, parts, n_word_parts, score, key, hot)
    return rows.where(F.col(key).isNotNull())  # rows without a key count in the model; no score is theirs


def kneser_ney_perplexity(docs: DataFrame, key: str = "doc_id", text: str = "text", discount: float = DISCOUNT) -> DataFrame:
    """R-3 with a smoothed model: per document ``Perplexity`` (null when the text has no token) and ``n_tokens``. Rows of one key are
    one document."""
    scores = kneser_ney_scores(code_blocks(docs, key, text), key, discount)
    ppl = scores.select(key, F.exp(-F.col("sum_lp") / F.col("n_tokens")).alias("Perplexity"), "n_tokens")
    return docs.select(key).join(ppl, key, "left")


def ngram_perplexity(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 1,
                     keep: list[str] | None = None) -> DataFrame:
    """R-3: per doc ``Perplexity`` (null when the text has no token), plus the ``keep`` columns.

    Order 1 reads per-document word counts, order 2 blocks of token arrays, each written once by the pass that tokenises. Corpus
    counts are written once."""
    keep = keep or []
    if order == 1:
        scores = unigram_scores(doc_words(doc_tokens(docs, key, text), key), key)
    else:
        scores = bigram_scores(doc_tokens(docs, key, text), key)
    return docs.select(key, *keep).join(perplexity_of(scores, key), key, "left")


def token_logprobs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A (doc, pos, token, logprob) table: each token occurrence scored by the corpus unigram model
    (the table form a per-token scorer would emit)."""
    tok = doc_tokens(docs, key, text)
    words = _tokens_long(tok, key, "tk", "w").select("w", F.lit(1).cast("bigint").alias("n"))
    uni = unigram_model(materialize(word_counts(words), "ppl-counts"))
    occ = tok.select(key, F.posexplode_outer("tk").alias("pos", "w")).where(F.col("w").isNotNull())
    return hot_split_join(occ, uni.select("w", "c", "lp"), ["w"], "c").select(
        key, "pos", F.col("w").alias("token"), F.col("lp").alias("logprob"))


def logprob_perplexity(docs: DataFrame, logprobs: DataFrame, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """R-2: exp(-avg(logprob)) per doc, left-joined back so unscored docs stay null."""
    keep = keep or []
    ppl = logprobs.groupBy(key).agg(F.exp(-F.avg("logprob")).alias("Perplexity"))
    return docs.select(key, *keep).join(ppl, key, "left")
