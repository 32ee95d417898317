"""Language-model scores of texts: a unigram model over subword pieces, summed over every segmentation.

The pieces and their first scores come from an existing sentencepiece file; no tokenizer is trained. Where the file's scores are
merge ranks (whole numbers, as in a BPE file) they become Zipf weights 1 / (rank + 2.7); log-probabilities are taken as
they are. A text is its words (lower-cased A-Z), each a space mark and its UTF-8 bytes, then one end symbol. Pieces never cross words,
and every byte that a word can hold is a piece, so every word has a segmentation.

1. Words are counted over the whole corpus (per task first, then by word): all occurrences and those in training texts.
2. Piece probabilities are fitted to the training words by expectation maximisation: forward and backward recursion in log
   space give each piece's expected count, added to ``PRIOR`` pseudo-counts spread by the file's scores. Words of more than
   ``LONG`` bytes are learnt from in stretches of that length (scored whole).
3. A word's probability is the sum over its segmentations (forward recursion), computed once per distinct word.
4. A text's log-probability is the sum over its words and the end. Words that occur most (at most ``HOT``, a bound on what is
   broadcast) are looked up in the task; the others are joined by word, one row per text and distinct word.

Words are told apart by 64-bit hashes when joined. Everything the fit and the counts gather covers all rows.

Defined cases: null or empty text is the end symbol alone; a null id is kept; repeated rows are scored and counted each; without
training texts the counts are zero and the pieces keep the file's scores; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize
from quarry.llm.tokens import by_bytes
from quarry.llm.words import U64, words_of

MARK = 0x20            # stands for the space mark; no word holds a space
HOT = 65_536
LONG = 64
PRIOR = 10_000.0
ROUNDS = 2
SMOOTH = 0.1
_STEP = U64(0x9E3779B97F4A7C15)
_SPREAD = U64(0xD6E8FEB86659FD93)
_CHUNK = 3_000_000     # characters tokenized at once
_WORDS = 40_000        # words of one lattice batch
_CELLS = 4_000_000     # bytes times words of one lattice block


@dataclass
class Pieces:
    """Byte strings with natural-log probabilities; the last one, empty, is the end symbol."""

    text: list[bytes]
    logp: np.ndarray

    def __post_init__(self) -> None:
        key = np.array([_key(t) for t in self.text[:-1]], U64)
        self._order = np.argsort(key)
        self._keys = key[self._order]
        self._some = np.zeros(1 << 20, bool)
        self._some[_slot(self._keys)] = True
        self.longest = max(map(len, self.text))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``key``, piece numbers) of the keys that are pieces."""
        at = np.flatnonzero(self._some[_slot(key)])
        pos = np.minimum(np.searchsorted(self._keys, key[at]), len(self._keys) - 1)
        ok = self._keys[pos] == key[at]
        return at[ok], self._order[pos[ok]]

    def with_logp(self, logp: np.ndarray) -> Pieces:
        return Pieces(self.text, logp)


def _key(text: bytes) -> int:
    h = 1
    for b in text:
        h = (h * int(_STEP) + b + 1) % 2 ** 64
    return h


def _slot(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key * _SPREAD) >> U64(44)


def load_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece file that can occur in lower-cased words, with weights from its scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        text = sp.id_to_piece(i)
        body = text[1:] if text.startswith("▁") else text
        raw = (b" " if text != body else b"") + body.encode()
        if "▁" in body or any(c in b" \t\n\v\f\r" or 65 <= c <= 90 for c in body.encode()):
            continue
        score[raw] = max(score.get(raw, -math.inf), sp.get_score(i))
    if all(float(s).is_integer() for s in score.values()):
        score = {t: -math.log(2.7 - s) for t, s in score.items()}
    low = min(score.values(), default=0.0)
    for b in {*range(256)} - {*range(9, 14), *range(65, 91)}:
        score.setdefault(bytes([b]), low)
    text = [*sorted(score), b""]
    logp = np.array([*(score[t] for t in text[:-1]), max(score.values())])
    return Pieces(text, logp - np.logaddexp.reduce(logp))


def _edges(block: np.ndarray, pieces: Pieces) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, piece) of every piece in a block of words of one length, by start."""
    rows, length = block.shape
    up = block.astype(U64) + U64(1)
    out = []
    with np.errstate(over="ignore"):
        for i in range(length):
            key = np.ones(rows, U64)
            for j in range(i, min(length, i + pieces.longest)):
                key = key * _STEP + up[:, j]
                at, piece = pieces.find(key)
                if len(at):
                    out.append((i, j + 1, at, piece))
    return out


def _forward(edges, rows: int, length: int, logp: np.ndarray) -> np.ndarray:
    f = np.full((length + 1, rows), -np.inf)
    f[0] = 0.0
    for i, j, at, piece in edges:
        f[j, at] = np.logaddexp(f[j, at], f[i, at] + logp[piece])
    return f


def _expected(edges, f: np.ndarray, weight: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected piece counts of a block, its words weighted."""
    g = np.full_like(f, -np.inf)
    g[-1] = 0.0
    for i, j, at, piece in reversed(edges):
        g[i, at] = np.logaddexp(g[i, at], g[j, at] + pieces.logp[piece])
    who = np.concatenate([piece for *_, piece in edges])
    share = np.concatenate([weight[at] * np.exp(f[i, at] + pieces.logp[piece] + g[j, at] - f[-1, at]) for i, j, at, piece in edges])
    return np.bincount(who, share, len(pieces.text))


def _long(word: bytes, pieces: Pieces) -> float:
    """Forward recursion over one long word, stretch by stretch; the sum of all segmentations of the whole word."""
    ways, last = {0: 0.0}, len(word)
    raw = np.frombuffer(word, np.uint8).astype(U64) + U64(1)
    for lo in range(0, last, 65_536):
        hi = min(lo + 65_536, last)
        found: list[list[tuple[int, float]]] = [[] for _ in range(hi - lo)]
        key = np.ones(hi - lo, U64)
        with np.errstate(over="ignore"):
            for size in range(1, pieces.longest + 1):
                n = min(hi, last - size + 1) - lo
                if n <= 0:
                    break
                key = key[:n] * _STEP + raw[lo + size - 1:lo + size - 1 + n]
                at, piece = pieces.find(key)
                for a, s in zip(at.tolist(), pieces.logp[piece].tolist(), strict=True):
                    found[a].append((size, s))
        for i, here in enumerate(found, lo):
            f = ways.pop(i)
            for size, s in here:
                old, new = ways.get(i + size), f + s
                if old is None:
                    ways[i + size] = new
                else:
                    top = max(old, new)
                    ways[i + size] = top + math.log1p(math.exp(min(old, new) - top))
    return ways[last]


def _blocks(words: list[bytes], most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, block) of equally long words with the space mark before each; longer ones than ``most`` are left out."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    first = np.cumsum(size) - size
    for length in np.unique(size).tolist():
        if most is not None and length > most:
            break
        places = np.flatnonzero(size == length)
        for k in range(0, len(places), max(1, _CELLS // ((length + 1) * 16))):
            at = places[k:k + max(1, _CELLS // ((length + 1) * 16))]
            block = np.full((len(at), length + 1), MARK, np.uint8)
            block[:, 1:] = data[first[at][:, None] + np.arange(length)]
            yield at, block


def word_logp(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural-log probability of each word, over all its segmentations."""
    out = np.zeros(len(words))
    for at, block in _blocks(words, LONG):
        out[at] = _forward(_edges(block, pieces), *block.shape, pieces.logp)[-1]
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = _long(b" " + w, pieces)
    return out


def piece_counts(words: list[bytes], weight: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected count of each piece in weighted words."""
    out = np.zeros(len(pieces.text))
    whole = [w for w in words if len(w) <= LONG]
    short = np.array([len(w) <= LONG for w in words], bool)
    for at, block in _blocks(whole, None):
        edges = _edges(block, pieces)
        out += _expected(edges, _forward(edges, *block.shape, pieces.logp), weight[short][at], pieces)
    for w, c in zip(words, weight, strict=True):
        if len(w) > LONG:
            marked = b" " + w
            for k in range(0, len(marked), LONG):
                block = np.frombuffer(marked[k:k + LONG], np.uint8)[None, :]
                edges = _edges(block, pieces)
                out += _expected(edges, _forward(edges, *block.shape, pieces.logp), np.array([c]), pieces)
    return out


def count_words(docs: DataFrame, train: Column, text: str = "text") -> DataFrame:
    """(h, word, n, c): every distinct word of the corpus, its occurrences and those in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, learnt = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in by_bytes(texts, 1 << 20, _CHUNK):
                w = words_of(texts[lo:hi], lower=True)
                if not len(w.hashes):
                    continue
                h, one, which = np.unique(w.hashes, return_index=True, return_inverse=True)
                c = np.bincount(which, np.repeat(learnt[lo:hi], np.diff(w.first)), len(h))
                size = w.end[one] - w.start[one]
                at = np.cumsum(size) - size
                body = w.data[np.arange(int(size.sum())) - np.repeat(at - w.start[one], size)]
                word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(h), [
                    None, pa.py_buffer(np.append(at, size.sum()).astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), word, pa.array(np.bincount(which, minlength=len(h))),
                                                  pa.array(c.astype(np.int64))], ["h", "word", "n", "c"])

    rows = docs.select(F.col(text).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    return rows.mapInArrow(run, "h long, word binary, n long, c long").groupBy("h", "word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about _WORDS rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _WORDS or sum(b.nbytes for b in held) >= 32_000_000:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def fit(words: DataFrame, texts: int, start: Pieces, rounds: int = ROUNDS, prior: float = PRIOR) -> Pieces:
    """Pieces with probabilities fitted to the words' training counts and ``texts`` end symbols. What reaches the driver is one number
    per piece and round."""
    pieces = start
    base = prior * np.exp(start.logp)
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], now: Pieces = pieces) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now.text))
            for some in _many(batches):
                total += piece_counts(some.column("word").to_pylist(), some.column("c").to_numpy().astype(float), now)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

        got = words.filter("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        count = base.copy()
        for r in got.collect():
            count[r["piece"]] += r["n"]
        count[-1] += texts
        pieces = pieces.with_logp(np.log(count / count.sum()))
    return pieces


def score_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(h, n, c, logp): each word with its log-probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _many(batches):
            logp = word_logp(some.column("word").to_pylist(), pieces)
            for b in some.select(["h", "n", "c"]).append_column("logp", pa.array(logp)).combine_chunks().to_batches():
                yield b

    return words.select("h", "word", "n", "c").mapInArrow(run, "h long, n long, c long, logp double")


def _most_frequent(scored: DataFrame, most: int) -> int | None:
    """The count from which on there are at most ``most`` words: from a histogram of counts by eighths of powers of two."""
    bucket = F.floor(8 * F.log2("n")).cast("int")
    rows = sorted(scored.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("low")).collect(), reverse=True)
    total, low = 0, None
    for r in rows:
        total += r["words"]
        if total > most:
            break
        low = r["low"]
    return low


@dataclass
class Scored:
    """``texts`` has the kept columns with n_tokens, n_known, base_score and score (log10); the model's parts are at hand."""

    texts: DataFrame
    words: DataFrame
    pieces: Pieces
    train_tokens: int


def score_texts(docs: DataFrame, train: Column, vocabulary: str, keep: Column, text: str = "text", hot: int = HOT, rounds: int = ROUNDS) -> Scored:
    """Learn from the rows where ``train`` holds and score every row. ``keep`` (a column or struct) is carried along as ``kept``."""
    train = F.coalesce(train, F.lit(False))
    words = materialize(count_words(docs, train, text), "lm-words")
    n_texts = docs.filter(train).count()
    sums = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    total = (sums[0] or 0) + n_texts
    distinct = sums[1] + (n_texts > 0)
    below = math.log10(total + SMOOTH * (distinct + 1))
    pieces = fit(words, n_texts, load_pieces(vocabulary), rounds)
    scored = materialize(score_words(words, pieces), "lm-word-scores")
    low = _most_frequent(scored, hot)
    common = [] if low is None else scored.filter(F.col("n") >= low).select("h", "c", "logp").toPandas()
    h = np.asarray(common["h"] if low is not None else [], np.int64).view(U64)
    order = np.argsort(h)
    h, c = h[order], np.asarray(common["c"] if low is not None else [], np.int64)[order]
    logp = np.asarray(common["logp"] if low is not None else [], float)[order] / math.log(10)
    base = np.log10(c + SMOOTH) - below
    end_base, end_score = math.log10(n_texts + SMOOTH) - below, float(pieces.logp[-1]) / math.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in by_bytes(texts, 1 << 20, _CHUNK):
                w = words_of(texts[lo:hi], lower=True)
                rows, of = hi - lo, np.repeat(np.arange(hi - lo), np.diff(w.first))
                pos = np.minimum(np.searchsorted(h, w.hashes), max(len(h) - 1, 0))
                is_hot = h[pos] == w.hashes if len(h) else np.zeros(len(of), bool)
                add = lambda x, of=of, is_hot=is_hot, rows=rows: np.bincount(of[is_hot], x, rows)
                at = pos[is_hot]
                known = add((c[at] > 0).astype(float) if len(h) else None) + (n_texts > 0)
                ids = pa.array(np.arange(row, row + rows))
                none = lambda n, kind: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([
                    ids, batch.column(1).slice(lo, rows), none(rows, pa.int64()), pa.array(np.diff(w.first) + 1),
                    pa.array(known.astype(np.int64)), pa.array(add(base[at] if len(h) else None) + end_base),
                    pa.array(add(logp[at] if len(h) else None) + end_score)], names)
                pair = np.stack([of[~is_hot].astype(U64), w.hashes[~is_hot]])
                sort = np.lexsort((pair[1], pair[0]))
                pair = pair[:, sort]
                new = np.flatnonzero(np.append(True, (np.diff(pair[0]) != 0) | (np.diff(pair[1]) != 0))[:pair.shape[1]])
                tf = np.diff(np.append(new, pair.shape[1]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + pair[0][new].astype(np.int64)), none(len(new), batch.schema.field(1).type),
                    pa.array(pair[1][new].view(np.int64)), pa.array(tf), none(len(new), pa.int64()),
                    none(len(new), pa.float64()), none(len(new), pa.float64())], names)
                row += rows

    told = docs.select(F.col(text).alias("_text"), keep.alias("kept"))
    names = ["row", "kept", "h", "n", "known", "base", "score"]
    kind = told.schema["kept"].dataType.simpleString()
    made = materialize(told.mapInArrow(run, f"row long, kept {kind}, h long, n long, known long, base double, score double"), "lm-texts")
    tail = made.filter("h IS NOT NULL").select("row", "h", "n").join(scored.select("h", "c", "logp"), "h").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known2"),
        F.sum(F.col("n") * (F.log10(F.col("c") + F.lit(SMOOTH)) - below)).alias("base2"),
        F.sum(F.col("n") * F.col("logp") / math.log(10)).alias("score2"))
    both = made.filter("h IS NULL").select("row", "kept", F.col("n").alias("n_tokens"), "known", "base", "score").join(tail, "row", "left")
    plus = lambda a: F.col(a) + F.coalesce(F.col(f"{a}2"), F.lit(0))
    out = both.select("kept", "n_tokens", plus("known").cast("long").alias("n_known"), plus("base").cast("double").alias("base_score"),
                      plus("score").cast("double").alias("score"))
    return Scored(out, words, pieces, total)
