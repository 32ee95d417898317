import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing, tokens
from quarry.llm.token_files import read_token_files, token_folder, write_token_files

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def whole(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def noise(seed, n):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "\n\n", "\t", "\xa0", "é", "é", "É", "don't", "'s", ",", "...", "12", "½", "<|endoftext|>",
             "\x01", "\x1c", "中文", "𝄞", "İ", "Σ", "ﬁ", "!?", " ", "a", "Zq", "\x85", "-", "ß"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_units_give_the_ids_of_the_whole_text(name, duck):
    enc, ids = tokens.UnitEncoder(public_tokenizers.path(name)), whole(name)
    texts = noise(1, 1500) + [r[0] for r in duck.execute("SELECT text FROM documents LIMIT 60").fetchall()] + [None, ""]
    for raw, t in zip(enc.encode(texts), texts, strict=True):
        assert np.frombuffer(raw, enc.dtype).tolist() == ids(t), repr(t)


@pytest.mark.parametrize("name", FILES)
def test_every_letter_before_every_mark(name):
    enc, ids = tokens.UnitEncoder(public_tokenizers.path(name)), whole(name)
    letters = [chr(c) for c in range(0x250) if re.fullmatch(f"[{tokens.LETTERS}]", chr(c))] + ["İ", "ŉ", "ǰ", "ẞ"]
    texts = [f"a{x}{m}{y}" for x in letters for m in ".,;:!?" for y in ("", " b")]
    for raw, t in zip(enc.encode(texts), texts, strict=True):
        assert np.frombuffer(raw, enc.dtype).tolist() == ids(t), repr(t)


@pytest.mark.parametrize("name", FILES)
def test_special_strings_are_as_the_plain_call_has_them(name):
    enc, ids = tokens.UnitEncoder(public_tokenizers.path(name)), whole(name)
    texts = ["a <|endoftext|> b", "x<|endoftext|>", "<|EndOfText|>, y", "<|startoftext|>", "<|endoftext", "plain"]
    for raw, t in zip(enc.encode(texts), texts, strict=True):
        assert np.frombuffer(raw, enc.dtype).tolist() == ids(t), repr(t)


def test_small_cache_and_long_text_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CACHED", 5)
    monkeypatch.setattr(tokens, "LONG_TEXT", 50)
    enc, ids = tokens.UnitEncoder(public_tokenizers.path(FILES[0])), whole(FILES[0])
    for t in noise(2, 200):
        assert np.frombuffer(enc.encode([t])[0], enc.dtype).tolist() == ids(t)


def test_best_fit_respects_every_capacity():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 3000)
    for score in ("norm", "dot"):
        for docs, cost in ((100, 10_000), (4, 10_000), (100, 5_000)):
            lens = np.minimum(lengths, int(cost ** 0.5))
            bins, offsets = packing.best_fit(lens, 100, docs, cost, score=score)
            for b in np.unique(bins):
                at = np.flatnonzero(bins == b)
                order = at[np.argsort(offsets[at])]
                assert lens[at].sum() <= 100 and len(at) <= docs and (lens[at] ** 2).sum() <= cost
                assert offsets[order].tolist() == (np.cumsum(lens[order]) - lens[order]).tolist()


def plain_scan(lengths, caps, weights, score):
    """Best fit by looking at every open bin for every piece, longest first."""
    bins, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = (int(lengths[i]), 1, int(lengths[i]) ** 2)
        best = None
        for b, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, need, strict=True)):
                w = [x / (c * float(c)) for x, c in zip(weights, caps, strict=True)]
                value = sum(f * (x - y) ** 2.0 for f, x, y in zip(w, left, need, strict=True)) if score == "norm" else \
                    sum(f * y * x for f, x, y in zip(w, left, need, strict=True))
                if best is None or value < best[0]:
                    best = (value, b)
        if best is None:
            bins.append(list(caps))
            best = (0, len(bins) - 1)
        bins[best[1]] = [x - y for x, y in zip(bins[best[1]], need, strict=True)]
        out[i] = best[1]
    return len(bins), bins


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 100, 10_000), (100, 4, 10_000), (100, 100, 4_000)])
def test_best_fit_equals_a_plain_scan(score, caps):
    lengths = np.random.default_rng(5).integers(1, 60, 400)
    bins, _ = packing.best_fit(lengths, *caps, score=score)
    many, left = plain_scan(lengths, caps, (1.0, 0.01, 0.01), score)
    assert bins.max() + 1 == many
    used = [(int(lengths[bins == b].sum()), int((bins == b).sum())) for b in range(many)]
    assert sorted(used) == sorted((caps[0] - x[0], caps[1] - x[1]) for x in left)


def test_pack_odd_rows(spark, odd_docs):
    path = public_tokenizers.path(FILES[1])
    ids = whole(FILES[1])
    got = packing.pack(odd_docs, path, max_tokens=64).toPandas()
    n = sum(len(ids(r.text)) + 1 for r in odd_docs.collect())
    assert got.length.sum() == n and got.length.max() <= 64
    ends = got.sort_values(["sequence_id", "offset"])
    before = ends.groupby("sequence_id").length.cumsum() - ends.length
    assert (before == ends.offset).all()
    first = got[(got.doc_id == 6) & (got.piece == 1)].iloc[0]
    text = odd_docs.filter("doc_id = 6").first().text
    assert first.ids_crc32 == zlib.crc32(np.asarray((ids(text) + [0])[64:128], "<u4").tobytes())
    assert packing.pack(odd_docs.limit(0), path, max_tokens=64).count() == 0


def test_token_files_round_trip(spark, odd_docs):
    ids = whole(FILES[0])
    folder = token_folder(spark)
    got = read_token_files(write_token_files(odd_docs, folder, public_tokenizers.path(FILES[0])), folder).orderBy("start").collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [g.doc_id for g in got] == [r.doc_id for r in rows]
    want = sorted((r.doc_id or -1, zlib.crc32(np.asarray(ids(r.text) + [0], "<u4").tobytes())) for r in rows)
    assert sorted((g.doc_id or -1, g.ids_crc32) for g in got) == want
    at = 0
    for g in got:
        assert g.start == at
        at += g.n_tokens
    empty = token_folder(spark)
    assert read_token_files(write_token_files(odd_docs.limit(0), empty, public_tokenizers.path(FILES[0])), empty).count() == 0
