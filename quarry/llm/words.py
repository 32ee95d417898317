"""Vectorised word and shingle hashes of a batch of texts (numpy, bounded by the batch).

A batch becomes one byte buffer. Each word gets a 64-bit multilinear hash: the sum over its bytes of
(byte + 1) times an odd number that depends on the byte's place, then mixed with the length. Two different
words share a hash with a chance of about 2**-56, so hashes stand for words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_PLACES = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mixing of 64-bit values."""
    x = np.array(x, dtype=U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _place(at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((at.astype(U64) + U64(1)) * U64(_GOLD)) | U64(1)


_TABLE = _place(np.arange(_PLACES))

# Byte classes: the six ASCII white-space characters end a word in the contracts' sense; the other class
# keeps letters and digits only (every byte above ASCII counts as a letter). Fixed values.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


@dataclass
class Words:
    """Words of a batch in order: hashes, byte spans, and for each text the span [first[i], first[i+1])."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    text_at: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i]:self.first[i + 1]]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each non-empty byte span."""
    size = end - start
    if not len(size):
        return np.empty(0, U64)
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    source = place + np.repeat(start, size)
    factor = _TABLE[place] if int(size.max()) <= _PLACES else _place(place)
    with np.errstate(over="ignore"):
        value = (data[source].astype(U64) + U64(1)) * factor
        return mix(np.add.reduceat(value, at) + size.astype(U64) * U64(_GOLD))


def words_of(texts: list[str | None], kind: np.ndarray = NOT_SPACE, lower: bool = False, fold: bool = False) -> Words:
    """Words of each text (null: none). ``lower`` folds A-Z only, ``fold`` all letters."""
    raw = [(t or "") for t in texts]
    body = [(t.lower() if fold else t).encode("utf-8", "surrogatepass") for t in raw]
    if lower:
        body = [b.lower() for b in body]
    data = np.frombuffer(b"\n".join(body) + b"\n", np.uint8)
    size = np.fromiter((len(b) for b in body), np.int64, len(body))
    text_at = np.concatenate([[0], np.cumsum(size + 1)])
    inside = kind[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    return Words(hash_spans(data, start, end), start, end, np.searchsorted(start, text_at), data, text_at)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words of one text, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        out = np.full(n, U64(_GOLD), U64)
        for k in range(width):
            out = mix(out * U64(0x2545F4914F6CDD1D) + hashes[k:k + n])
    return out


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; with fewer words the whole sequence is one; without words none."""
    if 0 < len(hashes) < width:
        return shingles(hashes, len(hashes))[:1] ^ U64(len(hashes))
    return np.unique(shingles(hashes, width))
