r"""Token ids of whole texts with the ``tokenizers`` library, at the cost of the distinct words.

The tokenizers used here split a text at white space before any merge, so a text's ids are the ids of its
units in order, where a unit is a run of white space with the word after it (byte-level) or the word alone
(word-level, which drops white space). Cutting before ``.,;:!?`` after Latin letters is safe for the same reason: letters
and punctuation never share a piece (the letter whose lower case ends in a combining mark is left out). Each worker keeps the ids of
units it has met; new ones of a batch are encoded together, joined by a mark that cannot occur in them and has an id of its
own. Texts that hold a special token's string, and tokenizers of another make, go to the library as they are. Results
equal ``encode(text, add_special_tokens=False)`` (tests/llm/test_tokens_and_files.py).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# White space as the tokenizers' regular expressions see it, and Latin letters. Fixed values.
SPACE = "\t-\r \x85\xa0  -     　"
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"

MAX_CACHED = 800_000     # units a worker keeps (about 200 bytes each)
LONG_TEXT = 1_000_000    # characters above which a text is cut into units piecemeal
JOINED = 200             # new units encoded in one call

_BYTE_UNITS = re.compile(f"[{SPACE}]*+(?:[{LETTERS}]++(?=[.,;:!?])|[^{SPACE}]++)|[{SPACE}]+")
_WORD_UNITS = re.compile(f"[{LETTERS}]++(?=[.,;:!?])|[^{SPACE}]++")
# A unit that cannot stand between marks: white space other than one blank before its word, or no word.
_ODD_UNIT = re.compile(f"(?! )[{SPACE}]| (?:[{SPACE}]|\\Z)")


class UnitEncoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special), re.I) if special else None
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65_536 else "<u4")
        spec = json.loads(self.tok.to_str())
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        self.units = self.mark = None
        if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.units, self.mark = _BYTE_UNITS, "\n"
        elif [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and \
                [(p.get("type"), p.get("behavior")) for p in pre.get("pretokenizers", [])][:1] == [("Split", "Removed")]:
            self.units, self.mark = _WORD_UNITS, " \x01 "
        if self.units:
            marks = self.tok.encode(self.mark, add_special_tokens=False).ids
            self.mark_id = marks[0] if len(marks) == 1 else None
            if self.mark_id is None:
                self.units = None
        self.known: dict[str, bytes] = {}

    def _raw(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _evict(self) -> None:
        """Empty a full cache. Only before units are looked up, never between that and their use."""
        if len(self.known) > MAX_CACHED:
            self.known.clear()

    def _learn(self, new: Iterable[str]) -> None:
        plain, odd, width = [], [], self.dtype.itemsize
        for u in new:
            (odd if _ODD_UNIT.match(u) or "\x01" in u else plain).append(u)
        groups = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        for k in range(0, len(groups), 50):
            joined = [self.mark.join(g) for g in groups[k:k + 50]]
            for some, e in zip(groups[k:k + 50], self.tok.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.asarray(e.ids, dtype=self.dtype)
                cuts = np.flatnonzero(ids == self.mark_id)
                if len(cuts) != len(some) - 1:  # the mark's id came up inside a unit
                    odd.extend(some)
                    continue
                raw, at = ids.tobytes(), 0
                for u, end in zip(some, [*cuts.tolist(), len(ids)], strict=True):
                    self.known[u] = raw[width * at:width * end]
                    at = end + 1
        for i in range(0, len(odd), JOINED):
            some = odd[i:i + JOINED]
            for u, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[u] = self._raw(e.ids)

    def _long(self, text: str) -> bytes:
        found, parts = (m.group() for m in self.units.finditer(text)), []
        while some := list(islice(found, 100_000)):
            self._evict()
            self._learn(set(some).difference(self.known))
            parts.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(parts)

    def _whole(self, text: str) -> bytes:
        return self._raw(self.tok.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: empty) as little-endian bytes of ``dtype``."""
        texts = [t or "" for t in texts]
        if not self.units:
            return [self._whole(t) for t in texts]
        self._evict()
        plain = [not (self.special and self.special.search(t)) for t in texts]
        cut = [self.units.findall(t) if ok and len(t) <= LONG_TEXT else None for t, ok in zip(texts, plain, strict=True)]
        self._learn(set().union(*(u for u in cut if u)).difference(self.known))
        short = [None if u is None else b"".join(map(self.known.__getitem__, u)) for u in cut]
        return [(self._long(t) if ok else self._whole(t)) if raw is None else raw
                for t, ok, raw in zip(texts, plain, short, strict=True)]


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder per tokenizer file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def by_bytes(texts: list[str | None], most_rows: int = 256, most_chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row spans of a batch with few enough characters to work on at once (one long text alone)."""
    lo = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and (i - lo >= most_rows or held + n > most_chars):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(texts):
        yield lo, len(texts)


def crc32_u32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids written as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
