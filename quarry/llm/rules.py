r"""Quality rules as a short-circuit cascade.

Every rule has a cost and a rejection rate, both measured on a bounded sample inside Spark tasks; rules
then run in the order of rejections per second, and a document that one rule rejects is not looked at by the
next. The order changes the work and the ``rejected_by`` label, never the verdict: a document is kept if no
rule rejects it.

Words are ``[^\x20\x09-\x0D]+``. Defined cases: null text has no words and fails the word count; repeated rows
are judged alike; an empty table gives no rows and keeps the given rule order; other columns are kept by
``cascade`` (its own columns take names that the caller chooses).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import with_fields
from quarry.llm.tokens import by_bytes
from quarry.llm.words import NOT_SPACE, shingles, words_of

#: Characters that count as symbols, and the ASCII white space. Fixed values.
SYMBOLS = b"#*$%&|<>"
ASCII_SPACE = " \t\n\x0b\x0c\r"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


class Batch:
    """Texts of a few documents and the metrics asked for so far, each computed once per document."""

    def __init__(self, texts: list[str | None]) -> None:
        self.texts = texts
        self.values: dict[str, np.ndarray] = {}
        self.done: dict[str, np.ndarray] = {}

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        if name not in self.values:
            self.values[name] = np.zeros(len(self.texts), np.int64)
            self.done[name] = np.zeros(len(self.texts), bool)
        need = rows[~self.done[name][rows]]
        if len(need):
            made, values = METRICS[name]
            for k, v in zip(made, values([self.texts[i] for i in need]), strict=True):
                self.values.setdefault(k, np.zeros(len(self.texts), np.int64))
                self.done.setdefault(k, np.zeros(len(self.texts), bool))
                self.values[k][need], self.done[k][need] = v, True
        return self.values[name][rows]


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    body = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"\n".join(body) + b"\n", np.uint8), np.cumsum([0, *(len(b) + 1 for b in body)])


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _counts(texts):
    data, at = _joined(texts)
    inside = NOT_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    return _per_text(begins, at), _per_text(inside & _LEAD[data], at)


def _symbols(texts):
    data, at = _joined(texts)
    return (_per_text(_SYMBOL[data], at),)


def _lines(texts):
    n, dup = [], []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if x.strip(ASCII_SPACE)]
        n.append(len(lines))
        dup.append(len(lines) - len(set(lines)))
    return n, dup


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more in the text, the first one included."""
    windows = shingles(hashes, 3)
    if len(windows) < 2:
        return 0
    _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.concatenate([times[back] > 1, [False, False]])
    covered = again.copy()
    covered[1:] |= again[:-1]
    covered[2:] |= again[:-2]
    return int(covered.sum())


def _repeats(texts):
    w = words_of(texts)
    return ([repeated_words(w.of(i)) for i in range(len(texts))],)


METRICS: dict[str, tuple[tuple[str, ...], Callable]] = {}
for _names, _fn in ((("n_words", "word_chars"), _counts), (("n_symbols",), _symbols),
                    (("n_lines", "n_dup_lines"), _lines), (("n_repeat_words",), _repeats)):
    for _n in _names:
        METRICS[_n] = (_names, _fn)


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]
    base: bool = False


RULES: tuple[Rule, ...] = (
    Rule("few_words", ("n_words",), lambda n: n < 50, True),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n, True),
    Rule("many_words", ("n_words",), lambda n: n > 200_000),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 14 * n)),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 100 * s > 20 * n),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda d, n: 100 * d > 30 * n),
)


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id",
            sample_rows: int = 1000) -> list[tuple[str, float, float]]:
    """(rule, seconds, rejections) of every rule on a sample of at most ``sample_rows`` documents."""
    drawn = docs.select(F.xxhash64(key, text).alias("_h"), F.col(text).alias("_text")).orderBy("_h").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in by_bytes(texts):
                for r in rules:  # each alone: what it costs when it comes first
                    began, b, rows = time.perf_counter(), Batch(texts[lo:hi]), np.arange(hi - lo)
                    bad = int(r.rejects(*(b.get(m, rows) for m in r.needs)).sum())
                    yield pa.RecordBatch.from_pydict({"rule": [r.name], "seconds": [time.perf_counter() - began],
                                                      "rejected": [float(bad)]})

    got = drawn.select("_text").mapInArrow(run, "rule string, seconds double, rejected double")
    return [tuple(r) for r in got.groupBy("rule").agg(F.sum("seconds"), F.sum("rejected")).collect()]


def cheapest_order(measured: list[tuple[str, float, float]], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Rules by rejections per second, most first; rules that nothing is known of come last, as given."""
    worth = {name: rejected / max(seconds, 1e-9) for name, seconds, rejected in measured}
    return sorted(rules, key=lambda r: -worth.get(r.name, -1.0))


def run_cascade(texts: list[str | None], order: Sequence[Rule]) -> tuple[Batch, np.ndarray]:
    """The batch and, per text, the index in ``order`` of the rule that rejects it (-1: kept)."""
    b, verdict, alive = Batch(texts), np.full(len(texts), -1), np.arange(len(texts))
    for k, r in enumerate(order):
        if not len(alive):
            break
        bad = r.rejects(*(b.get(m, alive) for m in r.needs))
        verdict[alive[bad]] = k
        alive = alive[~bad]
    return b, verdict


def cascade(docs: DataFrame, order: Sequence[Rule], text: str = "text", rejected_by: str = "rejected_by",
            metrics: Sequence[str] = ()) -> DataFrame:
    """All columns of ``docs`` and ``rejected_by`` (null: kept). ``metrics`` are computed for every document
    after the verdict, for reports that want them; without them only what the cascade needs is computed."""
    at = docs.columns.index(text)
    schema = with_fields(docs, **dict.fromkeys(metrics, "long"), **{rejected_by: "string"})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, names = batch.column(at).to_pylist(), {m: [] for m in metrics}, []
            for lo, hi in by_bytes(texts):
                b, verdict = run_cascade(texts[lo:hi], order)
                names += [None if v < 0 else order[v].name for v in verdict]
                for m in metrics:
                    out[m].append(b.get(m, np.arange(hi - lo)))
            more = [pa.array(np.concatenate(out[m]) if out[m] else [], pa.int64()) for m in metrics]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(names, pa.string())], schema.names)

    return docs.mapInArrow(judge, schema)
