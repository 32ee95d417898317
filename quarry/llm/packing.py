"""Best-fit packing of documents into fixed-length training sequences.

Documents are tokenized whole, an end id is appended, and only those longer than a sequence are cut. A piece
demands a vector (tokens, 1 document, tokens squared for attention) and a sequence has residual
capacities of the same three kinds. Pieces are taken longest first; each goes to the open sequence that stays
feasible in every dimension and scores least: the weighted norm of what would be left (``norm``) or
the weighted dot product of demand and residual (``dot``). Open sequences with equal residuals are one state, so a choice
looks at distinct states only.

Pieces that fill a sequence by themselves are closed at once. The others are dealt by a hash of their row
number to groups of about ``GROUP_ROWS`` rows, each packed in one task: a group's size is fixed by design and does
not follow any key. A group leaves a few part-filled sequences, against tens of thousands of full ones.

Defined cases: null or empty text is one piece that holds the end id alone; repeated rows and equal ids are
packed once per row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, row_key
from quarry.llm.tokens import by_bytes, crc32_u32, encoder

GROUP_ROWS = 65_536


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_cost: int,
             weights: tuple[float, float, float] = (1.0, 0.01, 0.01), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin number and token offset of each piece. Every piece must fit an empty bin."""
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    cap = (max_tokens, max_docs, max_cost)
    w = [x / (c * float(c)) for x, c in zip(weights, cap, strict=True)]
    room = 1024
    left = np.full((3, room), -1, np.int64)      # residuals of each distinct state; -1: no bin has it
    slot_of: dict[tuple[int, int, int], int] = {}
    holders: list[list[int]] = []
    free: list[int] = []
    n_bins = 0
    smallest = int(lengths.min()) if n else 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        cost = size * size
        top = len(holders)
        t, d, c = left[0, :top], left[1, :top], left[2, :top]
        ok = np.flatnonzero((t >= size) & (d >= 1) & (c >= cost))
        if len(ok):
            t, d, c = t[ok], d[ok], c[ok]
            if score == "norm":
                value = w[0] * (t - size) ** 2.0 + w[1] * (d - 1) ** 2.0 + w[2] * (c - cost) ** 2.0
            else:
                value = w[0] * size * t + w[1] * d + w[2] * float(cost) * c
            slot = int(ok[value.argmin()])
            b = holders[slot].pop()
            state = tuple(left[:, slot].tolist())
            if not holders[slot]:
                left[:, slot] = -1
                del slot_of[state]
                free.append(slot)
        else:
            b, state = n_bins, cap
            n_bins += 1
        bins[i], offsets[i] = b, max_tokens - state[0]
        state = (state[0] - size, state[1] - 1, state[2] - cost)
        if state[0] < smallest or state[1] < 1 or state[2] < smallest * smallest:
            continue
        if state not in slot_of:
            if free:
                slot = free.pop()
            else:
                slot = len(holders)
                holders.append([])
                if slot == left.shape[1]:
                    left = np.concatenate([left, np.full_like(left, -1)], axis=1)
            slot_of[state] = slot
            left[:, slot] = state
        holders[slot_of[state]].append(b)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, max_piece: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize and cut: key, piece, start, length, ids_crc32."""
    kept = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = kept.schema["_key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.asarray([end_id], enc.dtype).tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows, piece, start, length, crc = [], [], [], [], []
            for lo, hi in by_bytes(texts):
                for k, raw in enumerate(enc.encode(texts[lo:hi]), lo):
                    ids = np.frombuffer(raw + end, enc.dtype)
                    for p, at in enumerate(range(0, len(ids), max_piece)):
                        some = ids[at:at + max_piece]
                        rows.append(k)
                        piece.append(p)
                        start.append(at)
                        length.append(len(some))
                        crc.append(crc32_u32(some))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["_key", "piece", "start", "length", "ids_crc32"])

    return kept.mapInArrow(cut, f"_key {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, max_tokens: int = 2048, max_docs: int | None = None,
         max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), score: str = "norm",
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset. The document and attention
    capacities default to the largest values that ``max_tokens`` allows."""
    max_docs = max_tokens if max_docs is None else max_docs
    max_cost = max_tokens * max_tokens if max_cost is None else max_cost
    if score not in ("norm", "dot"):
        raise ValueError("score is 'norm' or 'dot'")
    max_piece = min(max_tokens, math.isqrt(max_cost))
    cut = materialize(row_key(pieces(docs, tokenizer, end_id, max_piece, key, text)), "pieces")
    whole = F.col("length") >= F.lit(max_tokens)
    n_groups = max(1, math.ceil(cut.filter(~whole).count() / GROUP_ROWS))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_row"], ascending=[False, True])
        bins, offsets = best_fit(pdf["length"].to_numpy(), max_tokens, max_docs, max_cost, weights, score)
        return pd.DataFrame({"_row": pdf["_row"], "sequence_id": pdf["_group"].astype("int64") * 2 ** 32 + bins, "offset": offsets})

    small = cut.filter(~whole).select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(n_groups)).cast("int").alias("_group"))
    placed = small.groupBy("_group").applyInPandas(fit, "_row long, sequence_id long, offset long")
    full = cut.filter(whole).withColumns({"sequence_id": -1 - F.col("_row"), "offset": F.lit(0).cast("long")})
    joined = cut.filter(~whole).join(placed, "_row")
    out = ["_key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(*out).unionByName(joined.select(*out)).withColumnRenamed("_key", key)
