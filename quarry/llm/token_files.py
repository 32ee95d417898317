"""Token ids as flat binary files with 64-bit document offsets.

Rows are range-partitioned by (key, row), so partition p holds the p-th stretch of the order. Each task streams
its stretch to three flat files: ids (unsigned 16-bit where the vocabulary fits, else 32-bit), document keys
(int64) and lengths (int64). The rows a task returns are the manifest; only files named in it count, so a
failed or repeated attempt leaves nothing that a reader could see. Prefix sums over the manifest
(one row per partition) give each partition's base, and a second pass writes the global 64-bit offsets, one more than
there are documents. Readers memory-map ids and offsets where the store is local and read ranges elsewhere.

Defined cases: null text holds the end id alone; a null key sorts first and is stored as the smallest int64;
equal keys keep separate entries; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, row_key
from quarry.llm.tokens import by_bytes, crc32_u32, encoder
from quarry.session import scratch_path

NULL_KEY = -(2 ** 63)


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        path = uri.removeprefix("file:")
        return pafs.LocalFileSystem(), "/" + path.lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _array(uri: str, dtype: str, count: int) -> np.ndarray:
    store, path = _store(uri)
    if count == 0:
        return np.empty(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r", shape=(count,))
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype, count)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0,
                      key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files under ``folder`` (a shared store) and return the index: one row per partition with
    its files, counts and ``base``, the ids before it."""
    spark = docs.sparkSession
    rows = row_key(docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")))
    ordered = rows.repartitionByRange("_key", "_row").sortWithinPartitions("_key", "_row").select("_key", "_text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.asarray([end_id], enc.dtype).tobytes()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex[:8]}"
        n_docs = n_ids = 0
        with store.open_output_stream(f"{base}/{name}.ids") as ids, store.open_output_stream(f"{base}/{name}.keys") as keys, \
                store.open_output_stream(f"{base}/{name}.lengths") as lengths:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                keys.write(np.asarray(batch.column(0).fill_null(NULL_KEY), "<i8").tobytes())
                for lo, hi in by_bytes(texts):
                    raw = [r + end for r in enc.encode(texts[lo:hi])]
                    sizes = np.asarray([len(r) // enc.dtype.itemsize for r in raw], "<i8")
                    ids.write(b"".join(raw))
                    lengths.write(sizes.tobytes())
                    n_docs += len(raw)
                    n_ids += int(sizes.sum())
        if n_docs:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "dtype": [enc.dtype.str],
                "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    parts = materialize(ordered.mapInArrow(put, "part int, file string, dtype string, n_docs long, n_ids long"), "token-parts")
    before = Window.orderBy("part")  # one row per partition
    based = parts.withColumn("base", F.sum("n_ids").over(before) - F.col("n_ids"))

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                sizes = _array(f"{folder}/{r['file']}.lengths", "<i8", r["n_docs"])
                at = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8") + r["base"]
                with store.open_output_stream(f"{base}/{r['file']}.offsets") as out:
                    out.write(at.tobytes())
            yield batch

    each = based.repartition(max(1, spark.sparkContext.defaultParallelism))
    return materialize(each.mapInArrow(offsets, based.schema), "token-index")


def read_token_files(index: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = _array(f"{folder}/{r['file']}.offsets", "<i8", r["n_docs"] + 1)
                keys = _array(f"{folder}/{r['file']}.keys", "<i8", r["n_docs"])
                ids = _array(f"{folder}/{r['file']}.ids", r["dtype"], r["n_ids"])
                for lo in range(0, r["n_docs"], 10_000):
                    hi = min(lo + 10_000, r["n_docs"])
                    local = at[lo:hi + 1] - r["base"]
                    crc = [crc32_u32(ids[a:b]) for a, b in zip(local[:-1].tolist(), local[1:].tolist(), strict=True)]
                    mine = np.array(keys[lo:hi])
                    yield pa.RecordBatch.from_pydict({
                        "_key": pa.array(mine, pa.int64(), mask=mine == NULL_KEY), "start": np.array(at[lo:hi]),
                        "n_tokens": np.diff(local), "ids_crc32": pa.array(crc, pa.int64())})

    spread = index.repartition(max(1, index.count()), "part")
    return spread.mapInArrow(get, "_key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("_key", key)


def token_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "token-files")
