"""Token ids and token counts of a whole column of texts.

Texts go to the workers in Arrow batches and come back as one flat buffer of ids per batch; no value is converted one by one. There is
no shuffle: each text is encoded where it is read.

Defined results: null and empty text give the empty list (0 tokens); blank text is encoded like any other; repeated rows are encoded
each; an empty table gives no rows; texts of any length are encoded whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.bpe import default_path, load

ROWS = 256
"""Texts encoded before their ids are handed on, so that a batch of long texts stays small."""


def _flat(packed: list[bytes]) -> tuple[np.ndarray, bytes]:
    offsets = np.zeros(len(packed) + 1, np.int64)
    np.cumsum([len(x) >> 2 for x in packed], out=offsets[1:])
    return offsets.astype(np.int32), b"".join(packed)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = load(path).packed
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                offsets, flat = _flat([packed(t) for t in part.column(1).to_pylist()])
                ids = pa.Array.from_buffers(pa.int32(), len(flat) >> 2, [None, pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], ["key", "ids"])

    return run


def _measure(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = load(path).packed
        for batch in batches:
            n = [len(packed(t)) >> 2 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], ["key", "n_tokens"])

    return run


def _texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): token ids of each text, without special tokens."""
    return _texts(documents, key, text).mapInArrow(_encode(path or default_path()), "key bigint, ids array<int>").withColumnRenamed("key", key)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens): number of tokens of each text."""
    return _texts(documents, key, text).mapInArrow(_measure(path or default_path()), "key bigint, n_tokens int").withColumnRenamed("key", key)


def decoded(ids: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text): the texts whose ids these are."""
    at = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(at).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["key", "text"])

    return ids.select(F.col(key).alias("key"), "ids").mapInArrow(run, "key bigint, text string").withColumnRenamed("key", key)
