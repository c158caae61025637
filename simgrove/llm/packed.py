"""Packed batches: a few megabytes of documents in one row, so that exchanges between batches and buckets move arrays, not rows.

A batch asks buckets of a hashed key space about its own distinct keys; a bucket answers each batch in the order of its question. Buckets
are even because keys are hashed, and a key costs one entry for each batch however often it occurs there.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgrove.llm.common import chunks, stored, utf8

BATCH_BYTES = 8 << 20
SCHEMA = "batch long, ids array<long>, lens array<long>, text binary"


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def order_of(bucket: np.ndarray) -> np.ndarray:
    """A stable order by small numbers; 16-bit ones are sorted by radix."""
    return np.argsort(bucket.astype(np.uint16) if not len(bucket) or bucket.max() < 1 << 16 else bucket, kind="stable")


def planes(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, one plane of bytes after the other: bytes of the same place compress best together."""
    a = np.ascontiguousarray(a, np.uint64)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + pack(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), 8)[:, :width].T))


def from_planes(b: bytes) -> np.ndarray:
    width, raw = b[0], unpack(b[1:], np.uint8)
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.view(np.uint64)[:, 0]


def batched(docs: DataFrame, doc_id: str, text: str, most: int = BATCH_BYTES) -> DataFrame:
    """Stores the documents as batches. A null id is kept as null, a null text as an empty one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        press = zstandard.ZstdCompressor(level=3)
        for b in chunks(batches, "text", most):
            data, offsets = utf8(b.column("text"))
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("doc_id"))
            lens = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), pa.array(np.diff(offsets)))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), ids, lens, pa.array([press.compress(data.tobytes())], pa.binary())], names=["batch", "ids", "lens", "text"])
            k += 1

    return stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA), "batches")


class Batch:
    def __init__(self, row: dict):
        self.batch, self.ids = row["batch"], row["ids"]
        self.offsets = np.concatenate([[0], np.cumsum(np.array(row["lens"], np.int64))])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)

    def fold(self, mod: int) -> np.ndarray:
        return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % mod for i in self.ids], np.int64)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with."""
    gc.collect()
    spark._jvm.System.gc()
