"""Shared helpers: scratch tables in the cluster's shared folder, batching of Arrow input, byte-level text arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: the letters that are lower-cased, and their lower forms
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where it is unset, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_simgrove_shared", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="simgrove-")
            spark._simgrove_shared = base
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/simgrove/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there and lost executors take nothing along."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    write_table(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._simgrove_path = path
    return out


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Writes df; the shuffle files of the write go with its end, since the table takes their place."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def discard(df: DataFrame) -> None:
    """Deletes a table made by stored() that no later plan reads."""
    path = getattr(df, "_simgrove_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hints a broadcast only when the counted rows are within limit; otherwise the planner's shuffled join stays."""
    return F.broadcast(df) if rows <= limit else df


def fresh(name: str, *frames: DataFrame) -> str:
    """`name`, lengthened until none of the frames has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- text as byte arrays ------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: a random value for each byte, from a fixed seed
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        if n:
            out[0] = 1
        return np.multiply.accumulate(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of each white-space word; no word crosses a document's end."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = ~_SPACE[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(solid[:-1], out=first[1:])
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = True
    start = np.flatnonzero(first & solid)
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    last[edge - 1] = True
    end = np.flatnonzero(last & solid) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end, doc


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, by differences of a running polynomial."""
    if not len(start):
        return np.zeros(0, np.uint64)
    out, step = np.empty(len(start), np.uint64), 1 << 20
    with np.errstate(over="ignore"):
        lo = 0
        while lo < len(start):  # pieces that stay in the processor's cache
            base = start[lo]
            hi = max(lo + 1, int(np.searchsorted(end, base + step, side="right")))
            piece = data[base : end[hi - 1]]
            run = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[_FOLD[piece]] * powers(len(piece), _P), out=run[1:])
            inv = powers(len(piece) + 1, _PINV)
            s, e = start[lo:hi] - base, end[lo:hi] - base
            out[lo:hi] = mix64((run[e] - run[s]) * inv[s] + (e - s).astype(np.uint64))
            lo = hi
    return out


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 8 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The input again in pieces of at most `rows` rows and `most` text bytes (one row at least), whatever Arrow's batch size is. All pieces have one schema."""
    held, size, n = [], 0, 0
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = int(ends[at - 1]) if at else 0
            fits = min(int(np.searchsorted(ends, base + most - size, side="right")) - at, rows - n)
            if fits <= 0 and held:
                yield join_batches(held)
                held, size, n = [], 0, 0
                continue
            fits = max(1, fits)
            held.append(b.slice(at, fits))
            at, size, n = at + fits, size + int(ends[at + fits - 1]) - base, n + fits
    if held:
        yield join_batches(held)


def join_batches(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of them all, with plain string and binary columns whatever the number of batches: a task's output must have one schema."""
    plain = {pa.large_string(): pa.string(), pa.large_binary(): pa.binary()}
    t = pa.Table.from_batches(held)
    t = t.cast(pa.schema([(f.name, plain.get(f.type, f.type)) for f in t.schema])).combine_chunks()
    return t.to_batches()[0] if t.num_rows else held[0]
