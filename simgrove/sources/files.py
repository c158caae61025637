"""Files as tables: JSON, CSV, checksum lists, binaries, raw matrices, and sinks for the same."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Lines of `<sha256>  <relative path>`: sha256, path."""
    parts = F.split("value", "  ", 2)
    return spark.read.text(path).filter(F.trim("value") != "").select(parts[0].alias("sha256"), F.trim(parts[1]).alias("path"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """name, n_bytes, sha256, content of each file."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def read_raw_matrix(spark: SparkSession, path: str, dimension: int, layer: str) -> DataFrame:
    """A row-major float32 file as features; a file is one unit of reading."""

    def rows(batches):
        for pdf in batches:
            for c in pdf["content"]:
                m = np.frombuffer(c, "<f4").reshape(-1, dimension).astype(float)
                yield pd.DataFrame({"layer": layer, "sample_id": np.arange(len(m)), "features": list(m)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "layer string, sample_id long, features array<double>")


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("compression", compression).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """Per-layer arrays, one folder a layer."""
    df.write.mode("overwrite").partitionBy("layer").parquet(path)


def write_npy(df: DataFrame, column: str, path: str) -> None:
    """An array column as .npy matrices, one for each task, in a folder of one-column binary rows that `read_npy` and any reader of the bytes understand."""
    import io

    def run(batches):
        for pdf in batches:
            if len(pdf):
                out = io.BytesIO()
                np.save(out, np.stack(pdf[column].to_numpy()))
                yield pd.DataFrame({"npy": [out.getvalue()]})

    df.select(column).mapInPandas(run, "npy binary").write.mode("overwrite").parquet(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """row: the rows of all matrices written by `write_npy`."""
    import io

    def run(batches):
        for pdf in batches:
            for x in pdf["npy"]:
                yield pd.DataFrame({"row": list(np.load(io.BytesIO(x)))})

    return spark.read.parquet(path).mapInPandas(run, "row array<double>")


def fetch_first(rows: DataFrame, addresses: str, fetch) -> DataFrame:
    """Each row's addresses tried in order until one answers: adds address and content (null if none does), and attempts, a log of address, ok, reason.

    fetch(address) returns bytes, or raises OSError with the reason as its text. It runs on executors.
    """
    from pyspark.sql import types as T

    keep = [f for f in rows.schema.fields]
    tried = T.ArrayType(T.StructType([T.StructField("address", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("reason", T.StringType())]))
    schema = T.StructType([*keep, T.StructField("address", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("attempts", tried)])

    def one(names):
        log = []
        for a in names if names is not None else []:
            try:
                content = fetch(a)
            except OSError as e:
                log.append({"address": a, "ok": False, "reason": str(e)})
                continue
            return a, content, [*log, {"address": a, "ok": True, "reason": None}]
        return None, None, log

    def run(batches):
        for pdf in batches:
            got = [one(x) for x in pdf[addresses]]
            yield pdf.assign(address=[x[0] for x in got], content=[x[1] for x in got], attempts=[x[2] for x in got])

    return rows.mapInPandas(run, schema)


def demonstration_fetch(address: str) -> bytes:
    """For tests and demonstrations: by the number at its end, an address answers at once, on the second or third place, or nowhere."""
    place, _, k = address.partition("/")
    if ("publisher", "media", "cache").index(place) < int(k) % 4:
        raise OSError("http_500" if place == "media" else "http_404")
    return address.encode()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and name of every file below a folder."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return b.select(F.sha2("content", 256).alias("sha256"), F.element_at(F.split("path", "/"), -1).alias("path"))


def write_checksums(df: DataFrame, path: str) -> None:
    """Lines sorted by path, in one file: one short line for each listed file."""
    df.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def bundle_inventory(files: DataFrame) -> DataFrame:
    """What a bundle of files holds, in its order: place, name, n_bytes, sha256."""
    from pyspark.sql import Window as W

    return files.select((F.row_number().over(W.orderBy("name")) - 1).cast("long").alias("place"), "name", "n_bytes", "sha256")


class PagedSource(DataSource):
    """Paged REST records (limit, offset, endOfRecords) through a fetch function named by `module:function` in the option `fetch`.

    fetch(offset, limit) returns (list of JSON texts, whether that was the end). Each page is read when the partition before it is known to have gone on, so pages
    are one partition; several `queries` (comma separated) are read side by side.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "query string, record string"

    def reader(self, schema):
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.limit = options["fetch"], int(options.get("limit", 100))
        self.queries = [q for q in options.get("queries", "").split(",") if q] or [""]

    def partitions(self):
        return [InputPartition(q) for q in self.queries]

    def read(self, partition):
        import importlib

        module, _, name = self.fetch.partition(":")
        fetch, offset, end = getattr(importlib.import_module(module), name), 0, False
        while not end:
            records, end = fetch(offset, self.limit)
            for r in records:
                yield (partition.value, r)
            offset += self.limit
            end = end or not records


def numbered_pages(offset: int, limit: int, total: int = 250) -> tuple[list[str], bool]:
    """A source for tests and demonstrations: records 0 to total - 1."""
    rows = ['{"key": %d}' % i for i in range(offset, min(total, offset + limit))]
    return rows, offset + limit >= total
