"""Telemetry as a stream: windows over event time with a watermark, late rows left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_summary(events: DataFrame, time: str, value: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, key, n, max and mean of the value; works on a stream and on a table alike."""
    e = events.withColumn("at_", F.col(time).cast("timestamp")).withWatermark("at_", late)
    g = e.groupBy(F.window("at_", width).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"))
    return g.select(F.col("w.start").alias("window_start"), "key", "n", "max_value", "mean_value")
