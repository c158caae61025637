"""Feature tables: layer, sample_id, features (doubles)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_features(df: DataFrame, sample_id: str, vector: str, layer: str) -> DataFrame:
    return df.select(F.lit(layer).alias("layer"), F.col(sample_id).cast("long").alias("sample_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("features"))


def embeddings(spark: SparkSession, sf_dir: str, layer: str = "embedding") -> DataFrame:
    """Only the two columns that are needed reach the scan."""
    return as_features(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", layer)


def layered(spark: SparkSession, sf_dir: str, layers: int = 4, width: int = 16) -> DataFrame:
    """Layers over the same samples, in order: the first width * k components, k = 1 .. layers."""
    e = embeddings(spark, sf_dir)
    ks = F.explode(F.sequence(F.lit(1), F.lit(layers))).alias("k")
    e = e.select("sample_id", "features", ks)
    return e.select(F.concat(F.lit("layer_"), F.col("k").cast("string")).alias("layer"), (F.col("k") - 1).alias("layer_ordinal"), "sample_id", F.slice("features", F.lit(1), F.col("k") * width).alias("features"))


def from_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """Union of one frame a layer; each has sample_id and features. A layer without features is an error."""
    out = None
    for k, (name, df) in enumerate(layers.items()):
        if "features" not in df.columns:
            raise ValueError(f"layer {name} has neither features nor a similarity matrix")
        part = df.select(F.lit(name).alias("layer"), F.lit(k).alias("layer_ordinal"), "sample_id", "features")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no layers")
    return out


def flatten_features(c, depth: int):
    """An array column nested to `depth` levels as one flat array."""
    for _ in range(depth - 1):
        c = F.flatten(c)
    return c


def matrix_pairs(df: DataFrame, layer: str = "layer", matrix: str = "matrix") -> DataFrame:
    """A precomputed square matrix (array of rows) in long form: layer, i, j, similarity for i < j."""
    rows = df.select(F.col(layer).alias("layer"), F.posexplode(matrix).alias("i", "row"))
    cells = rows.select("layer", "i", F.posexplode("row").alias("j", "similarity"))
    return cells.filter("i < j").select("layer", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("similarity").cast("double").alias("similarity"))


def synthetic(spark: SparkSession, seed: int, samples: int, dimension: int) -> DataFrame:
    """Deterministic synthetic features: standard normals plus 0.2 times an offset of the sample's group (sample modulo groups)."""
    rng = np.random.default_rng(seed + samples * 1_000_003 + dimension)
    groups = min(5, max(2, samples // 25))
    values = rng.standard_normal((samples, dimension))
    values += 0.2 * rng.standard_normal((groups, dimension))[np.arange(samples) % groups]
    rows = [("synthetic", i, [float(x) for x in np.float32(v)]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "layer string, sample_id long, features array<double>")
