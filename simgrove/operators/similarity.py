"""Cosine similarity of all pairs: a readable SQL form, and a blocked kernel for size.

The kernel deals rows into shares of many blocks and each pair of shares into one group; a task holds the vectors of two shares and the similarities of two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: samples in a block, whose similarities with another are made at once
BLOCK = 1024
#: shares at least, if there are as many blocks; samples in a share beyond that
SHARES, SHARE = 16, 16384


def norm(c: str) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))


def l2_normalize(features: DataFrame) -> DataFrame:
    """Rows divided by their norm; a zero row stays zero."""
    n = F.when(F.col("n_") == 0, F.lit(1.0)).otherwise(F.col("n_"))
    return features.withColumn("n_", norm("features")).withColumn("features", F.transform("features", lambda x: x / n)).drop("n_")


def active(similarity: Column, threshold: Column) -> Column:
    """Strictly above, and never for NaN, which Spark orders above everything."""
    return ~F.isnan(similarity) & (similarity > threshold)


def pair_similarity_sql(features: DataFrame) -> DataFrame:
    """layer, i < j, similarity by a theta self-join inside each layer; the form to read and to check the kernel with."""
    u = l2_normalize(features)
    a = u.select("layer", F.col("sample_id").alias("i"), F.col("features").alias("fi"))
    b = u.select("layer", F.col("sample_id").alias("j"), F.col("features").alias("fj"))
    dot = F.aggregate(F.zip_with("fi", "fj", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, "layer").filter("i < j").select("layer", "i", "j", dot.alias("similarity"))


def unit_rows(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    n[n == 0] = 1.0
    return v / n


def dealt(features: DataFrame, columns: list[str], n: int, block: int) -> tuple[DataFrame, int]:
    """The columns, b (the row's share), bi and bj, for each pair of shares that a row belongs to; and the number of such pairs.

    A share holds many blocks, so a vector travels to 16 tasks up to 262,144 samples in a layer, and to a task for each further 16,384 beyond.
    """
    shares = max(1, min(-(-n // block), max(SHARES, -(-n // SHARE))))
    f = features.select(*columns, F.pmod(F.xxhash64("sample_id"), F.lit(shares)).cast("int").alias("b"))
    f = f.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    f = f.select(*columns, "b", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"))
    return f, shares * (shares + 1) // 2


def block_places(bi: int, bj: int, left: int, right: int, block: int) -> Iterator[tuple[slice, slice]]:
    """Places of the pairs of blocks in two shares of `left` and `right` rows; within one share each pair once."""
    for a in range(0, left, block):
        for b in range(a if bi == bj else 0, right, block):
            yield slice(a, a + block), slice(b, b + block)


def on_block_pairs(features: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple], schema: str, clip: bool = True, block: int = BLOCK) -> DataFrame:
    """Runs kernel(i ids, j ids, similarities) on each pair of blocks; it returns the output columns after `layer`.

    Within one block the ids are the same on both sides and only the upper triangle counts (the rest is -inf).
    A task has a pair of shares and goes through their blocks one pair at a time.
    """
    n = features.groupBy("layer").count().agg(F.max("count")).first()[0] or 0
    f, tasks = dealt(features, ["layer", "sample_id", "features"], n, block)
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("sample_id", kind="stable")
        layer, bi, bj = pdf["layer"].iloc[0], pdf["bi"].iloc[0], pdf["bj"].iloc[0]
        left, right = pdf[pdf["b"] == bi], pdf[pdf["b"] == bj]
        if not len(left) or not len(right):
            return
        v, w = (unit_rows(np.stack(x["features"].to_numpy()).astype(float)) for x in (left, right))
        ids, jds = left["sample_id"].to_numpy(), right["sample_id"].to_numpy()
        del pdf, left, right
        for a, b in block_places(bi, bj, len(ids), len(jds), block):
            s = v[a] @ w[b].T
            s = np.clip(s, -1, 1) if clip else s
            s[np.isnan(s)] = -np.inf
            if bi == bj and a == b:
                s[np.tril_indices(len(s))] = -np.inf
            out = pd.DataFrame(dict(zip(names[1:], kernel(ids[a], jds[b], s))))
            if len(out):
                out.insert(0, "layer", layer)
                yield out

    return f.repartition(tasks, "layer", "bi", "bj").groupBy("layer", "bi", "bj").applyInPandas(run, schema)


def pair_similarity(features: DataFrame, above: float | None = None, clip: bool = True, block: int = BLOCK) -> DataFrame:
    """layer, i < j, similarity; with `above`, only pairs strictly over it leave the kernel."""

    def kernel(ids: np.ndarray, jds: np.ndarray, s: np.ndarray) -> tuple:
        a, b = np.nonzero(s > (-np.inf if above is None else above))
        i, j = ids[a], jds[b]
        return np.minimum(i, j), np.maximum(i, j), s[a, b]

    return on_block_pairs(features, kernel, "layer string, i long, j long, similarity double", clip, block)
