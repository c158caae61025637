"""Feature extraction by user functions: one vector for each named layer of each record."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract_features(df: DataFrame, sample_id: str, value: str, layers: dict[str, Callable[[object], np.ndarray]], preprocess: Callable[[object], object] | None = None) -> DataFrame:
    """layer, layer_ordinal, sample_id, features: preprocess once for each record, then each layer's function, its result flattened."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, v in zip(pdf["sample_id"], pdf["value"]):
                x = v if preprocess is None else preprocess(v)
                out += [(name, k, i, np.asarray(f(x), float).ravel()) for k, (name, f) in enumerate(layers.items())]
            yield pd.DataFrame(out, columns=["layer", "layer_ordinal", "sample_id", "features"])

    return df.select(F.col(sample_id).cast("long").alias("sample_id"), F.col(value).alias("value")).mapInPandas(run, "layer string, layer_ordinal int, sample_id long, features array<double>")


def hashed_words(dimension: int) -> Callable[[object], np.ndarray]:
    """A deterministic text featuriser: words counted in `dimension` hashed places."""

    def run(text: object) -> np.ndarray:
        import zlib

        v = np.zeros(dimension)
        for w in str(text or "").lower().split():
            v[zlib.crc32(w.encode()) % dimension] += 1
        return v

    return run
