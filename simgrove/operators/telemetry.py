"""Telemetry and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def telemetry_summary(samples: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """Maximum and mean of each metric, nulls left out, null where nothing is there; and the number of samples."""
    a = [F.count(F.lit(1)).alias("n_samples")]
    for m in metrics:
        a += [F.max(m).alias(f"max_{m}"), F.avg(m).alias(f"mean_{m}")]
    return samples.groupBy(*(keys or [])).agg(*a)


def bench_stats(runs: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """min, max, mean, median, sample standard deviation (0 for one value)."""
    v = F.col(value)
    return runs.filter(v.isNotNull()).groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.coalesce(F.nanvl(F.stddev_samp(v), F.lit(0.0)), F.lit(0.0)).alias("stdev"))


def loglog_slope(runs: DataFrame, n: str, t: str) -> DataFrame:
    return runs.filter((F.col(n) > 0) & (F.col(t) > 0)).agg(F.regr_slope(F.ln(t), F.ln(n)).alias("slope"))


def correlations(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Pearson, and Spearman by averaged ranks, inside each group of keys."""
    def rank(c: str):
        w = W.partitionBy(*keys).orderBy(c)
        return F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy(*keys, c)) - 1) / 2

    r = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"rx_": rank(x), "ry_": rank(y)})
    return r.groupBy(*keys).agg(F.corr(x, y).alias("pearson"), F.corr("rx_", "ry_").alias("spearman"))


def layer_phase_times(phases: DataFrame, names: list[str]) -> DataFrame:
    """layer, a column for each phase (its last duration) and layer_total. phases: layer, phase, place, seconds."""
    last = phases.groupBy("layer", "phase").agg(F.max_by("seconds", "place").alias("seconds"))
    p = last.groupBy("layer").pivot("phase", names).agg(F.first("seconds"))
    total = F.lit(0.0)
    for n in names:
        total = total + F.coalesce(F.col(n), F.lit(0.0))
    return p.withColumn("layer_total", total)


def throughput(samples, seconds):
    """Samples a second; null without time."""
    return F.when(seconds > 0, samples / seconds)
