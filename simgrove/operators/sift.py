"""Threshold sweeps over the component table: grids, convergence, counts, partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simgrove.operators.forest import PARTS, at_places, leaves


def convergence_values(start: float = 0.999, step: float = 0.02) -> list[float]:
    """Falling by repeated subtraction while above 0; the value after the last is what a sweep that never converges returns."""
    out, x = [], start
    while x > 0:
        out.append(x)
        x -= step
    return [*out, x]


def linspace(start: float, end: float, n: int) -> list[float]:
    if n < 2:
        raise ValueError("a sequence needs two thresholds or more")
    if start <= end:
        raise ValueError("a sequence starts above its end")
    step = (end - start) / (n - 1)
    return [start + k * step for k in range(n - 1)] + [end]


def find_convergence(msf: DataFrame, samples: DataFrame, start: float = 0.999, step: float = 0.02) -> DataFrame:
    """layer, convergence: the first value at which one component is left."""
    *values, last = convergence_values(start, step)
    n = samples.groupBy("layer").agg(F.countDistinct("sample_id").alias("n"))
    low = msf.groupBy("layer").agg(F.min("similarity").alias("low"), F.count(F.lit(1)).alias("edges"))
    reached = F.filter(F.array(*[F.lit(v) for v in values]), lambda v: F.col("low") > v)
    j = n.join(low, "layer", "left")
    return j.select("layer", F.when((F.col("edges") == F.col("n") - 1) & (F.size(reached) > 0), reached[0]).otherwise(F.lit(last)).alias("convergence"))


def grids(convergence: DataFrame, n_steps: int) -> DataFrame:
    """layer, thresholds: n_steps values from 1.0 down to the layer's convergence, both included."""
    k = F.sequence(F.lit(0), F.lit(n_steps - 1))
    width = (F.col("convergence") - 1.0) / (n_steps - 1)
    return convergence.select("layer", F.transform(k, lambda s: F.when(s == n_steps - 1, F.col("convergence")).otherwise(1.0 + s * width)).alias("thresholds"))


def explicit_grid(spark: SparkSession, layers: list[str], thresholds: list[float]) -> DataFrame:
    return spark.createDataFrame([(x, [float(t) for t in thresholds]) for x in layers], "layer string, thresholds array<double>")


def grid_rows(g: DataFrame) -> DataFrame:
    return g.select("layer", F.posexplode("thresholds").alias("step", "threshold")).withColumn("step", F.col("step").cast("long"))


def first_step(similarity: Column) -> Column:
    """The first step whose threshold lies strictly below: on a falling grid, the number of thresholds that don't."""
    return F.size(F.filter("thresholds", lambda t: ~(similarity > t))).cast("long")


def component_curve(msf: DataFrame, samples: DataFrame, g: DataFrame) -> DataFrame:
    """layer, step, threshold, num_components: samples less the forest edges that are active. Edges are counted by their first step, then summed along the grid."""
    n = samples.groupBy("layer").agg(F.countDistinct("sample_id").alias("n"))
    per_step = msf.join(F.broadcast(g), "layer").groupBy("layer", first_step(F.col("similarity")).alias("step")).agg(F.count(F.lit(1)).alias("merges"))
    rows = grid_rows(g).join(per_step, ["layer", "step"], "left").join(n, "layer")
    merged = F.sum(F.coalesce("merges", F.lit(0))).over(W.partitionBy("layer").orderBy("step"))
    return rows.select("layer", "step", "threshold", (F.col("n") - merged).cast("long").alias("num_components"))


def visible(components: DataFrame, g: DataFrame) -> DataFrame:
    """Components that some step of the grid shows, with first_step and last_step."""
    v = components.join(F.broadcast(g), "layer")
    v = v.withColumns({"first_step": first_step(F.col("birth")), "last_step": first_step(F.col("death")) - 1})
    return v.filter("first_step <= last_step")


def shown(v: DataFrame, g: DataFrame) -> DataFrame:
    """`at_steps` of visible components, which are broadcast: a task has whole steps of the grid, so no row for a component and step is shuffled. Dealt by step alone, which serves windows with a constant layer too."""
    j = grid_rows(g).repartition(PARTS, "step").join(F.broadcast(v), "layer").filter("step between first_step and last_step")
    return _ranked(j)


def _ranked(c: DataFrame) -> DataFrame:
    return c.withColumn("cluster_id", (F.row_number().over(W.partitionBy("layer", "step").orderBy("min_member")) - 1).cast("long"))


def at_steps(components: DataFrame, g: DataFrame) -> DataFrame:
    """A row for each component and step at which it is there, with cluster_id (rank by smallest member)."""
    v = visible(components, g).withColumn("step", F.explode(F.sequence("first_step", "last_step")))
    v = v.withColumn("threshold", F.element_at("thresholds", (F.col("step") + 1).cast("int"))).drop("thresholds")
    return _ranked(v)


def membership(components: DataFrame, g: DataFrame) -> DataFrame:
    """layer, step, threshold, sample_id, cluster_id, cluster_size, comp_id: by the samples' places in the leaf order."""
    c = at_steps(components, g)
    j = at_places(c).join(leaves(components), ["layer", "place"])
    return j.select("layer", "step", "threshold", "sample_id", "cluster_id", F.col("size").alias("cluster_size"), "comp_id")


def nearest_step(g: DataFrame, target: Column | float) -> DataFrame:
    """layer, step, threshold of the grid value nearest to the target; ties to the higher threshold."""
    target = target if isinstance(target, Column) else F.lit(target)
    return grid_rows(g).groupBy("layer").agg(F.min_by(F.struct("step", "threshold"), F.struct(F.abs(F.col("threshold") - target), F.col("step"))).alias("x")).select("layer", "x.step", "x.threshold")
