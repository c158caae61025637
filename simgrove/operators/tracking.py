"""Tracking: snapshots, histories, merge events, the containment tree, trajectories, pairs and landmarks, all from component intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simgrove.operators.forest import at_places, leaves, with_members
from simgrove.operators.sift import at_steps, grid_rows, membership, nearest_step, shown, visible


def threshold_snapshots(components: DataFrame, g: DataFrame) -> DataFrame:
    """layer, step, threshold, num_clusters, clusters (sorted members, in cluster order), sample_to_cluster."""
    c = with_members(at_steps(components, g), components)
    s = c.groupBy("layer", "step", "threshold").agg(F.count(F.lit(1)).alias("num_clusters"), F.array_sort(F.collect_list(F.struct("cluster_id", "members"))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda x: F.transform(x["members"], lambda m: F.struct(m.alias("k"), x["cluster_id"].alias("v")))))
    return s.select("layer", "step", "threshold", "num_clusters", F.transform("c", lambda x: x["members"]).alias("clusters"), F.map_from_entries(pairs).alias("sample_to_cluster"))


def sample_history(components: DataFrame, g: DataFrame, told: Callable[[Column], Column] | None = None) -> DataFrame:
    """layer, sample_id, step, threshold, cluster_id, cluster_size, members, co_clustered_with.

    With `told`, members is told(members), made once for each component that the grid shows and not for each sample, and co_clustered_with is left out;
    what is told is broadcast with its component, where whole members are joined.
    """
    v = visible(components, g).select("layer", "comp_id", "lo", "hi", "size", "min_member", "first_step", "last_step")
    c = with_members(v, components)
    if told:
        at = shown(c.withColumn("members", told(F.col("members"))), g)
    else:
        at = at_steps(components, g).join(c.select("layer", "comp_id", "members"), ["layer", "comp_id"])
    m = at_places(at).join(F.broadcast(leaves(components)), ["layer", "place"])  # a row for each sample of a layer
    m = m.select("layer", "sample_id", "step", "threshold", "cluster_id", F.col("size").alias("cluster_size"), "members")
    return m if told else m.withColumn("co_clustered_with", F.array_remove("members", F.col("sample_id")))


def merge_events(components: DataFrame, g: DataFrame) -> DataFrame:
    """A row for each component that first shows at a step after the first and was several at the step before.

    layer, step, threshold, resulting_cluster_id, resulting_cluster, merged_cluster_ids, merged_clusters, samples_involved.
    """
    at = at_steps(components, g)
    new = at.filter("step = first_step and step >= 1").select("layer", "step", "threshold", "comp_id", "cluster_id", "lo", "hi", "size")
    old = with_members(at.filter("step = last_step"), components).select(F.col("layer").alias("l_"), (F.col("step") + 1).alias("next"), F.col("cluster_id").alias("old_id"), F.col("members").alias("old_members"), F.col("lo").alias("old_lo"))
    j = new.join(old, (F.col("layer") == F.col("l_")) & (F.col("step") == F.col("next")) & (F.col("old_lo") >= F.col("lo")) & (F.col("old_lo") < F.col("hi")))
    e = j.groupBy("layer", "step", "threshold", "comp_id", "cluster_id", "size").agg(F.array_sort(F.collect_list(F.struct("old_id", "old_members"))).alias("o"))
    e = e.filter(F.size("o") > 1)
    return e.select(
        "layer", "step", "threshold", F.col("cluster_id").alias("resulting_cluster_id"), F.array_sort(F.flatten(F.transform("o", lambda x: x["old_members"]))).alias("resulting_cluster"),
        F.transform("o", lambda x: x["old_id"]).alias("merged_cluster_ids"), F.transform("o", lambda x: x["old_members"]).alias("merged_clusters"), F.col("size").alias("samples_involved"),
    )


def tree_nodes(components: DataFrame, g: DataFrame) -> DataFrame:
    """layer, comp_id, threshold (the lowest at which it is there), node_type, sample_id (leaves), size, min_member."""
    v = visible(components, g)
    leaf = F.col("size") == 1
    return v.select("layer", "comp_id", F.element_at("thresholds", (F.col("last_step") + 1).cast("int")).alias("threshold"), F.when(leaf, "leaf").otherwise("internal").alias("node_type"), F.when(leaf, F.col("min_member")).alias("sample_id"), "size", "min_member")


def tree_edges(components: DataFrame, g: DataFrame) -> DataFrame:
    """layer, parent, child (comp_ids): the parent is the component that holds the child at the step after the child's last."""
    v = visible(components, g)
    c = v.select("layer", F.col("comp_id").alias("child"), F.col("lo").alias("c_lo"), (F.col("last_step") + 1).alias("after"), F.col("min_member").alias("child_min"), F.col("size").alias("child_size"))
    p = v.select(F.col("layer").alias("l_"), F.col("comp_id").alias("parent"), "lo", "hi", F.col("first_step").alias("f"), F.col("min_member").alias("parent_min"), F.col("size").alias("parent_size"))
    return c.join(p, (F.col("layer") == F.col("l_")) & (F.col("after") == F.col("f")) & (F.col("c_lo") >= F.col("lo")) & (F.col("c_lo") < F.col("hi"))).select("layer", "parent", "child", "parent_min", "parent_size", "child_min", "child_size")


def sample_order(components: DataFrame, g: DataFrame) -> DataFrame:
    """Leaves of the tree in the order of their ids."""
    n = tree_nodes(components, g).filter("node_type = 'leaf'")
    return n.select("layer", "sample_id", (F.row_number().over(W.partitionBy("layer").orderBy("sample_id")) - 1).cast("long").alias("position"))


def sample_trajectories(components: DataFrame, g: DataFrame) -> DataFrame:
    """layer, sample_id, first_merge_threshold, first_merge_size, final_cluster_size, clustering_events, size_changes."""
    m = membership(components, g)
    w = W.partitionBy("layer", "sample_id").orderBy("step")
    m = m.withColumn("before", F.lag("cluster_size", 1, 1).over(w))
    grown = F.col("cluster_size") > 1
    changed = F.col("cluster_size") != F.col("before")
    t = m.groupBy("layer", "sample_id").agg(
        F.min_by("threshold", F.when(grown, F.col("step"))).alias("first_merge_threshold"),
        F.coalesce(F.min_by("cluster_size", F.when(grown, F.col("step"))), F.lit(1)).cast("long").alias("first_merge_size"),
        F.max_by("cluster_size", "step").alias("final_cluster_size"),
        F.count(F.when(changed, 1)).alias("clustering_events"),
        F.array_sort(F.collect_list(F.when(changed, F.struct("step", "threshold", F.col("before").alias("from_size"), F.col("cluster_size").alias("to_size"))))).alias("size_changes"),
    )
    never = F.max(F.when(grown, 1)).alias("any")
    return t.join(m.groupBy("layer", "sample_id").agg(never), ["layer", "sample_id"]).withColumn("first_merge_threshold", F.when(F.col("any") == 1, F.col("first_merge_threshold"))).drop("any")


def most_similar_pairs(components: DataFrame, g: DataFrame, top: int = 5) -> DataFrame:
    """Merges into exactly two samples, highest threshold first."""
    e = merge_events(components, g).filter("samples_involved = 2")
    rank = F.row_number().over(W.partitionBy("layer").orderBy("step", "resulting_cluster_id"))
    return e.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("layer", "rank", F.col("resulting_cluster")[0].alias("i"), F.col("resulting_cluster")[1].alias("j"), "threshold")


def class_partitions(components: DataFrame, g: DataFrame, target: Column | float) -> DataFrame:
    """The partition at the grid value nearest to the target: layer, class_id by (-size, smallest member), members, size, threshold."""
    step = nearest_step(g, target).withColumnRenamed("threshold", "snapshot_threshold")
    c = at_steps(components, g).join(F.broadcast(step), ["layer", "step"])
    c = with_members(c, components)
    rank = F.row_number().over(W.partitionBy("layer").orderBy(F.desc("size"), "min_member")) - 1
    return c.select("layer", rank.cast("long").alias("class_id"), "members", "size", F.col("snapshot_threshold").alias("threshold"))


def class_summary(partitions: DataFrame, labels: DataFrame) -> DataFrame:
    """Label counts of each class; labels: sample_id, label; a missing label is 'Unknown'."""
    m = partitions.select("layer", "class_id", "size", F.explode("members").alias("sample_id")).join(labels, "sample_id", "left")
    return m.groupBy("layer", "class_id", "size", F.coalesce(F.col("label").cast("string"), F.lit("Unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def landmark_components(components: DataFrame, g: DataFrame, labels: DataFrame, critical: DataFrame) -> DataFrame:
    """Partitions at the critical value, halfway between 1 and the end, and the end, with label counts. critical: layer, critical_threshold."""
    ends = g.join(critical, "layer").select("layer", "critical_threshold", F.element_at("thresholds", -1).alias("end"))
    marks = ends.select("layer", F.explode(F.create_map(F.lit("critical"), F.col("critical_threshold"), F.lit("midpoint"), (F.col("end") + 1) / 2, F.lit("near_convergence"), F.col("end"))).alias("landmark", "target"))
    near = grid_rows(g).join(marks, "layer").groupBy("layer", "landmark").agg(F.min_by(F.struct("step", "threshold"), F.struct(F.abs(F.col("threshold") - F.col("target")), F.col("step"))).alias("x")).select("layer", "landmark", F.col("x.step").alias("step"))
    c = at_steps(components, g).join(F.broadcast(near), ["layer", "step"])
    rank = F.row_number().over(W.partitionBy("layer", "landmark").orderBy(F.desc("size"), "min_member")) - 1
    c = with_members(c.withColumn("component_index", rank.cast("long")), components)
    m = c.select("layer", "landmark", "threshold", "component_index", "size", F.explode("members").alias("sample_id")).join(labels, "sample_id", "left")
    return m.groupBy("layer", "landmark", "threshold", "component_index", "size", F.coalesce(F.col("label").cast("string"), F.lit("Unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def prev_curr_overlap(components: DataFrame, g: DataFrame) -> DataFrame:
    """layer, step, previous and current cluster ids that share samples, with how many."""
    m = membership(components, g).select("layer", "step", "sample_id", "cluster_id")
    p = m.select("layer", (F.col("step") + 1).alias("step"), "sample_id", F.col("cluster_id").alias("previous_id"))
    return m.join(p, ["layer", "step", "sample_id"]).groupBy("layer", "step", "previous_id", F.col("cluster_id").alias("current_id")).agg(F.count(F.lit(1)).alias("shared"))
