"""Connected components of a stored edge table, by minimum labels with pointer jumping.

A graph of at most SMALL edges (16 bytes each) is solved by union-find in one executor task instead: the edges are counted first, and a larger graph
takes the distributed rounds with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgrove.llm.common import discard, stored


SMALL = 250_000


def _union_find(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for e in parts:
        for a, b in zip(e["a"].tolist(), e["b"].tolist()):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pd.DataFrame({"node": nodes, "component": [find(x) for x in nodes]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any direction, repeats allowed: node, component (its smallest node). Nodes without edges don't appear.

    A round sends labels over the edges and then follows each label once. All state is in shared tables; only a flag comes to the driver.
    """
    e = stored(edges.filter("a <> b").select("a", "b").distinct(), "plain_edges")
    if e.count() <= SMALL:
        return stored(e.coalesce(1).mapInPandas(_union_find, "node long, component long"), "components")
    both = stored(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        near = labels.join(seen, "node").select("node", "component", F.least("component", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        new = near.join(jump, "next").select("node", F.least("next", "far").alias("component"), (F.least("next", "far") != F.col("component")).alias("moved"))
        new = stored(new, "labels")
        discard(labels)
        labels = new
        if labels.filter("moved").isEmpty():
            discard(both)
            return labels.select("node", "component")
