"""Connected components of a graph in tables: union-find within partitions, then label exchange between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges of a task: a few dozen megabytes.
TASK = 400_000


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A forest with the edges' components: (v, root) for each vertex of the partition but the roots."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and up != x:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    rows = [(v, find(v)) for v in parent]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype="int64")


def components(edges: DataFrame, task: int = TASK) -> DataFrame:
    """(id, component): each vertex of edges (a, b), longs, with the smallest vertex that it reaches.

    Tasks of about ``task`` edges each find their own components; if one task has all edges, those are the answer. Else
    each round joins a partition's edges by union-find into stars, then links each vertex's neighbours to the
    smallest of them; it ends when every vertex has one neighbour that is smaller, its component's root.
    """
    tasks = -(-edges.count() // task)
    own = edges.select("a", "b").filter("a <> b").coalesce(max(1, tasks)).mapInPandas(_roots, "a long, b long")
    if tasks <= 1:
        near = written(own, "stars")
        return near.select(F.col("a").alias("id"), F.col("b").alias("component")).union(near.select("b", "b").distinct())
    near = written(own.distinct(), "stars")
    while True:  # b is a smaller vertex of a's component
        least = near.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
        many = least.filter("n > 1").select("a").limit(1).isEmpty()
        chained = near.select("a").join(near.select(F.col("b").alias("a")), "a", "left_semi").limit(1).isEmpty()
        if many and chained:
            return near.select(F.col("a").alias("id"), F.col("b").alias("component")).union(near.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        # every vertex points to the least it knows, and what else it knows points there too; then to where that points
        star = near.join(least.select("a", "least"), "a")
        up = star.select("a", F.col("least").alias("b")).union(star.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()
        jump = up.groupBy("a").agg(F.min("b").alias("up")).withColumnRenamed("a", "b")
        next_ = up.join(jump, "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("b").alias("was"))
        pairs = next_.select("a", "b").union(next_.filter("was <> b").select(F.col("was").alias("a"), "b"))
        near = written(pairs.mapInPandas(_roots, "a long, b long").distinct(), "stars")
