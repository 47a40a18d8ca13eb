"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b).

    Each round hangs every node below its smallest neighbour, shortens the
    chains by one jump, and contracts the edges; what is left of a component
    shrinks by more than half each round. Nothing but a row count reaches the
    driver.
    """
    left = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    parents: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("up"))
        above = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = materialize(near.join(above, "up").select("node", F.col("top").alias("up")), "parents")
        parents.append(parent)
        a = parent.select(F.col("node").alias("a"), F.col("up").alias("x"))
        b = parent.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = left.join(a, "a").join(b, "b").select("x", "y")
        chain = parent.select(F.col("up").alias("x")).distinct().join(a.select(F.col("a").alias("x"), F.col("x").alias("y")), "x")
        moved = moved.unionByName(chain.select("x", "y")).filter("x <> y")
        left = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not parents:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = parents[0]
    for parent in parents[1:]:
        step = parent.select(F.col("node").alias("up"), F.col("up").alias("next"))
        found = found.join(step, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
    return materialize(found.select("node", F.col("up").alias("component")), "components")
