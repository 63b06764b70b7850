"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantstar.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, for all nodes of ``edges`` (a, b; longs).

    Each round lets every node point to the smallest among itself and its neighbours, follows the pointers
    a few steps, and contracts the graph: ends of edges become what they point to, edges inside a node go.
    So edges shrink from round to round. Every round is stored tables; the driver sees only whether edges
    are left. Ends are looked up by joins that the planner can split, and minima are taken before the
    shuffle, so a node with very many edges is no hot task.
    """
    left = stored(_tidy(edges), "edges")
    roots = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    roots = stored(roots.select("node", F.col("node").alias("root")), "roots")
    while not left.isEmpty():
        ends = left.select("a", "b").union(left.select("b", "a"))
        near = ends.groupBy("a").agg(F.min("b").alias("b"))
        points = stored(near.select(F.col("a").alias("at"), F.least("a", "b").alias("to")), "points")
        for _ in range(2):
            further = points.select(F.col("at").alias("on"), F.col("to").alias("further"))
            points = points.join(further, F.col("to") == F.col("on")).select("at", F.col("further").alias("to"))
            points = stored(points, "points")
        roots = roots.join(points, F.col("root") == F.col("at"), "left")
        roots = stored(roots.select("node", F.coalesce("to", "root").alias("root")), "roots")
        first = left.join(points, F.col("a") == F.col("at")).select(F.col("to").alias("a"), "b")
        left = first.join(points, F.col("b") == F.col("at")).select("a", F.col("to").alias("b"))
        left = stored(_tidy(left), "edges")
    return roots


def _tidy(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ends.where("a < b").distinct()
