"""Graph operators on DataFrames: connected components by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, drop_cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list of integers; component is the smallest node reachable.

    Each round hooks every node to its smallest smaller neighbour, flattens those trees by pointer
    jumping, then contracts the edges to the tree roots and drops those inside one tree. A round
    leaves only roots that are local minima, so the edge list shrinks geometrically; no group is
    ever gathered, every step is a combinable aggregate or an equi-join. Each round is written to
    the shared folder. Self loops keep a node, nulls are dropped, an empty list gives no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    e = cut(_undirected(e))
    result: DataFrame | None = None
    while not e.isEmpty():
        trees = _flatten(cut(e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")))
        result = trees if result is None else cut(_follow(result, trees).unionByName(trees.join(result, "node", "left_anti")))
        old, e = e, cut(_undirected(_relabel(_relabel(e, "a", trees), "b", trees)))
        drop_cut(old)
    if result is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(result, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _undirected(e: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end, without loops."""
    return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _relabel(e: DataFrame, end: str, trees: DataFrame) -> DataFrame:
    t = trees.select(F.col("node").alias(end), "root")
    return e.join(t, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")


def _follow(p: DataFrame, q: DataFrame) -> DataFrame:
    """p with each root replaced by that root's root in q."""
    up = q.select(F.col("node").alias("root"), F.col("root").alias("up"))
    return p.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))


def _flatten(p: DataFrame) -> DataFrame:
    """Pointer jumping until every node points at a node without a parent."""
    while True:
        up = p.select(F.col("node").alias("root"), F.col("root").alias("up"))
        if p.join(up, "root", "left_semi").isEmpty():
            return p
        old, p = p, cut(_follow(p, p))
        drop_cut(old)
