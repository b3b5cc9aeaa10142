"""Connected components of an edge table by alternating stars: no graph, component or neighbour list is ever in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's smallest neighbour m (or itself); its larger neighbours (large star) or its smaller ones and itself
    (small star) are linked to m. edges (u, v) with u > v, without repeats."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is linked to one node only, which is linked to none: no node is both."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    each = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return each.where("out > 1 OR (out = 1 AND in = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches; component is its smallest reachable node.

    Edges may repeat, run either way and be loops; edges with a null end are ignored. Each round is written to the shared
    folder, so lineage stays short; rounds end when every node is linked to its component alone."""
    edges = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _settled(edges):
        edges = stored(_star(_star(edges, True), False))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, component) with the components that the edges (a, b) join made one, and the edges' nodes added.

    Only edges between different components are walked along, so few rounds over few edges follow what is known."""
    found = edges
    for end in ("a", "b"):
        found = found.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left").withColumn(f"{end}_in", F.coalesce(f"{end}_in", end))
    between = stored(found.where("a_in <> b_in").select(F.col("a_in").alias("a"), F.col("b_in").alias("b")).distinct())
    if between.isEmpty():
        return labels
    moved = components(between).select(F.col("node").alias("of"), F.col("component").alias("to"))
    kept = labels.join(moved, labels["component"] == moved["of"], "left").select("node", F.coalesce("to", "component").alias("component"))
    new = moved.join(labels.select(F.col("node").alias("of")), "of", "left_anti").select(F.col("of").alias("node"), F.col("to").alias("component"))
    return stored(kept.unionByName(new))
