"""Connected components of an edge table (alternating large-star and small-star).

Each round halves the longest path, so rounds grow with the logarithm of a component's
diameter. Neighbour lists are never gathered: a round is two minimum aggregates joined back.
The minima are written to the checkpoint folder before the join, so that a node with very
many neighbours is a skewed join that adaptive execution can split, and a lost executor
costs at most the current step. A step's tables are deleted when the next step is written.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.session import discard, materialize


def _minima(edges: DataFrame, name: str) -> DataFrame:
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")), name)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    minima = _minima(both, "large_star")
    least = minima.withColumn("m", F.least("u", "m"))
    star = materialize(both.filter(F.col("v") > F.col("u")).join(least, "u")
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large_edges")
    discard(minima)
    return star


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` has u > v."""
    least = _minima(edges, "small_star")
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    star = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small_edges")
    discard(least)
    return star


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; the
    component is its smallest node. Null ends and self-loops are ignored; an empty edge table
    gives no rows. Nodes without edges are their own components and are not returned."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v"))
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(df):
        # a star forest is a fixed point: no centre is a leaf of another star
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(e)
    while seen[0]:
        large = _large_star(e)
        small = _small_star(large)
        discard(e, large)
        e = small
        now = state(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
