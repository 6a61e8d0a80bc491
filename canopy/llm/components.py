"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes in ``edges`` (a, b); the component is its least node.

    Each round links every node to the least neighbour of its neighbourhood,
    first for the larger and then for the smaller neighbours, so that the rounds
    grow with the logarithm of the longest path.  A node's neighbours are never
    gathered: minima are aggregated before the shuffle and joined back.  Edges
    with a null end and loops are dropped.
    """
    spark = edges.sparkSession
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # all edges now lead from a larger to a smaller node
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a")
        new = cut(small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(down.select("a", F.col("low").alias("b"))).distinct())
        before, state, now = state, _state(new), new
        if state == before:
            break
    if not state[0]:
        kind = edges.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
