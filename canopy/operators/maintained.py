"""Ancestor pairs kept up to date under batches of edits, and the records that an edit of the tree touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators import hierarchy as H
from canopy.plans.materialise import materialise


def changed_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids whose own step up is another one: new, deleted and moved nodes, and those whose parent has come or gone."""
    up = lambda tree, name: tree.select("id", F.when(~H.is_root(), F.col("parent_id")).alias(name), F.lit(True).alias(f"in_{name}"))
    both = up(before, "old").join(up(after, "new"), "id", "full_outer")
    there = materialise(both.where(~F.col("old").eqNullSafe(F.col("new")) | F.col("in_old").isNull() | F.col("in_new").isNull()).select("id", "in_old", "in_new"))
    flown = there.where("in_old is null or in_new is null").select(F.col("id").alias("parent_id"))
    below = before.select("id", "parent_id").union(after.select("id", "parent_id")).join(flown, "parent_id", "left_semi").select("id")
    return there.select("id").union(below).distinct()


def closure_after(pairs: DataFrame, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (id, ancestor, depth) of the tree ``after``, from those of the tree ``before``; and the touched ids.

    A node is touched if it or one of its ancestors has changed.  Its line up to the
    nearest changed node stays, what follows is the new line of that node; only lines
    of changed nodes are walked.  All other pairs are taken over as they are.
    """
    changed = materialise(changed_nodes(before, after))
    own = changed.select("id", F.col("id").alias("near"), F.lit(0).alias("near_depth"))
    above = pairs.join(changed.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", F.col("ancestor").alias("near"), F.col("depth").alias("near_depth"))
    near = materialise(own.union(above).groupBy("id").agg(F.min_by("near", "near_depth").alias("near"), F.min("near_depth").alias("near_depth")))
    living = near.join(after.select("id"), "id", "left_semi")
    lines = H.closure(after, changed.join(after.select("id"), "id", "left_semi")).select(F.col("id").alias("near"), "ancestor", "depth")
    kept = pairs.join(living, "id").where("depth <= near_depth").select("id", "ancestor", "depth")
    beyond = living.join(lines, "near").select("id", "ancestor", (F.col("depth") + F.col("near_depth")).alias("depth"))
    # a new cycle can lead a line back to what is kept of it
    fresh = kept.union(beyond).where("id <> ancestor").groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))
    stay = pairs.join(near.select("id"), "id", "left_anti").select("id", "ancestor", "depth")
    return materialise(stay.union(fresh)), near.select("id")
