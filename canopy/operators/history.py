"""Names grouped around their original form, and terms resolved along a parent chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.scalars import empty


def year(combination: Column, basionym: Column, published: Column) -> Column:
    """The first year that is known."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (combination, basionym, published)], F.lit(""))


def nomenclatural_history(involved: DataFrame, names: DataFrame, relations: DataFrame, original: str = "BASIONYM") -> DataFrame:
    """The clusters of every taxon's names: (taxon_id, cluster, anchor, position, name_id, role, involvement, year, label).

    ``involved`` (taxon_id, name_id, accepted boolean) are the accepted name and
    the synonyms, ``names`` (id, label, year), ``relations`` (name_id,
    related_id, type).  A name's anchor is the name that it was first published
    as, itself without such a relation (the greatest id, if there are several).
    Names of the cluster that the taxon doesn't list are ``unlinked``.  A name
    both accepted and synonym is accepted.  Ids without a name are left out.
    """
    known = names.select("id", "label", "year")
    first = relations.where((F.col("type") == original) & (F.col("name_id") != F.col("related_id")))
    first = first.groupBy("name_id").agg(F.max("related_id").alias("target"))
    of_taxon = involved.groupBy("taxon_id", "name_id").agg(F.max(F.col("accepted").cast("int")).alias("accepted"))
    anchored = of_taxon.join(first, "name_id", "left").withColumn("anchor", F.coalesce("target", "name_id")).drop("target")
    clusters = anchored.groupBy("taxon_id", "anchor").agg(F.max("accepted").alias("_first"))
    listed = anchored.select("taxon_id", "anchor", "name_id", (F.lit(1) + F.col("accepted")).alias("rank"))
    origin = clusters.select("taxon_id", "anchor", F.col("anchor").alias("name_id"), F.lit(0).alias("rank"))
    later = clusters.select("taxon_id", "anchor").join(first.withColumnRenamed("target", "anchor"), "anchor")
    members = listed.unionByName(origin).unionByName(later.select("taxon_id", "anchor", "name_id", F.lit(0).alias("rank")))
    members = members.groupBy("taxon_id", "anchor", "name_id").agg(F.max("rank").alias("rank"))
    members = members.join(known.withColumnRenamed("id", "name_id"), "name_id")
    inside = Window.partitionBy("taxon_id", "anchor").orderBy((F.col("name_id") != F.col("anchor")), empty(F.col("year")), "year", "label", "name_id")
    head = known.select(F.col("id").alias("anchor"), F.col("year").alias("_y"), F.col("label").alias("_l"))
    order = Window.partitionBy("taxon_id").orderBy(F.desc("_first"), empty(F.col("_y")), "_y", "_l", "anchor")
    placed = clusters.join(head, "anchor", "left").withColumn("cluster", F.row_number().over(order)).select("taxon_id", "anchor", "cluster")
    role = F.when(F.col("name_id") == F.col("anchor"), "original").otherwise("recombination")
    status = F.when(F.col("rank") == 2, "accepted").when(F.col("rank") == 1, "synonym").otherwise("unlinked")
    return members.withColumn("position", F.row_number().over(inside)).join(placed, ["taxon_id", "anchor"]).select(
        "taxon_id", "cluster", "anchor", "position", "name_id", role.alias("role"), status.alias("involvement"), "year", "label"
    )


def downcast(nodes: DataFrame, pairs: DataFrame, mapped: DataFrame) -> DataFrame:
    """Every node's (id) mapped value: its own, else that of its nearest mapped ancestor, else ''.

    ``pairs`` is the closure (id, ancestor, depth), which has no cycles; ``mapped`` (id, value).
    """
    line = pairs.select("id", "ancestor", "depth").unionByName(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    hit = line.join(mapped.select(F.col("id").alias("ancestor"), "value"), "ancestor")
    near = hit.groupBy("id").agg(F.min_by("value", "depth").alias("value"))
    return nodes.select("id").join(near, "id", "left").select("id", F.coalesce("value", F.lit("")).alias("value"))
