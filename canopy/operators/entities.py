"""Lists of the records that hang on a taxon or a name, their issue badges, and dependency counts.

Every list is written for all owners at once: a page per owner in a total
order.  The page bound is checked before the shuffle (Spark cuts each group to
the page on the map side), so an owner with very many records costs no more
than one with a page of them.  One owner's list is the same after a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.scalars import severity_name, severity_rank, text
from canopy.operators.validation import is_open

PAGE = 100
#: Most rows of one page, and the furthest offset.
MOST, FURTHEST = 500, 1_000_000


def page(rows: DataFrame, owner: str, order: list[Column], limit: int = PAGE, offset: int = 0) -> DataFrame:
    """Rows of each owner from ``offset`` on, with their ``position`` (from 1)."""
    limit, offset = min(limit, MOST), min(offset, FURTHEST)
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return rows.withColumn("position", place).where((F.col("position") <= offset + limit) & (F.col("position") > offset))


def with_badges(rows: DataFrame, key: str, table: str, issues: DataFrame) -> DataFrame:
    """The rows with the number of open issues and the highest severity of each ('' without any)."""
    some = issues.where(is_open() & (F.col("table_name") == table)).groupBy(F.col("record_id").alias("_record"))
    counts = some.agg(F.count("*").alias("n_issues"), F.max(severity_rank(F.col("severity"))).alias("_rank"))
    joined = rows.join(counts, F.col(key).cast("string") == F.col("_record"), "left")
    shown = F.when(F.col("_rank").isNull(), "").otherwise(severity_name(F.col("_rank")))
    return joined.withColumn("n_issues", F.coalesce("n_issues", F.lit(0))).withColumn("max_severity", shown).drop("_record", "_rank")


def vernaculars(rows: DataFrame, limit: int = PAGE) -> DataFrame:
    """Preferred names first, then by language and name."""
    return page(rows, "taxon_id", [F.desc_nulls_last("preferred"), F.col("language"), F.col("name"), F.col("id")], limit)


def distributions(rows: DataFrame, limit: int = PAGE) -> DataFrame:
    return page(rows, "taxon_id", [F.col("gazetteer"), F.col("area"), F.col("id")], limit)


def type_materials(rows: DataFrame, limit: int = PAGE) -> DataFrame:
    return page(rows, "name_id", [F.col("status"), F.col("id")], limit)


def interactions(rows: DataFrame, taxa: DataFrame, limit: int = PAGE) -> DataFrame:
    """Interactions of the subject with the related taxon's name, where it is known."""
    names = taxa.select(F.col("id").alias("related_id"), F.col("name").alias("_name"))
    named = rows.join(names, "related_id", "left").withColumn("related_name", F.coalesce("_name", text(F.col("related_text")))).drop("_name", "related_text")
    return page(named, "taxon_id", [F.col("type"), F.col("related_name"), F.col("id")], limit)


def synonyms(rows: DataFrame, names: DataFrame, limit: int = PAGE) -> DataFrame:
    """Synonyms of each taxon by canonical name."""
    named = rows.join(names.select(F.col("id").alias("name_id"), "canonical"), "name_id", "left")
    return page(named, "taxon_id", [F.col("canonical"), F.col("id")], limit)


def synonym_partners(rows: DataFrame, limit: int = PAGE) -> DataFrame:
    """All accepted taxa of each pro parte synonym."""
    return page(rows.select("id", "taxon_id").distinct(), "id", [F.col("taxon_id")], limit)


def relations_of(relations: DataFrame) -> DataFrame:
    """Both sides of every relation: name_id, type, direction and the other name.

    A relation of a name with itself is outgoing only.
    """
    out = relations.select("name_id", "type", F.lit("outgoing").alias("direction"), F.col("related_id").alias("counterpart"))
    back = relations.where("name_id <> related_id").select(F.col("related_id").alias("name_id"), "type", F.lit("incoming").alias("direction"), F.col("name_id").alias("counterpart"))
    return out.unionByName(back)


def references(rows: DataFrame, query: str = "", offset: int = 0, limit: int = PAGE) -> DataFrame:
    """One page by author, issue date, title and id of the references that contain the query, without regard to case."""
    fields = [F.contains(F.lower(text(F.col(c))), F.lit(query.lower())) for c in ("author", "title", "citation", "doi")]
    some = rows.where(fields[0] | fields[1] | fields[2] | fields[3]) if query else rows
    return some.orderBy("author", "issued", "title", "id").offset(min(offset, FURTHEST)).limit(min(limit, MOST))


def agents(rows: DataFrame, limit: int = PAGE) -> DataFrame:
    return page(rows, "role", [F.col("family"), F.col("given"), F.col("id")], limit)


def dependencies(names: DataFrame, taxa: DataFrame, synonym_rows: DataFrame, relations: DataFrame) -> DataFrame:
    """How many taxa, synonyms and relations (on either side) name each name; what keeps it from being deleted."""

    def count(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("id")).agg(F.count("*").alias(name))

    sides = relations.select(F.col("name_id").alias("n")).union(relations.where("name_id <> related_id").select("related_id"))
    out = names.select("id")
    for counts in (count(taxa, "name_id", "taxa"), count(synonym_rows, "name_id", "synonyms"), count(sides, "n", "relations")):
        out = out.join(counts, "id", "left")
    return out.na.fill(0)


def single_owner(names: DataFrame, taxa: DataFrame) -> DataFrame:
    """The taxon of each name (id) that has exactly one, else null: where an issue of the name leads to."""
    owners = taxa.groupBy(F.col("name_id").alias("id")).agg(F.min("id").alias("_first"), F.count("*").alias("_n"))
    return names.join(owners, "id", "left").withColumn("taxon_id", F.when(F.col("_n") == 1, F.col("_first"))).drop("_first", "_n")


def label_issues(issues: DataFrame, names: DataFrame, taxa: DataFrame) -> DataFrame:
    """A page of issues with the label of their record and the taxon that they lead to.

    ``names`` (id, label), ``taxa`` (id, name_id).  A name leads to its only
    taxon, a taxon to itself; records of other tables have their id as label.
    """
    of_name = single_owner(names.select("id", "label"), taxa).select(F.lit("name").alias("table_name"), F.col("id").alias("record_id"), "label", "taxon_id")
    labels = names.select(F.col("id").alias("name_id"), "label")
    of_taxon = taxa.join(labels, "name_id", "left").select(F.lit("taxon").alias("table_name"), F.col("id").alias("record_id"), "label", F.col("id").alias("taxon_id"))
    joined = issues.join(of_name.unionByName(of_taxon), ["table_name", "record_id"], "left")
    return joined.withColumn("label", F.coalesce("label", "record_id"))
