"""Readers of the file formats that records come in: ontologies, vocabularies, bibliographies, JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.parsers import parse_bibtex


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """Classes of an OWL/XML file: id (after # or the last /), label, comment, parent_id; unlabelled ones are left out.

    Of several super-classes the last one counts.
    """
    schema = "`_rdf:about` string, `rdfs:label` string, `rdfs:comment` string, `rdfs:subClassOf` array<struct<`_rdf:resource`:string>>"
    rows = spark.read.format("xml").option("rowTag", "owl:Class").schema(schema).load(path)
    local = lambda c: F.regexp_replace(c, "^.*[/#]", "")
    parent = F.element_at("rdfs:subClassOf", -1)["_rdf:resource"]
    made = rows.select(local(F.col("`_rdf:about`")).alias("id"), F.trim("`rdfs:label`").alias("label"), F.trim("`rdfs:comment`").alias("comment"), local(parent).alias("parent_id"))
    return made.where("label is not null and label <> ''")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of the ``items`` of JSON vocabulary files."""
    rows = spark.read.schema("items array<struct<id:string,name:string>>").option("multiLine", True).json(path)
    return rows.select(F.explode("items").alias("x")).select("x.*")


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """One reference per BibTeX file, with the file's name."""
    rows = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), parse_bibtex(F.col("value")).alias("r"))
    return rows.select("file", "r.*")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)
