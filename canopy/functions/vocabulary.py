"""Controlled vocabularies as small DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions.scalars import vocabulary_name

# Fixed values of the domain: ranks from the highest to the lowest, by group.
RANKS = {
    "higher": ["DOMAIN", "REALM", "KINGDOM", "SUBKINGDOM", "PHYLUM", "SUBPHYLUM", "CLASS", "SUBCLASS", "ORDER", "SUBORDER", "INFRAORDER"],
    "family": ["SUPERFAMILY", "FAMILY", "SUBFAMILY", "TRIBE", "SUBTRIBE"],
    "genus": ["GENUS", "SUBGENUS", "SECTION", "SUBSECTION", "SERIES"],
    "species": ["SPECIES_AGGREGATE", "SPECIES", "SUBSPECIES", "VARIETY", "SUBVARIETY", "FORM", "SUBFORM"],
}
VOCABULARIES = {
    "nom_code": ["ZOOLOGICAL", "BOTANICAL", "BACTERIAL", "VIRUS", "CULTIVARS"],
    "taxonomic_status": ["ACCEPTED", "PROVISIONALLY_ACCEPTED", "SYNONYM", "AMBIGUOUS_SYNONYM", "MISAPPLIED", "BARE_NAME"],
    "nom_status": ["ESTABLISHED", "NOT_ESTABLISHED", "ACCEPTABLE", "UNACCEPTABLE", "CONSERVED", "REJECTED", "DOUBTFUL", "MANUSCRIPT", "CHRESONYM"],
    "severity": ["debug", "info", "warn", "error"],
}
#: Vocabulary tables of an archive: of ids alone, and with names.
FLAT = ["nom_code", "nom_status", "gender", "sex", "distribution_status", "nom_rel_type", "estimate_type", "name_part", "match_type", "reference_type"]
NAMED = ["taxonomic_status", "type_status", "gazetteer", "species_interaction_type", "taxon_concept_rel_type", "rank", "geo_time"]
#: Long ones, that are read by name.
BY_NAME = ["rank", "geo_time"]
#: Those without an unset term.
REQUIRED = ["species_interaction_type"]


def bundle(spark: SparkSession, more: dict[str, list[str]] | None = None) -> DataFrame:
    """All vocabulary terms (vocabulary, id, name, position); unset terms are left out."""
    every = VOCABULARIES | {"rank": [r for group in RANKS.values() for r in group]} | (more or {})
    rows = [(v, t, k) for v, terms in every.items() for k, t in enumerate(terms) if t]
    terms = spark.createDataFrame(rows, "vocabulary string, id string, position int")
    return terms.select("vocabulary", "id", vocabulary_name(F.col("id")).alias("name"), "position")


def of_tables(tables: dict[str, DataFrame], licenses: list[str] | None = None) -> DataFrame:
    """The terms (vocabulary, id, name, position) of an archive's vocabulary tables; tables that aren't there have none.

    Tables of ids alone get their names from the ids, others may have a name of their
    own.  Terms are in the order of their ids, those of ``BY_NAME`` in that of their
    names.  The unset term is left out where a value is required.  ``licenses`` are
    suggestions, in the order given.
    """
    parts = []
    for vocabulary in [*FLAT, *NAMED]:
        if vocabulary not in tables:
            continue
        id_ = F.coalesce("id", F.lit(""))
        name = vocabulary_name(id_) if vocabulary in FLAT else F.coalesce(F.col("name"), F.lit(""))
        terms = tables[vocabulary].select(F.lit(vocabulary).alias("vocabulary"), id_.alias("id"), name.alias("name"))
        parts.append(terms.where("id <> ''") if vocabulary in REQUIRED else terms)
    if licenses:
        spark = next(iter(tables.values())).sparkSession
        given = spark.createDataFrame(list(enumerate(licenses)), "position int, id string")
        parts.append(given.select(F.lit("license").alias("vocabulary"), "id", F.col("id").alias("name")))
    key = F.when(F.col("vocabulary").isin(BY_NAME), F.col("name")).when(F.col("vocabulary") == "license", F.lpad(F.array_position(F.array(*map(F.lit, licenses or [""])), F.col("id")).cast("string"), 9, "0")).otherwise("")
    place = F.row_number().over(Window.partitionBy("vocabulary").orderBy(key, "id", "name")) - 1
    return reduce(DataFrame.unionByName, parts).withColumn("position", place)


def provisional(status: Column) -> Column:
    return status.isin("PROVISIONALLY_ACCEPTED", "PROVISIONALLY_VALID")


def bare_rank(rank: Column) -> Column:
    """The rank without the suffix of its code."""
    return F.regexp_replace(rank, "_(ZOOLOGY|BOTANY)$", "")
