"""The rule catalogue of an archive, and validation of all its tables at once.

Row-local rules are data and share one scan per table; rules that look at other
rows are joins over the closure or grouped counts.  All of them fire on set
values only unless their point is the missing value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import scalars as X
from canopy.functions.parsers import MARKERS, parse_name
from canopy.operators import hierarchy as H
from canopy.operators import validation as V

# Fixed values of the domain.
ROLES = ["creator", "contact", "contributor", "editor", "publisher"]
SPECIES_RANKS = ["SPECIES", "SUBSPECIES", "VARIETY", "SUBVARIETY", "FORM", "SUBFORM"]
BELOW_SPECIES = ["SUBSPECIES", "VARIETY", "SUBVARIETY", "FORM", "SUBFORM"]
GENUS_RANKS = ["GENUS", "SUBGENUS", "INFRAGENUS"]
#: Ranks from the highest to the lowest per code: a parent stands before its child.
RANK_ORDER = {
    "BACTERIAL": ["KINGDOM", "PHYLUM", "CLASS", "SUBCLASS", "ORDER", "SUBORDER", "FAMILY", "SUBFAMILY", "TRIBE", "SUBTRIBE", "GENUS", "SUBGENUS", "SPECIES", "SUBSPECIES"],
    "BOTANICAL": [
        "KINGDOM", "SUBKINGDOM", "PHYLUM", "SUBPHYLUM", "CLASS", "SUBCLASS", "SUPERORDER", "ORDER", "SUBORDER", "FAMILY", "SUBFAMILY", "TRIBE", "SUBTRIBE",
        "GENUS", "SUBGENUS", "SECTION", "SUBSECTION", "SERIES", "SUBSERIES", "SPECIES", "SUBSPECIES", "VARIETY", "SUBVARIETY", "FORM", "SUBFORM",
    ],
    "VIRUS": ["REALM", "KINGDOM", "PHYLUM", "CLASS", "ORDER", "FAMILY", "SUBFAMILY", "GENUS", "SPECIES"],
    "ZOOLOGICAL": [
        "SUPERKINGDOM", "KINGDOM", "SUBKINGDOM", "INFRAKINGDOM", "SUPERPHYLUM", "PHYLUM", "SUBPHYLUM", "INFRAPHYLUM", "SUPERCLASS", "CLASS", "SUBCLASS", "INFRACLASS",
        "SUPERCOHORT", "COHORT", "MAGNORDER", "SUPERORDER", "MIRORDER", "ORDER", "SUBORDER", "INFRAORDER", "PARVORDER", "NANORDER", "SUPERFAMILY", "EPIFAMILY", "FAMILY",
        "SUPERSUBFAMILY", "SUBFAMILY", "INFRAFAMILY", "SUPERTRIBE", "TRIBE", "SUBTRIBE", "INFRATRIBE", "SUPERGENUS", "GENUS", "SUPERSUPERSUBGENUS", "SUPERSUBGENUS",
        "SUBGENUS", "INFRAGENUS", "SUPERSUPERSPECIES", "SUPERSPECIES", "SUBSUPERSPECIES", "SPECIES", "SUBSPECIES",
    ],
}
#: Ranks above the genera that a name of one word is asked for.
SUPRAGENERIC = [
    "FAMILY", "SUPERFAMILY", "SUBFAMILY", "ORDER", "SUPERORDER", "SUBORDER", "INFRAORDER", "CLASS", "SUPERCLASS", "SUBCLASS", "PHYLUM", "SUPERPHYLUM", "SUBPHYLUM",
    "KINGDOM", "SUBKINGDOM", "SUPERKINGDOM", "DOMAIN",
]
MARKER_OF = {"SUBSPECIES": ["subsp.", "ssp."], "VARIETY": ["var."], "SUBVARIETY": ["subvar."], "FORM": ["f."], "SUBFORM": ["subf."]}
FIRST_YEAR, LAST_YEAR = 1753, 2100
SHARED_REFERENCE = {"BASIONYM": "subsequent_combination_shares_reference", "REPLACEMENT_NAME": "replacement_name_shares_reference", "SPELLING_CORRECTION": "spelling_correction_shares_reference"}
#: What an identifier of an organisation is spelled with.
ROR_DIGITS = "0123456789abcdefghjkmnpqrstvwxyz"


def ror_ok(c: Column) -> Column:
    """Seven base-32 digits and two check digits, ISO 7064 MOD 97-10."""
    plain = F.regexp_replace(F.lower(c), "^https?://ror.org/", "")
    digits = F.transform(F.split(F.substring(plain, 1, 7), ""), lambda d: F.instr(F.lit(ROR_DIGITS), d) - 1)
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 32 + d)
    check = F.lit(98) - (value * 100) % 97
    return plain.rlike(f"^0[{ROR_DIGITS}]{{6}}[0-9]{{2}}$") & (check == F.substring(plain, 8, 2).try_cast("int"))


def _set(field: str) -> Column:
    return ~X.empty(F.col(field))


def name_rules() -> list[V.Rule]:
    rank, code = F.col("rank_id"), F.col("code_id")
    capital, lower, one = r"^\p{Lu}\p{Ll}*$", r"^[^\p{Lu}]+$", r"^\S+$"
    rules = [V.Rule(f"wrong_monomial_case_{f}", f, V.pattern(f, capital), when=_set(f)) for f in ("uninomial", "genus")]
    rules += [V.Rule(f"uppercase_epithet_{f}", f, V.pattern(f, lower), when=_set(f)) for f in ("specific_epithet", "infraspecific_epithet")]
    rules += [V.Rule(f"multi_word_{f}", f, V.pattern(f, one), when=_set(f)) for f in ("uninomial", "specific_epithet")]
    shown = F.filter(F.split("scientific_name", " "), lambda w: w.isin(MARKERS))
    needs = F.lit(False)
    for of_rank, markers in MARKER_OF.items():
        needs = F.when(rank == of_rank, ~F.exists(shown, lambda w: w.isin(markers))).otherwise(needs)
    gate = (code != "VIRUS") & ~((code == "ZOOLOGICAL") & (rank == "SUBSPECIES"))
    return [
        *rules,
        V.Rule("missing_genus", "genus", V.presence("genus"), when=_set("specific_epithet")),
        V.Rule("infraspecific_needs_specific", "specific_epithet", V.presence("specific_epithet"), when=_set("infraspecific_epithet")),
        V.Rule("species_rank_needs_specific", "specific_epithet", V.presence("specific_epithet"), when=rank.isin(SPECIES_RANKS)),
        V.Rule("suprageneric_needs_uninomial", "uninomial", V.presence("uninomial"), when=rank.isin(SUPRAGENERIC)),
        V.Rule("specific_epithet_on_suprageneric", "specific_epithet", V.absence("specific_epithet"), when=rank.isin(SUPRAGENERIC)),
        V.Rule("unlikely_year", "published_in_year", V.number_range("published_in_year", FIRST_YEAR, LAST_YEAR), when=_set("published_in_year")),
        V.Rule("parse_failed", "parse_quality", F.col("parse_quality") == 0, "error"),
        V.Rule("parse_warnings", "parse_quality", F.col("parse_quality") > 1),
        V.Rule("parse_tail", "scientific_name", parse_name(F.col("scientific_name"))["tail"] != ""),
        V.Rule("infraspecific_marker_missing", "scientific_name", X.text(needs.cast("string")) == "true", when=gate),
        V.Rule(
            "combination_matches_basionym",
            "combination_authorship",
            (F.col("basionym_authorship") == F.col("combination_authorship")) & (F.col("basionym_authorship_year") == F.col("combination_authorship_year")),
            when=_set("basionym_authorship") & _set("combination_authorship") & _set("basionym_authorship_year") & _set("combination_authorship_year"),
        ),
    ]


def reference_rules() -> list[V.Rule]:
    return [
        V.Rule("doi_invalid", "doi", V.pattern("doi", X.DOI), when=_set("doi")),
        V.Rule("isbn_check_digit", "isbn", ~(X.isbn10_ok(F.replace("isbn", F.lit("-"), F.lit(""))) | X.isbn13_ok(F.replace("isbn", F.lit("-"), F.lit("")))), when=_set("isbn")),
        V.Rule("issn_check_digit", "issn", ~X.issn_ok(F.col("issn")), when=_set("issn")),
        V.Rule("reference_missing_structured_metadata", "citation", X.empty(F.col("author")) | X.empty(F.col("issued")), when=_set("citation")),
    ]


def agent_rules(role: str) -> list[V.Rule]:
    return [
        V.Rule(f"{role}_orcid_check_digit", "orcid", ~X.orcid_ok(F.col("orcid")), when=_set("orcid")),
        V.Rule(f"{role}_rorid_check_digit", "rorid", ~ror_ok(F.col("rorid")), when=_set("rorid")),
        V.Rule(f"{role}_email_format", "email", V.pattern("email", X.EMAIL), when=_set("email")),
    ]


def interaction_rules() -> list[V.Rule]:
    return [
        V.Rule("interaction_needs_type", "type_id", V.presence("type_id"), "error"),
        V.Rule("interaction_needs_related", "related_taxon_id", X.empty(F.col("related_taxon_id")) & X.empty(F.col("related_taxon_scientific_name")), "error"),
    ]


def _named(taxon: DataFrame, name: DataFrame) -> DataFrame:
    """Taxa (id, parent_id) with rank, code and year of their names."""
    facts = name.select(F.col("id").alias("name_id"), F.col("rank_id").alias("rank"), F.col("code_id").alias("code"), F.col("published_in_year").alias("year"))
    return taxon.select("id", "parent_id", "name_id").join(facts, "name_id", "left")


def taxon_violations(taxon: DataFrame, name: DataFrame, pairs: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """All rules about a taxon's place in the tree; one closure (``pairs``, if it is kept) serves them all.

    With ``only`` (id) just these taxa are validated, against the whole tree.
    """
    everything, whole = taxon, _named(taxon, name)
    pairs = H.closure(taxon) if pairs is None else pairs
    some = (lambda df: df) if only is None else (lambda df: df.join(only, "id", "left_semi"))
    taxon, nodes, pairs_of = some(taxon), some(whole), pairs
    pairs = some(pairs)
    hit = lambda rows, rule, field="parent_id", severity="warn": V.violation(rows, "taxon", "id", rule, field, severity)
    up = whole.select(F.col("id").alias("parent_id"), F.col("rank").alias("parent_rank"))
    with_parent = nodes.join(up, "parent_id")
    low = high = F.lit(0)
    for code, order in RANK_ORDER.items():
        ranks = F.array(*map(F.lit, order))
        low = F.when(F.col("code") == code, F.array_position(ranks, F.col("rank"))).otherwise(low)
        high = F.when(F.col("code") == code, F.array_position(ranks, F.col("parent_rank"))).otherwise(high)
    genera = whole.where(F.col("rank").isin(GENUS_RANKS))
    species = nodes.where("rank = 'SPECIES'")
    near = H.nearest_ancestor(pairs, whole.where("rank = 'GENUS'").select(F.col("id").alias("ancestor"), F.col("year").alias("genus_year")))
    early = species.join(near, "id").where("try_cast(year AS int) < try_cast(genus_year AS int)")
    incertae = with_parent.where((F.col("code") == "ZOOLOGICAL") & (F.col("rank") == "SPECIES") & ~X.text(F.col("parent_rank")).isin(GENUS_RANKS))
    # a node on a cycle is an ancestor of its parent, or its own parent
    around = pairs_of.select(F.col("id").alias("parent_id"), F.col("ancestor").alias("id"))
    cyclic = taxon.join(around, ["parent_id", "id"], "left_semi").select(*taxon.columns).unionByName(taxon.where("id = parent_id"))
    return (
        hit(V.ancestor_missing(species, pairs, genera), "parent_genus_missing")
        .unionByName(hit(V.ancestor_missing(nodes.where(F.col("rank").isin(BELOW_SPECIES)), pairs, whole.where("rank = 'SPECIES'")), "parent_species_missing"))
        .unionByName(hit(with_parent.where((low > 0) & (high > 0) & (high >= low)), "classification_rank_order_invalid"))
        .unionByName(hit(early, "published_before_genus", "year"))
        .unionByName(hit(incertae, "probable_incertae_sedis", severity="info"))
        .unionByName(hit(V.foreign_key(taxon, "parent_id", everything, "id"), "taxon_parent_exists", severity="error"))
        .unionByName(hit(cyclic, "taxon_parent_cycle", severity="error"))
    )


def name_violations(name: DataFrame, reference: DataFrame, relation: DataFrame) -> DataFrame:
    """Rules that compare names with each other and with their references."""
    first = name.withColumn("_ref", X.first_of_list(F.col("reference_id")))
    hit = lambda rows, rule, field, severity="warn", table="name", key="id": V.violation(rows, table, key, rule, field, severity)
    out = hit(V.duplicates(name.where(_set("canonical_simple")), ["canonical_simple"]), "duplicate_name", "canonical_simple", "info")
    out = out.unionByName(hit(V.foreign_key(first, "_ref", reference, "id").drop("_ref"), "reference_id_invalid", "reference_id", "error"))
    dated = reference.select(F.col("id").alias("_r"), X.year_of(F.col("issued")).alias("_year"))
    wrong = first.join(dated, F.col("_ref") == F.col("_r")).where(_set("published_in_year") & _set("_year") & (F.col("published_in_year") != F.col("_year")))
    out = out.unionByName(hit(wrong.select(*name.columns), "source_year_mismatch", "published_in_year"))
    out = out.unionByName(hit(relation.where("name_id = related_name_id"), "name_on_self_relation", "related_name_id", "error", "name_relation", "name_id"))
    refs = first.select(F.col("id").alias("_id"), F.col("_ref").alias("_of"))
    typed = relation.where(F.col("type_id").isin(list(SHARED_REFERENCE)) & (F.col("name_id") != F.col("related_name_id")))
    both = typed.join(refs, F.col("name_id") == F.col("_id")).drop("_id").withColumnRenamed("_of", "reference_id")
    both = both.join(refs, F.col("related_name_id") == F.col("_id")).where(_set("reference_id") & (F.col("reference_id") == F.col("_of")))
    both = both.select("name_id", "type_id", "reference_id").distinct()
    for kind, rule in SHARED_REFERENCE.items():
        out = out.unionByName(hit(both.where(F.col("type_id") == kind), rule, "reference_id", key="name_id"))
    return out


def stale(metadata: DataFrame, touched: DataFrame, now: str, days: int = 365) -> DataFrame:
    """Metadata that nobody changed for so many days; (id, touched_at)."""
    old = metadata.join(touched, "id", "left").where(F.try_to_timestamp("touched_at").isNull() | (F.try_to_timestamp("touched_at") < F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {days} DAYS")))
    return V.violation(old, "metadata", "id", "stale_metadata", "touched_at", "info")


#: Plug-in rules: name to a function of the archive's tables that gives violations.
EXTRA: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}


def reindex(tables: dict[str, DataFrame], keep: Callable[[list[V.Rule]], list[V.Rule]] = lambda rules: rules) -> DataFrame:
    """All violations of the tables that are there; ``keep`` applies overrides to the row-local rules."""
    parts = []
    if "name" in tables:
        parts.append(V.row_local("name", tables["name"], "id", keep(name_rules())))
    if "reference" in tables:
        parts.append(V.row_local("reference", tables["reference"], "id", keep(reference_rules())))
    if "species_interaction" in tables:
        parts.append(V.row_local("species_interaction", tables["species_interaction"], "id", keep(interaction_rules())))
        if "taxon" in tables:
            far = V.foreign_key(tables["species_interaction"], "related_taxon_id", tables["taxon"], "id")
            parts.append(V.violation(far, "species_interaction", "id", "interaction_related_taxon_exists", "related_taxon_id", "error"))
    parts += [V.row_local(role, tables[role], "id", keep(agent_rules(role))) for role in ROLES if role in tables]
    if {"taxon", "name"} <= set(tables):
        parts.append(taxon_violations(tables["taxon"], tables["name"]))
    if {"name", "reference", "name_relation"} <= set(tables):
        parts.append(name_violations(tables["name"], tables["reference"], tables["name_relation"]))
        citing = [(tables[t].select(F.explode(F.transform(F.split(X.text(F.col("reference_id")), ","), lambda r: F.trim(r))).alias("cited")), "cited") for t in tables if t != "reference" and "reference_id" in tables[t].columns]
        parts.append(V.violation(V.uncited(tables["reference"], "id", citing), "reference", "id", "reference_uncited", "id", "info"))
    parts += [rule(tables) for rule in EXTRA.values()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
