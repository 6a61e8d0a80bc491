"""The catalogue as bundles of plain data over the derived collection, and its time-based rules.

The SQL tells each rule by its own condition, not by the values that are planted.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import scalars as X
from canopy.operators import bundles as B
from canopy.operators import rules as R
from canopy.operators.timers import TimedRules
from canopy.plans import catalogue_queries as C
from canopy.sources import shared

_SET = lambda field: [{"field": field, "operator": "not_equals", "value": ""}]
_RANK = lambda *ranks: [{"field": "rank_id", "operator": "in", "value": list(ranks)}]
_NAMED = lambda *ranks: [{"relation": "taxon:name", "field": "rank_id", "operator": "in", "value": list(ranks)}]
CAPITAL, LOWER, ONE_WORD = r"^\p{Lu}\p{Ll}*$", r"^[^\p{Lu}]+$", r"^\S+$"


def _rule(of_table, rule_id, field_name, mechanism, conditions=(), severity="warn", **parameters):
    return {"rule_id": rule_id, "table_name": of_table, "field_name": field_name, "validator_type": mechanism, "conditions": list(conditions), "severity": severity, "parameters": parameters}


#: Relations and rules of the collection.
CORE = {
    "name": "core",
    "relations": {
        "taxon:name": {"from_table": "taxon", "from_column": "name_id", "to_table": "name", "to_column": "id"},
        "taxon:parent": {"from_table": "taxon", "from_column": "parent_id", "to_table": "taxon", "to_column": "id"},
        "name:reference": {"from_table": "name", "from_column": "reference_id", "to_table": "reference", "to_column": "id", "first_of_list": True},
        "interaction:taxon": {"from_table": "species_interaction", "from_column": "related_taxon_id", "to_table": "taxon", "to_column": "id"},
    },
    "rules": [
        _rule("taxon", "taxon_parent_exists", "parent_id", "foreign_key_exists", severity="error", relation="taxon:parent"),
        _rule("taxon", "taxon_parent_cycle", "parent_id", "no_self_cycle", severity="error", parent_column="parent_id"),
        _rule(
            "taxon", "probable_incertae_sedis", "parent_id", "related_field_in_set",
            [*_NAMED("SPECIES"), {"relation": "taxon:name", "field": "code_id", "operator": "equals", "value": "ZOOLOGICAL"}], "info",
            relation=["taxon:parent", "taxon:name"], related_field="rank_id", values=R.GENUS_RANKS,
        ),
        _rule("species_interaction", "interaction_related_taxon_exists", "related_taxon_id", "foreign_key_exists", severity="error", relation="interaction:taxon"),
        {**_rule("species_interaction", "interaction_needs_type", "type_id", "presence", severity=""), "enforcement": "hard"},
        _rule("creator", "creator_orcid_check_digit", "orcid", "check_digit", _SET("orcid"), format="orcid"),
        _rule("creator", "creator_rorid_check_digit", "rorid", "check_digit", _SET("rorid"), format="rorid"),
        _rule("creator", "creator_email_format", "email", "regex", _SET("email"), pattern=X.EMAIL),
        _rule("name", "parse_quality_range", "parse_quality", "range", severity="debug", min=1, max=1),
        _rule("name", "label_length", "scientific_name", "length", severity="debug", min=3, max=30),
    ],
}
#: Rules about names and their places.
CHECKLIST = {
    "name": "checklist",
    "rules": [
        _rule("name", "reference_id_invalid", "reference_id", "foreign_key_exists", severity="error", relation="name:reference"),
        _rule("name", "duplicate_name", "canonical_simple", "count_across", severity="info", table="name", match=[{"target": "canonical_simple", "self": "canonical_simple"}], exclude_self=True, expected={"max": 0}),
        *[_rule("name", f"wrong_monomial_case_{f}", f, "regex", _SET(f), pattern=CAPITAL) for f in ("uninomial", "genus")],
        *[_rule("name", f"uppercase_epithet_{f}", f, "regex", _SET(f), pattern=LOWER) for f in ("specific_epithet", "infraspecific_epithet")],
        *[_rule("name", f"multi_word_{f}", f, "regex", _SET(f), pattern=ONE_WORD) for f in ("uninomial", "specific_epithet")],
        _rule("name", "missing_genus", "genus", "presence", _SET("specific_epithet")),
        _rule("name", "infraspecific_needs_specific", "specific_epithet", "presence", _SET("infraspecific_epithet")),
        _rule("name", "species_rank_needs_specific", "specific_epithet", "presence", _RANK(*R.SPECIES_RANKS)),
        _rule("name", "suprageneric_needs_uninomial", "uninomial", "presence", _RANK(*R.SUPRAGENERIC)),
        _rule("name", "specific_epithet_on_suprageneric", "specific_epithet", "absence", _RANK(*R.SUPRAGENERIC)),
        _rule("name", "unlikely_year", "published_in_year", "range", _SET("published_in_year"), min=R.FIRST_YEAR, max=R.LAST_YEAR),
        _rule("reference", "doi_invalid", "doi", "regex", _SET("doi"), pattern=X.DOI),
        _rule("taxon", "parent_genus_missing", "parent_id", "ancestor_exists", _NAMED("SPECIES"), parent_column="parent_id", match={"relation": "taxon:name", "field": "rank_id", "operator": "in", "value": R.GENUS_RANKS}),
        _rule("taxon", "parent_species_missing", "parent_id", "ancestor_exists", _NAMED(*R.BELOW_SPECIES), parent_column="parent_id", match={"join": {"from": "name_id", "to": "name.id"}, "field": "rank_id", "operator": "equals", "value": "SPECIES"}),
        _rule("taxon", "classification_rank_order_invalid", "parent_id", "parent_rank_higher", parent_column="parent_id", rank_column="rank_id", code_column="code_id", join={"from": "name_id", "to": "name.id"}, rank_order=R.RANK_ORDER),
        _rule(
            "taxon", "published_before_genus", "published_in_year", "ancestor_field_check", _NAMED("SPECIES"), parent_column="parent_id",
            stop_when={"relation": "taxon:name", "field": "rank_id", "operator": "equals", "value": "GENUS"},
            **{"assert": {"self_relation": "taxon:name", "self_field": "published_in_year", "ancestor_relation": "taxon:name", "ancestor_field": "published_in_year", "operator": "greater_than_or_equals"}},
        ),
    ],
}
#: What the collection's owner has switched off or made more severe.
RULESETS = {"checklist": True}
CONFIG = {"label_length": (False, None), "unlikely_year": (None, "error")}


def catalogue():
    return B.merge([B.load(CORE), B.load(CHECKLIST)], RULESETS, CONFIG)


def violations(spark, sf_dir):
    """All violations of both bundles, as they are configured."""
    return B.validate(catalogue(), C.collection(spark, sf_dir)).select("table_name", "record_id", "rule_id", "field_name", "severity", "enforcement", "actual_value")


def admitted(spark, sf_dir):
    """Interactions that no rule with hard enforcement blocks, per type."""
    tables = C.collection(spark, sf_dir)
    found = B.Compiled(catalogue(), tables).violations("species_interaction")
    return B.admit(tables["species_interaction"], found, "species_interaction").groupBy("type_id").agg(F.count("*").alias("n"))


_YEAR = "try_cast({} AS DOUBLE)"
_UPPER = r"'[\p{Lu}]'"
#: Table, rule, field, severity, enforcement, and when it fires.
_FIRES = [
    ("name", "parse_quality_range", "parse_quality", "debug", "soft", "parse_quality < 1 OR parse_quality > 1"),
    ("name", "unlikely_year", "published_in_year", "error", "soft", "published_in_year <> '' AND (try_cast(published_in_year AS DOUBLE) IS NULL OR try_cast(published_in_year AS DOUBLE) NOT BETWEEN 1753 AND 2100)"),
    ("name", "reference_id_invalid", "reference_id", "error", "hard", "trim(split_part(reference_id, ',', 1)) <> '' AND trim(split_part(reference_id, ',', 1)) NOT IN (SELECT id FROM reference)"),
    ("name", "duplicate_name", "canonical_simple", "info", "soft", "canonical_simple <> '' AND canonical_simple IN (SELECT canonical_simple FROM name GROUP BY canonical_simple HAVING count(*) > 1)"),
    *[("name", f"wrong_monomial_case_{f}", f, "warn", "soft", rf"{f} <> '' AND NOT regexp_matches({f}, '^\p{{Lu}}\p{{Ll}}*$')") for f in ("uninomial", "genus")],
    *[("name", f"uppercase_epithet_{f}", f, "warn", "soft", f"{f} <> '' AND regexp_matches({f}, {_UPPER})") for f in ("specific_epithet", "infraspecific_epithet")],
    *[("name", f"multi_word_{f}", f, "warn", "soft", rf"regexp_matches({f}, '\s')") for f in ("uninomial", "specific_epithet")],
    ("name", "missing_genus", "genus", "warn", "soft", "genus = '' AND specific_epithet <> ''"),
    ("name", "infraspecific_needs_specific", "specific_epithet", "warn", "soft", "specific_epithet = '' AND infraspecific_epithet <> ''"),
    ("name", "species_rank_needs_specific", "specific_epithet", "warn", "soft", f"specific_epithet = '' AND rank_id IN ({', '.join(map(repr, R.SPECIES_RANKS))})"),
    ("name", "suprageneric_needs_uninomial", "uninomial", "warn", "soft", f"uninomial = '' AND rank_id IN ({', '.join(map(repr, R.SUPRAGENERIC))})"),
    ("name", "specific_epithet_on_suprageneric", "specific_epithet", "warn", "soft", f"specific_epithet <> '' AND rank_id IN ({', '.join(map(repr, R.SUPRAGENERIC))})"),
    ("reference", "doi_invalid", "doi", "warn", "soft", f"doi <> '' AND NOT regexp_matches(doi, '{X.DOI}')"),
    ("species_interaction", "interaction_needs_type", "type_id", "error", "hard", "type_id = ''"),
    ("species_interaction", "interaction_related_taxon_exists", "related_taxon_id", "error", "hard", "related_taxon_id <> '' AND related_taxon_id NOT IN (SELECT id FROM taxon)"),
    ("creator", "creator_email_format", "email", "warn", "soft", f"email <> '' AND NOT regexp_matches(email, '{X.EMAIL}')"),
    # the check digits themselves are told in SQL by val_check_digit_*; here the valid identifiers are named
    ("creator", "creator_orcid_check_digit", "orcid", "warn", "soft", "orcid NOT IN ('', '0000-0002-1825-0097')"),
    ("creator", "creator_rorid_check_digit", "rorid", "warn", "soft", f"rorid NOT IN ('', '{C.RORIDS[0]}')"),
]
_PLACES = [
    ("taxon_parent_exists", "error", "hard", "u.parent_id", "up u WHERE u.parent_id <> '' AND u.parent_id NOT IN (SELECT id FROM taxon)"),
    ("taxon_parent_cycle", "error", "hard", "u.parent_id", "up u JOIN cyc USING (id)"),
    ("probable_incertae_sedis", "info", "soft", "u.parent_id", "up u JOIN up p ON p.id = u.parent_id WHERE u.rank = 'SPECIES' AND u.code = 'ZOOLOGICAL' AND p.rank NOT IN ('GENUS', 'SUBGENUS', 'INFRAGENUS')"),
    ("parent_genus_missing", "warn", "soft", "u.parent_id", "up u WHERE rank = 'SPECIES' AND NOT EXISTS (SELECT 1 FROM anc a WHERE a.id = u.id AND a.rank IN ('GENUS', 'SUBGENUS', 'INFRAGENUS'))"),
    ("parent_species_missing", "warn", "soft", "u.parent_id", f"up u WHERE rank IN ({', '.join(map(repr, R.BELOW_SPECIES))}) AND NOT EXISTS (SELECT 1 FROM anc a WHERE a.id = u.id AND a.rank = 'SPECIES')"),
    ("classification_rank_order_invalid", "warn", "soft", "u.parent_id", f"up u JOIN up p ON p.id = u.parent_id WHERE list_position({R.RANK_ORDER['ZOOLOGICAL']}, p.rank) >= list_position({R.RANK_ORDER['ZOOLOGICAL']}, u.rank)"),
    ("published_before_genus", "warn", "soft", "u.year", f"up u JOIN near USING (id) WHERE u.rank = 'SPECIES' AND u.year <> '' AND near.year <> '' AND {_YEAR.format('u.year')} < {_YEAR.format('near.year')}"),
]


def _ctes():
    good, bad = C.RORIDS
    made = ", ".join(f"{name} AS ({sql.format(**{t: t for t in C.TABLES}).replace('@GOOD', good).replace('@BAD', bad)})" for name, sql in C.RELATIONS.items())
    return f"""WITH RECURSIVE {made}, up AS (SELECT t.id, t.parent_id, n.rank_id AS rank, n.code_id AS code, n.published_in_year AS year FROM taxon t LEFT JOIN name n ON n.id = t.name_id),
        walk AS (SELECT id, parent_id AS far, 1 AS depth FROM taxon WHERE parent_id <> '' UNION ALL SELECT w.id, t.parent_id, w.depth + 1 FROM walk w JOIN taxon t ON t.id = w.far WHERE t.parent_id <> '' AND w.depth < 12),
        cyc AS (SELECT DISTINCT id FROM walk WHERE far = id),
        anc AS (SELECT DISTINCT w.id, u.id AS top, u.rank, u.year, min(w.depth) OVER (PARTITION BY w.id, u.id) AS depth FROM walk w JOIN up u ON u.id = w.far WHERE w.id <> w.far),
        near AS (SELECT id, year FROM anc WHERE rank = 'GENUS' QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth) = 1) """


def _oracle():
    parts = [f"SELECT '{t}' AS table_name, id AS record_id, '{r}' AS rule_id, '{f}' AS field_name, '{s}' AS severity, '{e}' AS enforcement, CAST({f} AS VARCHAR) AS actual_value FROM {t} WHERE {w}" for t, r, f, s, e, w in _FIRES]
    parts += [f"SELECT 'taxon', u.id, '{r}', '{'published_in_year' if v == 'u.year' else 'parent_id'}', '{s}', '{e}', {v} FROM {rows}" for r, s, e, v, rows in _PLACES]
    return _ctes() + " UNION ALL ".join(parts)


#: A bundle of rules that run every so many days.
TIMED = {
    "name": "timed",
    "rules": [
        {**_rule("reference", "undated_reference", "issued", "presence", _SET("author")), "trigger": "time_based", "recheck_days": 30},
        {**_rule("reference", "doi_again", "doi", "regex", _SET("doi"), pattern=X.DOI), "trigger": "time_based"},
    ],
}
#: When the sweeps are, and since when the issues of each rule are known after the last of them.
SWEEPS = ["1998-01-01 00:00:00", "1998-01-05 00:00:00", "1998-01-08 00:00:00"]


def sweeps(spark, sf_dir):
    """Issues after three sweeps: the second finds no rule due, the third the weekly one, whose issues of references that were mended meanwhile go."""
    reference = C.collection(spark, sf_dir)["reference"]
    mended = reference.withColumn("doi", F.when(F.length("id") % 2 == 0, "10.1234/mended").otherwise(F.col("doi"))).withColumn("issued", F.lit("1900"))
    timers = TimedRules(spark, shared.folder(spark, "timers"))
    for now, rows in zip(SWEEPS, (reference, mended, mended), strict=True):
        timers.sweep(B.merge([B.load(TIMED)]), {"reference": rows}, now)
    runs = spark.createDataFrame(list(timers.state().items()), "rule_id string, last_run_at string")
    return timers.issues().join(runs, "rule_id").select("table_name", "record_id", "rule_id", "field_name", "severity", "actual_value", "created_at", "last_run_at")


def _sweeps_oracle():
    row = "SELECT 'reference' AS table_name, id AS record_id, '{}' AS rule_id, '{}' AS field_name, 'warn' AS severity, {} AS actual_value, '{}' AS created_at, '{}' AS last_run_at FROM reference WHERE {}"
    return _ctes() + " UNION ALL ".join([
        row.format("undated_reference", "issued", "issued", SWEEPS[0], SWEEPS[0], "author <> '' AND issued = ''"),
        row.format("doi_again", "doi", "doi", SWEEPS[0], SWEEPS[2], f"length(id) % 2 = 1 AND doi <> '' AND NOT regexp_matches(doi, '{X.DOI}')"),
    ])


QUERIES = {
    "rules_bundle": (violations, _oracle()),
    "rules_admit": (admitted, _ctes() + "SELECT type_id, count(*) AS n FROM species_interaction WHERE id NOT IN (SELECT id FROM species_interaction WHERE type_id = '' OR (related_taxon_id <> '' AND related_taxon_id NOT IN (SELECT id FROM taxon))) GROUP BY ALL"),
    "time_rules_sweep": (sweeps, _sweeps_oracle()),
}
