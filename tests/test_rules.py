"""Every rule of the catalogue: bad rows fire, good rows don't."""

import pytest
from pyspark.sql import functions as F

from canopy.operators import rules as R
from canopy.operators import validation as V

NAME = "id string, scientific_name string, canonical_simple string, rank_id string, code_id string, uninomial string, genus string, specific_epithet string, infraspecific_epithet string, published_in_year string, reference_id string, parse_quality int, basionym_authorship string, basionym_authorship_year string, combination_authorship string, combination_authorship_year string"
REFERENCE = "id string, author string, issued string, title string, citation string, doi string, isbn string, issn string"
AGENT = "id string, orcid string, rorid string, email string"


def frame(spark, schema, rows):
    """Rows as dictionaries; what is missing is empty."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n, 1 if k == "int" else "") for n, k in fields) for r in rows], schema)


def fired(violations):
    found = {}
    for r in violations.collect():
        found.setdefault(r["rule_id"], set()).add(r["record_id"])
    return found


NAME_CASES = [
    ("wrong_monomial_case_uninomial", {"uninomial": "felidae"}, {"uninomial": "Felidae"}),
    ("wrong_monomial_case_genus", {"genus": "pAnthera"}, {"genus": "Panthera"}),
    ("uppercase_epithet_specific_epithet", {"specific_epithet": "Leo", "genus": "A"}, {"specific_epithet": "leo", "genus": "A"}),
    ("uppercase_epithet_infraspecific_epithet", {"infraspecific_epithet": "Persica"}, {"infraspecific_epithet": "persica"}),
    ("multi_word_uninomial", {"uninomial": "Two words"}, {"uninomial": "One"}),
    ("multi_word_specific_epithet", {"specific_epithet": "a b"}, {"specific_epithet": "a"}),
    ("missing_genus", {"specific_epithet": "leo"}, {"specific_epithet": "leo", "genus": "Panthera"}),
    ("infraspecific_needs_specific", {"infraspecific_epithet": "x"}, {"infraspecific_epithet": "x", "specific_epithet": "y"}),
    ("species_rank_needs_specific", {"rank_id": "SPECIES"}, {"rank_id": "SPECIES", "specific_epithet": "leo"}),
    ("suprageneric_needs_uninomial", {"rank_id": "FAMILY"}, {"rank_id": "FAMILY", "uninomial": "Felidae"}),
    ("specific_epithet_on_suprageneric", {"rank_id": "INFRAORDER", "specific_epithet": "x"}, {"rank_id": "SPECIES", "specific_epithet": "x"}),
    ("unlikely_year", {"published_in_year": "1066"}, {"published_in_year": "1758"}),
    ("parse_failed", {"parse_quality": 0}, {"parse_quality": 1}),
    ("parse_warnings", {"parse_quality": 4}, {"parse_quality": 1}),
    ("parse_tail", {"scientific_name": "Panthera leo ?? 12"}, {"scientific_name": "Panthera leo (Linnaeus, 1758)"}),
    ("infraspecific_marker_missing", {"rank_id": "VARIETY", "code_id": "BOTANICAL", "scientific_name": "Quercus alba pinnatifida"}, {"rank_id": "VARIETY", "code_id": "BOTANICAL", "scientific_name": "Quercus alba var. pinnatifida"}),
    ("infraspecific_marker_missing", {"rank_id": "VARIETY", "code_id": "ZOOLOGICAL", "scientific_name": "Panthera leo persica"}, {"rank_id": "SUBSPECIES", "code_id": "ZOOLOGICAL", "scientific_name": "Panthera leo persica"}),
    ("infraspecific_marker_missing", {"rank_id": "SUBSPECIES", "scientific_name": "Panthera leo persica"}, {"rank_id": "SUBSPECIES", "code_id": "VIRUS", "scientific_name": "Panthera leo persica"}),
    (
        "combination_matches_basionym",
        {"basionym_authorship": "L.", "combination_authorship": "L.", "basionym_authorship_year": "1758", "combination_authorship_year": "1758"},
        {"basionym_authorship": "L.", "combination_authorship": "L.", "basionym_authorship_year": "1758", "combination_authorship_year": "1760"},
    ),
]
REFERENCE_CASES = [
    ("doi_invalid", {"doi": "abc.def/xyz"}, {"doi": "10.1234/abcd"}),
    ("isbn_check_digit", {"isbn": "0306460152"}, {"isbn": "0306406152"}),
    ("isbn_check_digit", {"isbn": "9780306406158"}, {"isbn": "978-0306406157"}),
    ("issn_check_digit", {"issn": "2049-3603"}, {"issn": "2049-3630"}),
    ("reference_missing_structured_metadata", {"citation": "c", "author": "A"}, {"citation": "c", "author": "A", "issued": "1900"}),
]
AGENT_CASES = [
    ("editor_orcid_check_digit", {"orcid": "0000-0002-1852-0097"}, {"orcid": "0000-0002-1825-0097"}),
    ("editor_orcid_check_digit", {"orcid": "0000"}, {"orcid": "https://orcid.org/0000-0002-1825-0097"}),
    ("editor_rorid_check_digit", {"rorid": "05dxps054"}, {"rorid": "05dxps055"}),
    *[("editor_email_format", {"email": e}, {}) for e in ("not an email", "alice@", "@example.com", "o'brien@example.com", "a&r@example.com", "user@localhost", "user!company@example.com")],
    *[("editor_email_format", {"email": "x"}, {"email": e}) for e in ("alice@example.com", "alice+tag@example.com", "alice@example.museum", "alice@example.technology", "alice.smith@sub.example.co.uk")],
]


@pytest.mark.parametrize("schema, cases, table, rules", [(NAME, NAME_CASES, "name", R.name_rules), (REFERENCE, REFERENCE_CASES, "reference", R.reference_rules), (AGENT, AGENT_CASES, "editor", lambda: R.agent_rules("editor"))])
def test_row_local_rules(spark, schema, cases, table, rules):
    rows = [{"id": f"{side}{k}", **case[1 + (side == "good")]} for k, case in enumerate(cases) for side in ("bad", "good")]
    found = fired(V.row_local(table, frame(spark, schema, rows), "id", rules()))
    for k, (rule, _, _) in enumerate(cases):
        assert f"bad{k}" in found[rule], (rule, k)
        assert f"good{k}" not in found[rule], (rule, k)
    nulls = frame(spark, schema, [{"id": "n"}]).select(*[F.lit(None).cast("string").alias(f.strip().split(" ")[0]) if "int" not in f else F.lit(1).alias("parse_quality") for f in schema.split(",")])
    assert V.row_local(table, nulls, "id", rules()).collect() == []


def test_interactions(spark):
    taxa = spark.createDataFrame([("t1", None, "n1")], "id string, parent_id string, name_id string")
    rows = spark.createDataFrame(
        [("1", "t1", "x", "", "eats"), ("2", "t1", "", "", ""), ("3", "t1", "t1", "", "eats"), ("4", "t1", None, "by name", "eats")],
        "id string, taxon_id string, related_taxon_id string, related_taxon_scientific_name string, type_id string",
    )
    found = fired(R.reindex({"species_interaction": rows, "taxon": taxa}))
    assert found == {"interaction_related_taxon_exists": {"1"}, "interaction_needs_type": {"2"}, "interaction_needs_related": {"2"}}


def test_place_in_the_tree(spark):
    spec = [  # id, parent, rank, year
        ("fam", None, "FAMILY", ""),
        ("gen", "fam", "GENUS", "1900"),
        ("ok", "gen", "SPECIES", "1950"),
        ("early", "gen", "SPECIES", "1850"),
        ("noyear", "gen", "SPECIES", ""),
        ("orphan", "fam", "SPECIES", "1800"),
        ("sub", "ok", "SUBSPECIES", ""),
        ("badsub", "gen", "SUBSPECIES", ""),
        ("ord", "gen", "ORDER", ""),
        ("lost", "does-not-exist", "GENUS", ""),
        ("a", "c", "", ""),
        ("b", "a", "", ""),
        ("c", "b", "", ""),
        ("below", "c", "", ""),
    ]
    taxon = spark.createDataFrame([(i, p, f"n{i}") for i, p, _, _ in spec], "id string, parent_id string, name_id string")
    name = frame(spark, NAME, [{"id": f"n{i}", "rank_id": r, "code_id": "ZOOLOGICAL", "published_in_year": y} for i, _, r, y in spec])
    found = fired(R.taxon_violations(taxon, name))
    assert found == {
        "parent_genus_missing": {"orphan"},
        "probable_incertae_sedis": {"orphan"},
        "parent_species_missing": {"badsub"},
        "classification_rank_order_invalid": {"ord"},
        "published_before_genus": {"early"},
        "taxon_parent_exists": {"lost"},
        "taxon_parent_cycle": {"a", "b", "c"},
    }


def test_names_and_references(spark):
    name = frame(
        spark,
        NAME,
        [
            {"id": "1", "canonical_simple": "Foo bar", "reference_id": "r1"},
            {"id": "2", "canonical_simple": "Foo bar", "reference_id": "r1, r9", "published_in_year": "1799"},
            {"id": "3", "canonical_simple": "Baz", "reference_id": "nowhere"},
            {"id": "4", "reference_id": "r2", "published_in_year": "1758"},
            {"id": "5"},
        ],
    )
    reference = frame(spark, REFERENCE, [{"id": "r1", "issued": "1758-01"}, {"id": "r2", "issued": "1758"}, {"id": "r3"}, {"id": "r9"}])
    relation = spark.createDataFrame([("2", "1", "BASIONYM"), ("5", "5", "BASIONYM"), ("4", "1", "BASIONYM"), ("1", "2", "SPELLING_CORRECTION")], "name_id string, related_name_id string, type_id string")
    found = fired(R.reindex({"name": name, "reference": reference, "name_relation": relation}))
    assert {k: found[k] for k in ("duplicate_name", "reference_id_invalid", "source_year_mismatch", "name_on_self_relation", "subsequent_combination_shares_reference", "spelling_correction_shares_reference", "reference_uncited")} == {
        "duplicate_name": {"1", "2"},
        "reference_id_invalid": {"3"},
        "source_year_mismatch": {"2"},
        "name_on_self_relation": {"5"},
        "subsequent_combination_shares_reference": {"2"},
        "spelling_correction_shares_reference": {"1"},
        "reference_uncited": {"r3"},
    }
    assert "replacement_name_shares_reference" not in found


def test_overrides_and_stale_metadata(spark):
    name = frame(spark, NAME, [{"id": "1", "genus": "x", "published_in_year": "3000"}])
    keep = lambda rules: V.override(rules, {"unlikely_year": (True, "error"), "wrong_monomial_case_genus": (False, None)})
    rows = R.reindex({"name": name}, keep).collect()
    assert [(r["rule_id"], r["severity"]) for r in rows] == [("unlikely_year", "error")]
    meta = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    touched = spark.createDataFrame([("1", "2025-12-01T00:00:00Z"), ("2", "2020-01-01T00:00:00Z")], "id string, touched_at string")
    assert fired(R.stale(meta, touched, "2026-01-01T00:00:00Z")) == {"stale_metadata": {"2", "3"}}


@pytest.mark.parametrize("kind", ["luhn", "isbn10", "isbn13", "issn", "orcid"])
def test_check_digits_of_large_keys(spark, tmp_path, kind):
    """A number of more digits than its kind has keeps the first of them, as in the query's SQL."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from canopy import registry
    from oracle import spark_rows, sql_rows

    for name in os.listdir("/root/testdata/sf0.001"):
        if name != "customer.parquet":
            os.symlink(f"/root/testdata/sf0.001/{name}", tmp_path / name)
    customer = pq.read_table("/root/testdata/sf0.001/customer.parquet").slice(0, 60)
    keys = pa.array([12_620 + k if k < 20 else 1_262_780 + k if k < 40 else 10**12 + 37 * k for k in range(60)], pa.int64())
    pq.write_table(customer.set_column(customer.schema.get_field_index("c_custkey"), "c_custkey", keys), f"{tmp_path}/customer.parquet")
    query = f"val_check_digit_{kind}"
    assert spark_rows(registry.QUERIES[query](spark, str(tmp_path))) == sql_rows(registry.ORACLE_SQL[query], str(tmp_path))
