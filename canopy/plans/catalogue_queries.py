"""The whole rule catalogue over a collection that is derived from the star schema.

The relations come from one SQL text each, which Spark and the oracle share; what
fires in them is found by the rules here and told independently in SQL there.
"""

from __future__ import annotations

from canopy.operators import rules, validation

#: A collection's relations; violations of every rule are planted by key.
RELATIONS = {
    "name": """
        SELECT 'P' || p_partkey AS id, p_name AS canonical_simple,
          upper(substr(p_name, 1, 1)) || substr(p_name, 2) || CASE p_partkey % 4 WHEN 0 THEN ' var. minor' WHEN 1 THEN ' minor' ELSE '' END || CASE WHEN p_partkey % 41 = 0 THEN ' ?? 12' ELSE '' END AS scientific_name,
          CASE WHEN p_partkey % 23 = 0 THEN 'FAMILY' WHEN p_partkey % 4 = 0 THEN 'VARIETY' WHEN p_partkey % 4 = 1 THEN 'SUBSPECIES' ELSE 'SPECIES' END AS rank_id,
          CASE p_partkey % 3 WHEN 0 THEN 'ZOOLOGICAL' WHEN 1 THEN 'BOTANICAL' ELSE 'VIRUS' END AS code_id,
          CASE WHEN p_partkey % 19 = 0 THEN 'two words' WHEN p_partkey % 46 = 0 THEN 'Familidae' ELSE '' END AS uninomial,
          CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN 'genus' ELSE 'Genus' END AS genus,
          CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 31 = 0 THEN 'Epithet' WHEN p_partkey % 37 = 0 THEN 'a b' ELSE 'epithet' END AS specific_epithet,
          CASE WHEN p_partkey % 35 = 0 THEN 'Minor' WHEN p_partkey % 5 = 0 THEN 'minor' ELSE '' END AS infraspecific_epithet,
          CASE WHEN p_partkey % 43 = 0 THEN '1600' WHEN p_partkey % 47 = 0 THEN 'n/a' WHEN p_partkey % 53 = 0 THEN '' ELSE '1900' END AS published_in_year,
          CASE WHEN p_partkey % 59 = 0 THEN 'O-1' WHEN p_partkey % 3 = 0 THEN '' ELSE 'O' || (p_partkey % 5 + 1) || ', O7' END AS reference_id,
          CASE WHEN p_partkey % 59 = 1 THEN 0 WHEN p_partkey % 61 = 0 THEN 3 ELSE 1 END AS parse_quality,
          CASE WHEN p_partkey % 67 = 0 THEN '' ELSE 'A' || (p_partkey % 4) END AS basionym_authorship, '1850' AS basionym_authorship_year,
          'A' || (p_size % 4) AS combination_authorship, CASE WHEN p_partkey % 2 = 0 THEN '1850' ELSE '1860' END AS combination_authorship_year
        FROM {part}
        UNION ALL SELECT 'T' || id, label, 'Genus epithet', rank, 'ZOOLOGICAL', CASE WHEN rank IN ('FAMILY', 'ORDER', 'GENUS') THEN 'Uninomial' ELSE '' END,
          CASE WHEN rank IN ('SPECIES', 'SUBSPECIES') THEN 'Genus' ELSE '' END, CASE WHEN rank IN ('SPECIES', 'SUBSPECIES') THEN 'epithet' ELSE '' END, '', year, '', 1, '', '', '', ''
        FROM (
          SELECT 'R' || r_regionkey AS id, r_name AS label, 'FAMILY' AS rank, '' AS year FROM {region}
          UNION ALL SELECT 'N' || n_nationkey, n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'ORDER' ELSE 'GENUS' END, '18' || (10 + n_nationkey) FROM {nation}
          UNION ALL SELECT 'S' || s_suppkey, s_name, 'SPECIES', CASE WHEN s_suppkey % 3 = 0 THEN '1790' ELSE '1900' END FROM {supplier}
          UNION ALL SELECT 'C' || c_custkey, c_name, 'SUBSPECIES', '1950' FROM {customer}) AS t""",
    "taxon": """
        SELECT 'R' || r_regionkey AS id, CASE WHEN r_regionkey = 4 THEN 'S1' ELSE '' END AS parent_id, 'TR' || r_regionkey AS name_id FROM {region}
        UNION ALL SELECT 'N' || n_nationkey, CASE WHEN n_nationkey = 3 THEN 'R-1' ELSE 'R' || n_regionkey END, 'TN' || n_nationkey FROM {nation}
        UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'TS' || s_suppkey FROM {supplier}
        UNION ALL SELECT 'C' || c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'S' || (c_custkey % 5 + 1) ELSE 'N' || c_nationkey END, 'TC' || c_custkey FROM {customer}""",
    "reference": """
        SELECT 'O' || o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'A' END AS author,
          CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN '1901-05' ELSE '1900-05-01' END AS issued, '' AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'cited' END AS citation,
          CASE WHEN o_orderkey % 7 = 0 THEN 'bad' WHEN o_orderkey % 7 = 1 THEN '' ELSE '10.1234/' || o_orderkey END AS doi,
          CASE o_orderkey % 11 WHEN 0 THEN '978-0306406157' WHEN 1 THEN '9780306406158' WHEN 2 THEN '0306406152' WHEN 3 THEN '0306460152' ELSE '' END AS isbn,
          CASE o_orderkey % 13 WHEN 0 THEN '2049-3630' WHEN 1 THEN '2049-3603' ELSE '' END AS issn
        FROM {orders}""",
    "name_relation": """
        SELECT 'P' || s_suppkey AS name_id, 'P' || (s_suppkey % 7 + 1) AS related_name_id,
          CASE s_suppkey % 4 WHEN 0 THEN 'BASIONYM' WHEN 1 THEN 'REPLACEMENT_NAME' WHEN 2 THEN 'SPELLING_CORRECTION' ELSE 'HOMOTYPIC' END AS type_id FROM {supplier}""",
    "species_interaction": """
        SELECT l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_orderkey % 53 = 0 THEN '' ELSE l_returnflag END AS type_id,
          CASE WHEN l_partkey % 61 = 0 THEN '' WHEN l_partkey % 71 = 0 THEN 'S-1' ELSE 'S' || l_suppkey END AS related_taxon_id, CASE WHEN l_orderkey % 2 = 0 THEN 'by name' ELSE '' END AS related_taxon_scientific_name
        FROM {lineitem}""",
    "creator": """
        SELECT 'C' || c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN '0000-0002-1852-0097' WHEN c_custkey % 7 = 1 THEN '' ELSE '0000-0002-1825-0097' END AS orcid,
          CASE WHEN c_custkey % 11 = 0 THEN '@BAD' WHEN c_custkey % 11 = 1 THEN '' ELSE '@GOOD' END AS rorid, CASE WHEN c_custkey % 13 = 0 THEN 'no address' WHEN c_custkey % 13 = 1 THEN '' ELSE 'a@b.org' END AS email
        FROM {customer}""",
}
#: The other roles have every fourth customer each, with their own places of the faults.
for _k, _role in enumerate(["contact", "contributor", "editor", "publisher"]):
    RELATIONS[_role] = f"""
        SELECT 'C' || c_custkey AS id, CASE WHEN c_custkey % 5 = {_k} THEN '0000-0002-1825-009X' WHEN c_custkey % 5 = 4 THEN '' ELSE 'https://orcid.org/0000-0002-1825-0097' END AS orcid,
          CASE WHEN c_custkey % 9 = {_k} THEN '@BAD' WHEN c_custkey % 9 = 8 THEN '' ELSE 'https://ror.org/@GOOD' END AS rorid, CASE WHEN c_custkey % 11 = {_k} THEN 'a@b' WHEN c_custkey % 11 = 10 THEN '' ELSE 'first.last@b.co.uk' END AS email
        FROM {{customer}} WHERE c_custkey % 4 = {_k}"""
TABLES = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem"]

_LOCAL = [
    ("name", "wrong_monomial_case_uninomial", "uninomial", "warn", "uninomial = 'two words'"),
    ("name", "wrong_monomial_case_genus", "genus", "warn", "genus = 'genus'"),
    ("name", "uppercase_epithet_specific_epithet", "specific_epithet", "warn", "specific_epithet = 'Epithet'"),
    ("name", "uppercase_epithet_infraspecific_epithet", "infraspecific_epithet", "warn", "infraspecific_epithet = 'Minor'"),
    ("name", "multi_word_uninomial", "uninomial", "warn", "contains(uninomial, ' ')"),
    ("name", "multi_word_specific_epithet", "specific_epithet", "warn", "contains(specific_epithet, ' ')"),
    ("name", "missing_genus", "genus", "warn", "genus = '' AND specific_epithet <> ''"),
    ("name", "infraspecific_needs_specific", "specific_epithet", "warn", "specific_epithet = '' AND infraspecific_epithet <> ''"),
    ("name", "species_rank_needs_specific", "specific_epithet", "warn", "specific_epithet = '' AND rank_id IN ('SPECIES', 'SUBSPECIES', 'VARIETY')"),
    ("name", "suprageneric_needs_uninomial", "uninomial", "warn", "uninomial = '' AND rank_id IN ('FAMILY', 'ORDER')"),
    ("name", "specific_epithet_on_suprageneric", "specific_epithet", "warn", "specific_epithet <> '' AND rank_id IN ('FAMILY', 'ORDER')"),
    ("name", "unlikely_year", "published_in_year", "warn", "published_in_year IN ('1600', 'n/a')"),
    ("name", "parse_failed", "parse_quality", "error", "parse_quality = 0"),
    ("name", "parse_warnings", "parse_quality", "warn", "parse_quality > 1"),
    ("name", "parse_tail", "scientific_name", "warn", "contains(scientific_name, '??')"),
    ("name", "infraspecific_marker_missing", "scientific_name", "warn", "code_id <> 'VIRUS' AND ((rank_id = 'SUBSPECIES' AND code_id <> 'ZOOLOGICAL') OR (rank_id = 'VARIETY' AND NOT contains(scientific_name, ' var. ')))"),
    ("name", "combination_matches_basionym", "combination_authorship", "warn", "basionym_authorship <> '' AND basionym_authorship = combination_authorship AND basionym_authorship_year = combination_authorship_year"),
    ("reference", "doi_invalid", "doi", "warn", "doi = 'bad'"),
    ("reference", "isbn_check_digit", "isbn", "warn", "isbn IN ('9780306406158', '0306460152')"),
    ("reference", "issn_check_digit", "issn", "warn", "issn = '2049-3603'"),
    ("reference", "reference_missing_structured_metadata", "citation", "warn", "citation <> '' AND (author = '' OR issued = '')"),
    ("species_interaction", "interaction_needs_type", "type_id", "error", "type_id = ''"),
    ("species_interaction", "interaction_needs_related", "related_taxon_id", "error", "related_taxon_id = '' AND related_taxon_scientific_name = ''"),
    ("species_interaction", "interaction_related_taxon_exists", "related_taxon_id", "error", "related_taxon_id = 'S-1'"),
    ("creator", "creator_orcid_check_digit", "orcid", "warn", "orcid = '0000-0002-1852-0097'"),
    ("creator", "creator_rorid_check_digit", "rorid", "warn", "rorid = '@BAD'"),
    ("creator", "creator_email_format", "email", "warn", "email = 'no address'"),
    *[
        (role, f"{role}_{rule}", field, "warn", where)
        for role in ("contact", "contributor", "editor", "publisher")
        for rule, field, where in (("orcid_check_digit", "orcid", "orcid = '0000-0002-1825-009X'"), ("rorid_check_digit", "rorid", "rorid = '@BAD'"), ("email_format", "email", "email = 'a@b'"))
    ],
    ("reference", "reference_uncited", "id", "info", "id NOT IN (SELECT trim(unnest(string_split(reference_id, ','))) FROM name)"),
    ("name", "duplicate_name", "canonical_simple", "info", "canonical_simple IN (SELECT canonical_simple FROM name GROUP BY canonical_simple HAVING count(*) > 1)"),
    ("name", "reference_id_invalid", "reference_id", "error", "reference_id <> '' AND split_part(reference_id, ',', 1) NOT IN (SELECT id FROM reference)"),
    ("name", "source_year_mismatch", "published_in_year", "warn", "published_in_year <> '' AND EXISTS (SELECT 1 FROM reference r WHERE r.id = split_part(reference_id, ',', 1) AND r.issued <> '' AND substr(r.issued, 1, 4) <> published_in_year)"),
]
_SHARED = {"BASIONYM": "subsequent_combination_shares_reference", "REPLACEMENT_NAME": "replacement_name_shares_reference", "SPELLING_CORRECTION": "spelling_correction_shares_reference"}


def _oracle() -> str:
    good, bad = RORIDS
    ctes = ", ".join(f"{name} AS ({sql.format(**{t: t for t in TABLES}).replace('@GOOD', good).replace('@BAD', bad)})" for name, sql in RELATIONS.items())
    local = [f"SELECT '{t}' AS table_name, id AS record_id, '{r}' AS rule_id, '{f}' AS field_name, '{s}' AS severity, CAST({f} AS VARCHAR) AS actual_value FROM {t} WHERE {w}" for t, r, f, s, w in _LOCAL]
    local = [x.replace("@BAD", bad) for x in local]
    local.append("SELECT 'name_relation', name_id, 'name_on_self_relation', 'related_name_id', 'error', related_name_id FROM name_relation WHERE name_id = related_name_id")
    for kind, rule in _SHARED.items():
        local.append(
            f"SELECT DISTINCT 'name', a.id, '{rule}', 'reference_id', 'warn', split_part(a.reference_id, ',', 1) FROM name_relation JOIN name a ON a.id = name_id JOIN name b ON b.id = related_name_id WHERE type_id = '{kind}' AND a.id <> b.id AND a.reference_id <> '' AND split_part(a.reference_id, ',', 1) = split_part(b.reference_id, ',', 1)"
        )
    tree = """up AS (SELECT t.id, t.parent_id, n.rank_id AS rank, n.published_in_year AS year FROM taxon t LEFT JOIN name n ON n.id = t.name_id),
        walk AS (SELECT id, parent_id AS far, 1 AS depth FROM taxon WHERE parent_id <> '' UNION ALL SELECT w.id, t.parent_id, w.depth + 1 FROM walk w JOIN taxon t ON t.id = w.far WHERE t.parent_id <> '' AND w.depth < 12),
        cyc AS (SELECT DISTINCT id FROM walk WHERE far = id),
        anc AS (SELECT DISTINCT w.id, u.id AS top, u.rank, u.year, min(w.depth) OVER (PARTITION BY w.id, u.id) AS depth FROM walk w JOIN up u ON u.id = w.far WHERE w.id <> w.far),
        near AS (SELECT id, year FROM anc WHERE rank = 'GENUS' QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth) = 1)"""
    place = "SELECT 'taxon', {id}, '{rule}', '{field}', '{severity}', {field} FROM {rows}"
    put = lambda rule, rows, field="parent_id", severity="warn", id_="u.id": local.append(place.format(id=id_, rule=rule, field="u." + field, severity=severity, rows=rows).replace(f"'u.{field}'", f"'{field}'"))
    put("parent_genus_missing", "up u WHERE rank = 'SPECIES' AND NOT EXISTS (SELECT 1 FROM anc a WHERE a.id = u.id AND a.rank = 'GENUS')")
    put("parent_species_missing", "up u WHERE rank = 'SUBSPECIES' AND NOT EXISTS (SELECT 1 FROM anc a WHERE a.id = u.id AND a.rank = 'SPECIES')")
    order = "['ORDER', 'FAMILY', 'GENUS', 'SPECIES', 'SUBSPECIES']"
    put("classification_rank_order_invalid", f"up u JOIN up p ON p.id = u.parent_id WHERE list_position({order}, p.rank) >= list_position({order}, u.rank)")
    put("published_before_genus", "up u JOIN near USING (id) WHERE u.rank = 'SPECIES' AND CAST(u.year AS INTEGER) < CAST(near.year AS INTEGER)", "year")
    put("probable_incertae_sedis", "up u JOIN up p ON p.id = u.parent_id WHERE u.rank = 'SPECIES' AND p.rank <> 'GENUS'", severity="info")
    put("taxon_parent_exists", "up u WHERE u.parent_id <> '' AND u.parent_id NOT IN (SELECT id FROM taxon)", severity="error")
    put("taxon_parent_cycle", "up u JOIN cyc USING (id)", severity="error")
    return f"WITH RECURSIVE {ctes}, {tree} " + " UNION ALL ".join(local)


#: A valid and an invalid identifier of an organisation.
RORIDS = ("05dxps055", "05dxps054")


def collection(spark, sf_dir):
    """The derived relations as DataFrames."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return {name: spark.sql(sql.replace("@GOOD", RORIDS[0]).replace("@BAD", RORIDS[1]), **{t: tables[t] for t in TABLES if "{" + t + "}" in sql}) for name, sql in RELATIONS.items()}


def reindex(spark, sf_dir):
    """Every rule of the catalogue over all relations."""
    return rules.reindex(collection(spark, sf_dir))


def _rows(relation, made, *wanted):
    """A query of some row-local rules of one relation."""

    def query(spark, sf_dir):
        some = [r for r in made() if r.rule_id in wanted]
        return validation.row_local(relation, collection(spark, sf_dir)[relation], "id", some)

    return query, _some(*wanted)


def parent_rank(spark, sf_dir):
    tables = collection(spark, sf_dir)
    return rules.taxon_violations(tables["taxon"], tables["name"]).where("rule_id = 'classification_rank_order_invalid'")


def stale_metadata(spark, sf_dir):
    """Orders as metadata records that were last touched on their day, some never or at no time that can be read."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    touched = orders.where("o_orderkey % 13 <> 0").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 17 = 0 THEN 'some day' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS touched_at")
    return rules.stale(orders.selectExpr("o_orderkey AS id"), touched, "1998-06-01 00:00:00")


def _some(*wanted):
    return f"SELECT * FROM ({_oracle()}) WHERE rule_id IN ({', '.join(map(repr, wanted))})"


QUERIES = {
    "rules_reindex": (reindex, _oracle()),
    "rules_stale_metadata": (
        stale_metadata,
        """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'some day' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS touched_at FROM orders)
           SELECT 'metadata' AS table_name, CAST(id AS VARCHAR) AS record_id, 'stale_metadata' AS rule_id, 'touched_at' AS field_name, 'info' AS severity, coalesce(touched_at, '') AS actual_value
           FROM t WHERE touched_at IS NULL OR touched_at = 'some day' OR touched_at < '1997-06-01'""",
    ),
    "val_parent_rank": (parent_rank, _some("classification_rank_order_invalid")),
    "val_combination_basionym": _rows("name", rules.name_rules, "combination_matches_basionym"),
    "val_marker_missing": _rows("name", rules.name_rules, "infraspecific_marker_missing"),
    "val_reference_metadata": _rows("reference", rules.reference_rules, "reference_missing_structured_metadata"),
    "val_interaction_needs": _rows("species_interaction", rules.interaction_rules, "interaction_needs_type", "interaction_needs_related"),
}
