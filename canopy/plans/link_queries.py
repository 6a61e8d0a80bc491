"""Registered edits of synonyms, relations and agents over rows of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import links

NOW, ACTOR = "2026-01-01T00:00:00Z", "bench"
#: Derived tables, each one SQL text that Spark and the oracle share.
TABLES = {
    "synonym": "SELECT 'Y' || s_suppkey AS id, 'T' || (s_suppkey % 40) AS taxon_id, 'P' || s_suppkey AS name_id, 'SYNONYM' AS status_id, '2025' AS modified, 'import' AS modified_by FROM {supplier} UNION ALL SELECT 'Y' || s_suppkey, 'T' || (s_suppkey % 40 + 1), 'P' || s_suppkey, 'SYNONYM', '2025', 'import' FROM {supplier} WHERE s_suppkey % 3 = 0",
    "synonym_change": """
        SELECT CASE c_custkey % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'move' WHEN 2 THEN 'remove' ELSE 'extend' END AS op,
          CASE WHEN c_custkey % 25 = 0 THEN 'N' || c_custkey WHEN c_custkey % 25 = 5 THEN 'T' || c_custkey WHEN c_custkey % 35 = 1 THEN '' ELSE 'Y' || c_custkey END AS id,
          CASE WHEN c_custkey % 10 = 2 THEN '' WHEN c_custkey % 11 = 0 THEN CAST(NULL AS STRING) WHEN c_custkey % 25 = 5 THEN 'T' || c_custkey WHEN c_custkey % 4 = 3 THEN 'T' || (c_custkey % 40) ELSE 'T9' END AS taxon_id,
          'P' || c_custkey AS name_id, 'SYNONYM' AS status_id FROM {customer}""",
    "relation": "SELECT DISTINCT 'P' || l_partkey AS name_id, 'P' || (l_suppkey + 1) AS related_id, l_returnflag AS type, '2025' AS modified, 'import' AS modified_by FROM {lineitem} WHERE l_partkey <> l_suppkey + 1",
    "relation_change": "SELECT CASE p_partkey % 3 WHEN 0 THEN 'link' ELSE 'unlink' END AS op, 'P' || p_partkey AS name_id, CASE WHEN p_partkey % 21 = 0 THEN 'P' || p_partkey ELSE 'P1' END AS related_id, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' ELSE '' END AS type FROM {part}",
    "name": "SELECT 'P' || p_partkey AS id, p_name AS canonical FROM {part}",
    "taxon": "SELECT 'T' || p_partkey AS id, 'P' || p_partkey AS name_id FROM {part} WHERE p_partkey % 2 = 0",
    "used": "SELECT 'P' || s_suppkey AS name_id, 'P' || (s_suppkey + 1) AS related_id FROM {supplier} WHERE s_suppkey % 7 = 0",
    "agent": "SELECT CASE s_suppkey % 3 WHEN 0 THEN 'creator' WHEN 1 THEN 'contact' ELSE 'publisher' END AS role, CAST(s_suppkey AS INT) AS id, CASE WHEN s_suppkey % 3 = 2 THEN '' ELSE 'G' END AS given, CASE WHEN s_suppkey % 3 = 2 THEN '' ELSE s_name END AS family, CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 1 THEN 'a@b.org' ELSE '' END AS email, 'n' AS note, 'K' AS country FROM {supplier}",
    "agent_change": """
        SELECT CAST(s_suppkey AS INT) AS seq, CASE s_suppkey % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' WHEN 3 THEN 'copy' ELSE 'move' END AS op,
          CASE WHEN s_suppkey % 31 = 0 THEN 'boss' WHEN s_suppkey % 3 = 0 THEN 'creator' WHEN s_suppkey % 3 = 1 THEN 'contact' ELSE 'publisher' END AS role,
          CASE WHEN s_suppkey % 17 = 1 THEN -1 WHEN s_suppkey % 5 = 0 THEN CAST(NULL AS INT) ELSE CAST(s_suppkey AS INT) END AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'contact' ELSE 'creator' END AS to_role, s_suppkey % 4 = 0 AS keep_note,
          CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'New' END AS given, 'F' || s_suppkey AS family, CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE 'c@d.org' END AS email, 'new' AS note FROM {supplier}""",
}
BASE = ["supplier", "customer", "lineitem", "part"]


def _tables(spark, sf_dir, *names):
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}
    return [spark.sql(TABLES[n], **{t: base[t] for t in BASE if "{" + t + "}" in TABLES[n]}) for n in names]


def _with(*names):
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n].format(**{t: t for t in BASE}).replace('AS STRING', 'AS VARCHAR')})" for n in names) + ", "


def synonyms(spark, sf_dir):
    now, changes = _tables(spark, sf_dir, "synonym", "synonym_change")
    return links.apply_synonyms(now, links.check_synonyms(now, changes), ACTOR, NOW)


def synonym_outcomes(spark, sf_dir):
    return links.check_synonyms(*_tables(spark, sf_dir, "synonym", "synonym_change")).select("op", "id", "taxon_id", "outcome")


def synonym_removal(spark, sf_dir):
    """Names that are left when the synonyms of every third name go."""
    synonym, name, taxon, used = _tables(spark, sf_dir, "synonym", "name", "taxon", "used")
    ids = synonym.where(F.substring("id", 2, 20).cast("int") % 3 == 0).select("id")
    return links.remove_synonyms(synonym, name, taxon, used, ids)[1]


def relations(spark, sf_dir):
    now, changes = _tables(spark, sf_dir, "relation", "relation_change")
    return links.edit_relations(now, changes, ACTOR, NOW)[0]


def agents(spark, sf_dir):
    return links.edit_agents(*_tables(spark, sf_dir, "agent", "agent_change"))[0]


def agent_outcomes(spark, sf_dir):
    return links.edit_agents(*_tables(spark, sf_dir, "agent", "agent_change"))[1].select("seq", "op", "outcome", "new_id")


_SYNONYM = (
    _with("synonym", "synonym_change")
    + """g AS (SELECT *, coalesce(id, '') AS i, coalesce(taxon_id, '') AS t FROM synonym_change),
    n AS (SELECT *, count(*) OVER (PARTITION BY i) > 1 AND max(CASE WHEN op IN ('move', 'remove') THEN 1 ELSE 0 END) OVER (PARTITION BY i) = 1 AS mixed, count(*) OVER (PARTITION BY i, t) > 1 AS twice FROM g),
    k AS (SELECT op, id, taxon_id, name_id, status_id, CASE WHEN i = '' OR (op <> 'remove' AND t = '') THEN 'incomplete' WHEN op <> 'remove' AND i = t THEN 'self' WHEN mixed OR twice THEN 'repeated'
      WHEN op = 'add' AND i IN (SELECT id FROM synonym) THEN 'exists' WHEN op <> 'add' AND i NOT IN (SELECT id FROM synonym) THEN 'missing'
      WHEN op = 'remove' AND t <> '' AND (i, t) NOT IN (SELECT (id, taxon_id) FROM synonym) THEN 'missing' WHEN op = 'extend' AND (i, t) IN (SELECT (id, taxon_id) FROM synonym) THEN 'unchanged' ELSE 'applied' END AS outcome FROM n),
    a AS (SELECT * FROM k WHERE outcome = 'applied') """
)
_AGENT = (
    _with("agent", "agent_change")
    + """j AS (SELECT c.*, a.id IS NOT NULL AS there, a.given AS og, a.family AS fo, a.email AS oe, a.note AS note_old, a.country AS oc, CASE WHEN c.op IN ('copy', 'move') THEN c.to_role ELSE c.role END AS target,
        count(*) FILTER (c.op IN ('update', 'delete', 'move')) OVER (PARTITION BY c.role, c.id) > 1 AS bad FROM agent_change c LEFT JOIN agent a ON a.role = c.role AND a.id = c.id),
    v AS (SELECT *, CASE WHEN op IN ('copy', 'move') THEN og ELSE given END AS vg, CASE WHEN op IN ('copy', 'move') THEN fo ELSE family END AS vf, CASE WHEN op IN ('copy', 'move') THEN oe ELSE email END AS ve FROM j),
    k AS (SELECT *, CASE WHEN role = 'boss' THEN 'role' WHEN op <> 'create' AND id IS NULL THEN 'incomplete' WHEN op = 'move' AND role = to_role THEN 'self' WHEN op IN ('update', 'delete', 'move') AND bad THEN 'repeated'
      WHEN op <> 'create' AND NOT there THEN 'missing' WHEN op <> 'delete' AND ((target <> 'publisher' AND (vg = '' OR vf = '')) OR (target = 'contact' AND ve = '')) THEN 'incomplete' ELSE 'applied' END AS outcome FROM v),
    m AS (SELECT *, (SELECT max(id) FROM agent WHERE agent.role = target) + row_number() OVER (PARTITION BY target ORDER BY seq) AS new_id FROM k WHERE outcome = 'applied' AND op IN ('create', 'copy', 'move')) """
)
_COLUMNS = "id, taxon_id, name_id, status_id, modified, modified_by"

QUERIES = {
    "edit_synonyms": (
        synonyms,
        _SYNONYM
        + f"""SELECT {_COLUMNS} FROM synonym s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = s.id AND op IN ('move', 'remove') AND (op = 'move' OR coalesce(a.taxon_id, '') IN ('', s.taxon_id)))
        UNION ALL SELECT DISTINCT s.id, a.taxon_id, s.name_id, s.status_id, '{NOW}', '{ACTOR}' FROM synonym s JOIN a ON a.id = s.id AND op = 'move'
        UNION ALL SELECT id, taxon_id, name_id, status_id, '{NOW}', '{ACTOR}' FROM a WHERE op = 'add'
        UNION ALL SELECT a.id, a.taxon_id, s.name_id, s.status_id, '{NOW}', '{ACTOR}' FROM a JOIN (SELECT id, arg_min(name_id, taxon_id) AS name_id, arg_min(status_id, taxon_id) AS status_id FROM synonym GROUP BY id) s ON s.id = a.id WHERE op = 'extend'""",
    ),
    "edit_synonym_outcomes": (synonym_outcomes, _SYNONYM + "SELECT op, id, taxon_id, outcome FROM k"),
    "edit_synonym_removal": (
        synonym_removal,
        _with("synonym", "name", "taxon", "used").rstrip(", ")
        + """ SELECT id, canonical FROM name WHERE NOT (id IN (SELECT name_id FROM synonym WHERE CAST(substr(id, 2) AS INTEGER) % 3 = 0) AND id NOT IN (SELECT name_id FROM synonym WHERE CAST(substr(id, 2) AS INTEGER) % 3 <> 0)
            AND id NOT IN (SELECT name_id FROM taxon) AND id NOT IN (SELECT name_id FROM used) AND id NOT IN (SELECT related_id FROM used))""",
    ),
    "edit_relations": (
        relations,
        _with("relation", "relation_change").rstrip(", ")
        + f""" SELECT * FROM relation r WHERE NOT EXISTS (SELECT 1 FROM relation_change c WHERE op = 'unlink' AND c.name_id = r.name_id AND c.related_id = r.related_id AND c.type = r.type)
            UNION ALL SELECT name_id, related_id, type, '{NOW}', '{ACTOR}' FROM relation_change WHERE op = 'link' AND type <> '' AND name_id <> related_id AND (name_id, related_id, type) NOT IN (SELECT (name_id, related_id, type) FROM relation)""",
    ),
    "edit_agents": (
        agents,
        _AGENT
        + """SELECT * FROM agent WHERE (role, id) NOT IN (SELECT (role, id) FROM k WHERE outcome = 'applied' AND op IN ('delete', 'move', 'update'))
        UNION ALL SELECT role, id, given, family, email, note, oc FROM k WHERE outcome = 'applied' AND op = 'update'
        UNION ALL SELECT target, new_id, vg, vf, ve, CASE WHEN op = 'create' THEN note WHEN keep_note THEN note_old ELSE '' END, CASE WHEN op <> 'create' THEN oc END FROM m""",
    ),
    "edit_agent_outcomes": (agent_outcomes, _AGENT + "SELECT k.seq, k.op, k.outcome, m.new_id FROM k LEFT JOIN m ON m.seq = k.seq"),
}
