"""Registered queries of versions over several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators.versions import Versions
from canopy.sources import shared

LINKS = [("taxon", "name_id", "name"), ("relation", "name_id", "name"), ("relation", "related_id", "name")]
#: Tables and edits from the suppliers, by SQL that Spark and the oracle share.
TABLES = {
    "name": "SELECT 'n' || s_suppkey AS id, s_name AS label, 'v1' AS modified, 'load' AS modified_by FROM {supplier}",
    "taxon": "SELECT 't' || s_suppkey AS id, 'n' || s_suppkey AS name_id, 'v1' AS modified, 'load' AS modified_by FROM {supplier}",
    "relation": "SELECT 'base' AS id, 'n3' AS name_id, 'n3' AS related_id, 'v1' AS modified, 'load' AS modified_by FROM {supplier} WHERE s_suppkey = 3",
}
#: Of four suppliers one gets a new name with a relation to the old one (every second of them by an old stamp), one loses a name in use, one goes with its name, one gets a taxon without a name.
EDITS = {
    "name": """SELECT 'e' || s_suppkey AS edit, 'create' AS op, 'm' || s_suppkey AS id, upper(s_name) AS label, '' AS expected FROM {supplier} WHERE s_suppkey % 4 = 0
        UNION ALL SELECT 'e' || s_suppkey, 'delete', 'n' || s_suppkey, CAST(NULL AS {string}), 'v1' FROM {supplier} WHERE s_suppkey % 4 IN (1, 2)""",
    "taxon": """SELECT 'e' || s_suppkey AS edit, 'update' AS op, 't' || s_suppkey AS id, 'm' || s_suppkey AS name_id, CASE WHEN s_suppkey % 8 = 0 THEN 'v0' ELSE 'v1' END AS expected FROM {supplier} WHERE s_suppkey % 4 = 0
        UNION ALL SELECT 'e' || s_suppkey, 'delete', 't' || s_suppkey, CAST(NULL AS {string}), 'v1' FROM {supplier} WHERE s_suppkey % 4 = 2
        UNION ALL SELECT 'e' || s_suppkey, 'create', 'u' || s_suppkey, 'nowhere', '' FROM {supplier} WHERE s_suppkey % 4 = 3""",
    "relation": "SELECT 'e' || s_suppkey AS edit, 'create' AS op, 'r' || s_suppkey AS id, 'm' || s_suppkey AS name_id, 'n' || s_suppkey AS related_id, '' AS expected FROM {supplier} WHERE s_suppkey % 4 = 0",
}


def compound(spark, sf_dir):
    """Outcomes of a batch of edits over three tables, and the tables as the next version has them."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    sql = lambda text: spark.sql(text.replace("{string}", "STRING"), supplier=supplier)
    store = Versions(spark, shared.folder(spark, "versions"), LINKS)
    store.create({t: sql(text) for t, text in TABLES.items()})
    outcomes = store.commit({t: sql(text) for t, text in EDITS.items()}, "me", "v2")
    rows = store.read()
    value = {"name": "label", "taxon": "name_id", "relation": "related_id"}
    out = None
    for t in TABLES:
        told = outcomes[t].select(F.lit("outcome").alias("kind"), F.lit(t).alias("table_name"), "id", F.col("outcome").alias("value"), F.col("expected").alias("stamp"))
        told = told.unionByName(rows[t].select(F.lit("row").alias("kind"), F.lit(t).alias("table_name"), "id", F.col(value[t]).alias("value"), F.concat_ws(" ", "modified", "modified_by").alias("stamp")))
        out = told if out is None else out.unionByName(told)
    return out


def _oracle():
    ctes = [f"{t} AS ({text.format(supplier='supplier')})" for t, text in TABLES.items()]
    ctes += [f"e_{t} AS ({text.format(supplier='supplier', string='VARCHAR')})" for t, text in EDITS.items()]
    why = "CASE CAST(substr(edit, 2) AS INTEGER) % 4 WHEN 0 THEN CASE WHEN CAST(substr(edit, 2) AS INTEGER) % 8 = 0 THEN {late} ELSE 'applied' END WHEN 1 THEN 'in_use' WHEN 2 THEN 'applied' ELSE 'dangling' END"
    parts = []
    for t, value in (("name", "label"), ("taxon", "name_id"), ("relation", "related_id")):
        outcome = why.format(late="'conflict'" if t == "taxon" else "'incomplete'")
        parts.append(f"SELECT 'outcome' AS kind, '{t}' AS table_name, id, {outcome} AS value, expected AS stamp FROM e_{t}")
        good = f"(SELECT * FROM e_{t} WHERE {outcome} = 'applied')"
        parts.append(f"SELECT 'row', '{t}', id, {value}, modified || ' ' || modified_by FROM {t} WHERE id NOT IN (SELECT id FROM {good} g)")
        parts.append(f"SELECT 'row', '{t}', id, {value}, 'v2 me' FROM {good} g WHERE op <> 'delete'")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(parts)


QUERIES = {"edit_compound": (compound, _oracle())}
