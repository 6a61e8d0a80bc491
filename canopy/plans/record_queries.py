"""Registered parsers, edits and change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import parsers as P
from canopy.operators import edits, validation
from canopy.plans.materialise import folder
from canopy.sources.archive import evolve, logical
from canopy.streaming import changes

NOW, ACTOR = "2026-01-01T00:00:00Z", "bench"


def parse_json(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _work(o):
    """A bibliographic JSON record for every order."""
    return F.to_json(
        F.struct(
            F.col("o_orderpriority").alias("title"),
            F.concat(F.lit("https://doi.org/10.1234/"), "o_orderkey").alias("doi"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
            F.lit("journal-article").alias("type"),
            F.array(F.struct(F.concat(F.lit("A"), "o_custkey").alias("raw_author_name")), F.struct(F.lit("B").alias("raw_author_name"))).alias("authorships"),
            F.struct(F.lit("7").alias("volume"), F.col("o_orderkey").cast("string").alias("first_page"), (F.col("o_orderkey") + F.col("o_custkey") % 2).cast("string").alias("last_page")).alias("biblio"),
        )
    )


def parse_work(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    r = o.select("o_orderkey", P.reference_of_work(_work(o)).alias("r"))
    return r.select("o_orderkey", "r.author", "r.title", "r.issued", "r.page", "r.doi", "r.type")


def parse_bibtex(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    entry = F.concat(
        F.lit("@article{k"), F.col("o_orderkey"), F.lit(',\n  title = {On {T}rade '), F.col("o_orderpriority"), F.lit('},\n author="A'), F.col("o_custkey"), F.lit(' and B", year = '), F.date_format("o_orderdate", "yyyy"), F.lit(", month="), F.lower(F.date_format("o_orderdate", "MMM")), F.lit(",\n pages={1--9}, doi = {https://doi.org/10.1/x}}")
    )
    r = o.select("o_orderkey", P.parse_bibtex(entry).alias("r"))
    return r.select("o_orderkey", "r.type", "r.key", "r.title", "r.author", "r.issued", "r.page", "r.doi")


def parse_name(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    capital = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 100))
    name = F.concat(capital, F.when(F.col("p_partkey") % 3 == 0, " var. minor").otherwise(""), F.lit(" ("), F.lit("Old"), F.lit(", "), F.col("p_size") + 1750, F.lit(") New, 1900"), F.when(F.col("p_partkey") % 5 == 0, " ?? 12").otherwise(""))
    r = p.select("p_partkey", P.parse_name(name).alias("r"))
    return r.select("p_partkey", "r.canonical_simple", "r.cardinality", "r.marker", "r.basionym_authorship", "r.basionym_year", "r.combination_authorship", "r.combination_year", "r.tail", "r.quality")


def _edited(spark, sf_dir):
    """Customers as the current table, and a batch of changes derived from orders and customers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    current = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"), F.lit("2025").alias("modified"), F.lit("import").alias("modified_by"))
    key = F.col("c_custkey")
    op = F.when(key % 4 == 0, "update").when(key % 4 == 1, "delete").when(key % 4 == 2, "create").otherwise("update")
    batch = c.select(
        F.when(key % 8 == 2, key).when(key % 4 == 2, -key).when(key % 16 == 3, -key).otherwise(key).alias("id"),
        op.alias("op"),
        F.concat(F.lit("new "), "c_name").alias("name"),
        F.lit(None).cast("string").alias("status"),
        F.when(key % 12 == 0, "2024").when(key % 5 == 0, "").otherwise("2025").alias("expected"),
    )
    used = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return current, batch, used


def edit_outcomes(spark, sf_dir):
    current, batch, used = _edited(spark, sf_dir)
    return edits.check(current, batch, "id", used).groupBy("op", "outcome").agg(F.count("*").alias("n"))


def edit_snapshot(spark, sf_dir):
    current, batch, used = _edited(spark, sf_dir)
    store = edits.VersionedTable(spark, folder(spark, "edits"))
    store.write(current, 0)
    store.commit(batch, ACTOR, NOW, "id", used)
    return store.read()


_EDITS = """WITH used AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'),
  b AS (SELECT CASE WHEN c_custkey % 8 = 2 THEN c_custkey WHEN c_custkey % 4 = 2 THEN -c_custkey WHEN c_custkey % 16 = 3 THEN -c_custkey ELSE c_custkey END AS id,
          CASE c_custkey % 4 WHEN 1 THEN 'delete' WHEN 2 THEN 'create' ELSE 'update' END AS op, 'new ' || c_name AS name,
          CASE WHEN c_custkey % 12 = 0 THEN '2024' WHEN c_custkey % 5 = 0 THEN '' ELSE '2025' END AS expected FROM customer),
  k AS (SELECT b.*, CASE WHEN op = 'create' AND c_custkey IS NOT NULL THEN 'exists' WHEN op <> 'create' AND c_custkey IS NULL THEN 'missing'
          WHEN op <> 'create' AND expected = '2024' THEN 'conflict' WHEN op = 'delete' AND used.id IS NOT NULL THEN 'in_use' ELSE 'applied' END AS outcome
        FROM b LEFT JOIN customer ON c_custkey = b.id LEFT JOIN used ON used.id = b.id) """

_EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream_incremental_validate(spark, sf_dir):
    """Events arrive as a stream; each batch is validated as it comes."""
    rules = validation.load_rules(
        [
            {"rule_id": "value_range", "field": "value", "mechanism": "range", "params": {"least": 1, "most": 90}},
            {"rule_id": "type_short", "field": "event_type", "mechanism": "length", "params": {"most": 5}, "severity": "info"},
        ]
    )
    base = folder(spark, "stream")
    stream = changes.changes(spark, f"{sf_dir}/event[s].parquet", _EVENT)  # a pattern may match a file or a folder
    query = changes.validate_changes(stream, lambda batch: validation.row_local("event", batch, "event_id", rules), lambda batch: batch.select(F.lit("event").alias("table_name"), F.col("event_id").alias("record_id")), f"{base}/issues", f"{base}/checkpoint")
    query.awaitTermination()
    return changes.latest_violations(spark, f"{base}/issues", validation.VIOLATION).select("record_id", "rule_id", "severity")


def archive_columns(spark, sf_dir):
    """Customers as an older archive holds them, under the names and types of today."""
    old = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("rowid"), F.col("c_name").alias("col__name"), F.col("c_nationkey").cast("string").alias("col__nation"), F.col("c_mktsegment").alias("col__segment"))
    return evolve(logical(old, {"rowid": "id"}), "id string, name string, nation_id int, remarks string", {"nation": "nation_id"})


QUERIES = {
    "archive_columns": (archive_columns, "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS INTEGER) AS nation_id, CAST(NULL AS VARCHAR) AS remarks, c_mktsegment AS segment FROM customer"),
    "parse_json_source": (parse_json, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "parse_work": (
        parse_work,
        """SELECT o_orderkey, 'A' || o_custkey || '; B' AS author, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS issued,
           CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderkey || '–' || (o_orderkey + 1) END AS page, '10.1234/' || o_orderkey AS doi, 'JOURNAL_ARTICLE' AS type FROM orders""",
    ),
    "parse_bibtex": (
        parse_bibtex,
        "SELECT o_orderkey, 'ARTICLE' AS type, 'k' || o_orderkey AS key, 'On Trade ' || o_orderpriority AS title, 'A' || o_custkey || '; B' AS author, strftime(o_orderdate, '%Y-%m') AS issued, '1–9' AS page, '10.1/x' AS doi FROM orders",
    ),
    "parse_name": (
        parse_name,
        """SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) || CASE WHEN p_partkey % 3 = 0 THEN ' minor' ELSE '' END AS canonical_simple, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END AS cardinality,
           CASE WHEN p_partkey % 3 = 0 THEN 'var.' ELSE '' END AS marker, 'Old' AS basionym_authorship, CAST(p_size + 1750 AS VARCHAR) AS basionym_year, 'New' AS combination_authorship, '1900' AS combination_year,
           CASE WHEN p_partkey % 5 = 0 THEN '?? 12' ELSE '' END AS tail, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS quality FROM part""",
    ),
    "edit_outcomes": (edit_outcomes, _EDITS + "SELECT op, outcome, count(*) AS n FROM k GROUP BY ALL"),
    "edit_snapshot": (
        edit_snapshot,
        _EDITS
        + f"""SELECT c_custkey AS id, coalesce(k.name, c_name) AS name, c_mktsegment AS status, CASE WHEN k.id IS NULL THEN '2025' ELSE '{NOW}' END AS modified, CASE WHEN k.id IS NULL THEN 'import' ELSE '{ACTOR}' END AS modified_by
              FROM customer LEFT JOIN k ON k.id = c_custkey AND outcome = 'applied' WHERE coalesce(op, '') <> 'delete'
              UNION ALL SELECT id, name, NULL, '{NOW}', '{ACTOR}' FROM k WHERE outcome = 'applied' AND op = 'create'""",
    ),
    "stream_incremental_validate": (
        stream_incremental_validate,
        "SELECT CAST(event_id AS VARCHAR) AS record_id, 'value_range' AS rule_id, 'warn' AS severity FROM events WHERE value IS NULL OR value < 1 OR value > 90 UNION ALL SELECT CAST(event_id AS VARCHAR), 'type_short', 'info' FROM events WHERE length(event_type) > 5",
    ),
}
