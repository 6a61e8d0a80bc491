"""Registered validation queries; violations are planted by the same rule in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import scalars as X
from canopy.operators import hierarchy as H
from canopy.operators import validation as V
from canopy.plans.hierarchy_queries import WITH
from canopy.sources.archive import Archive

NOW = "2026-01-01T00:00:00Z"
#: Row-local rules of the part table.
PART_RULES = [
    {"rule_id": "brand_missing", "field": "brand", "mechanism": "presence", "severity": "error"},
    {"rule_id": "promo_has_brand", "field": "brand", "mechanism": "absence", "severity": "info", "when": "code = 'PROMO'"},
    {"rule_id": "one_word", "field": "name", "mechanism": "regex", "params": {"regex": r"^\S+$"}, "when": "size > 40"},
    {"rule_id": "name_length", "field": "name", "mechanism": "length", "params": {"least": 9, "most": 11}, "severity": "debug"},
    {"rule_id": "size_range", "field": "size_text", "mechanism": "range", "params": {"least": 5, "most": 45}},
]
PART = """part_rows AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 97 = 0 THEN '' ELSE p_brand END AS brand, p_type AS code, p_size AS size,
  CASE WHEN p_partkey % 89 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS size_text FROM part)"""
_FIRES = {
    "brand_missing": ("brand", "error", "brand = ''"),
    "promo_has_brand": ("brand", "info", "code = 'PROMO' AND brand <> ''"),
    "one_word": ("name", "warn", r"size > 40 AND NOT regexp_matches(name, '^\S+$')"),
    "name_length": ("name", "debug", "length(name) < 9 OR length(name) > 11"),
    "size_range": ("size_text", "warn", "try_cast(size_text AS DOUBLE) IS NULL OR try_cast(size_text AS DOUBLE) < 5 OR try_cast(size_text AS DOUBLE) > 45"),
}
_LOCAL = "local AS (" + " UNION ALL ".join(f"SELECT 'part' AS table_name, CAST(id AS VARCHAR) AS record_id, '{r}' AS rule_id, '{f}' AS field_name, '{s}' AS severity, {f} AS actual_value FROM part_rows WHERE {w}" for r, (f, s, w) in _FIRES.items()) + ")"
_RELATIONAL = """relational AS (
  SELECT 'part' AS table_name, CAST(p_partkey AS VARCHAR) AS record_id, 'duplicate_name' AS rule_id, 'p_name' AS field_name, 'info' AS severity, p_name AS actual_value FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)
  UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'uncited', 'o_orderkey', 'info', CAST(o_orderkey AS VARCHAR) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
  UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'customer_unknown', 'custkey', 'error', CAST(custkey AS VARCHAR) FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN -1 ELSE o_custkey END AS custkey FROM orders) o
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = custkey))"""
ALL = f"{PART}, {_LOCAL}, {_RELATIONAL}, found AS (SELECT * FROM local UNION ALL SELECT * FROM relational)"


def _parts(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 97 == 0, "").otherwise(F.col("p_brand")).alias("brand"),
        F.col("p_type").alias("code"),
        F.col("p_size").alias("size"),
        F.when(F.col("p_partkey") % 89 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("size_text"),
    )


def _local(spark, sf_dir, only: str | None = None):
    rules = V.load_rules([r for r in PART_RULES if only in (None, r["rule_id"])])
    return V.row_local("part", _parts(spark, sf_dir), "id", rules)


def _one(rule_id):
    return lambda spark, sf_dir: _local(spark, sf_dir, rule_id)


def _one_sql(rule_id):
    return f"WITH {PART}, {_LOCAL} SELECT * FROM local WHERE rule_id = '{rule_id}'"


def _tables(spark, sf_dir):
    return Archive.derive(spark, sf_dir)


def _orders(a):
    return a["orders"].withColumn("custkey", F.when(F.col("o_orderkey") % 101 == 0, F.lit(-1)).otherwise(F.col("o_custkey")))


def duplicate_name(spark, sf_dir):
    part = _tables(spark, sf_dir)["part"]
    return V.duplicates(part, ["p_name"]).select("p_partkey", "p_name", "others")


def foreign_key(spark, sf_dir):
    a = _tables(spark, sf_dir)
    return V.foreign_key(_orders(a), "custkey", a["customer"], "c_custkey").select("o_orderkey", "custkey")


def uncited(spark, sf_dir):
    a = _tables(spark, sf_dir)
    return V.uncited(a["orders"], "o_orderkey", [(a["lineitem"], "l_orderkey")]).select("o_orderkey")


def _found(spark, sf_dir):
    a = _tables(spark, sf_dir)
    out = _local(spark, sf_dir)
    out = out.unionByName(V.violation(V.duplicates(a["part"], ["p_name"]), "part", "p_partkey", "duplicate_name", "p_name", "info"))
    out = out.unionByName(V.violation(V.uncited(a["orders"], "o_orderkey", [(a["lineitem"], "l_orderkey")]), "orders", "o_orderkey", "uncited", "o_orderkey", "info"))
    return out.unionByName(V.violation(V.foreign_key(_orders(a), "custkey", a["customer"], "c_custkey"), "orders", "o_orderkey", "customer_unknown", "custkey", "error"))


def related(kind):
    def query(spark, sf_dir):
        a = _tables(spark, sf_dir)
        condition = {
            "equals": F.col("o_custkey") % 5 == F.col("c_nationkey") % 5,
            "not_equals": F.col("o_custkey") % 5 != F.col("c_nationkey") % 5,
            "in_set": F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"),
        }[kind]
        return V.related(a["orders"], "o_custkey", a["customer"], "c_custkey", condition, ["c_nationkey", "c_mktsegment"]).select("o_orderkey", "c_nationkey")

    return query


def _related_sql(where):
    return f"SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE {where}"


def ancestor_exists(spark, sf_dir):
    tree = _tables(spark, sf_dir)["tree"]
    accepted = tree.where("rank = 'REGION' and ordinal in (1, 2)")
    return V.ancestor_missing(tree.where("rank = 'CUSTOMER'"), H.closure(tree), accepted).select("id")


def ancestor_field_check(spark, sf_dir):
    tree = _tables(spark, sf_dir)["tree"].withColumn("year", F.lit(1700) + F.char_length("name") * 7 + F.coalesce("ordinal", F.lit(0)))
    marked = tree.where("rank in ('REGION', 'NATION')").select(F.col("id").alias("ancestor"), F.col("year").alias("top_year"))
    near = H.nearest_ancestor(H.closure(tree), marked)
    return tree.join(near, "id").where("year < top_year").select("id", "ancestor", "year", "top_year")


def check_digits(kind):
    def query(spark, sf_dir):
        c = _tables(spark, sf_dir)["customer"].select("c_custkey")
        width, ok = {"luhn": (10, X.luhn_ok), "isbn10": (10, X.isbn10_ok), "isbn13": (13, X.isbn13_ok), "issn": (8, X.issn_ok), "orcid": (16, X.orcid_ok)}[kind]
        # a code has its kind's width: of a longer number the first digits count
        code = F.lpad((F.col("c_custkey") * 7919 + 13).cast("string"), width, "0")
        return c.select("c_custkey", code.alias("code"), ok(code).alias("ok"))

    return query


def _digit_sql(kind):
    width = {"luhn": 10, "isbn10": 10, "isbn13": 13, "issn": 8, "orcid": 16}[kind]
    d = "CAST(substr(code, CAST(i AS INTEGER), 1) AS INTEGER)"
    total = {
        "luhn": f"list_sum([CASE WHEN i % 2 = 1 THEN ({d} * 2) // 10 + ({d} * 2) % 10 ELSE {d} END FOR i IN range(1, 11)]) % 10 = 0",
        "isbn10": f"list_sum([{d} * (11 - i) FOR i IN range(1, 11)]) % 11 = 0",
        "isbn13": f"list_sum([{d} * (1 + 2 * ((i - 1) % 2)) FOR i IN range(1, 14)]) % 10 = 0",
        "issn": f"list_sum([{d} * (9 - i) FOR i IN range(1, 9)]) % 11 = 0",
        "orcid": f"(12 - list_sum([{d} * CAST(pow(2, 16 - i) AS BIGINT) FOR i IN range(1, 16)]) % 11) % 11 = CAST(substr(code, 16, 1) AS INTEGER)",
    }[kind]
    return f"WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 13 AS VARCHAR), {width}, '0') AS code FROM customer) SELECT c_custkey, code, {total} AS ok FROM c"


def _store(found):
    """An earlier snapshot: some issues known and acknowledged, and some that no longer fire."""
    known = found.where(F.substring("record_id", -1, 1).isin("1", "2", "3"))
    old = known.select(*V.IDENTITY, F.lit("2025-06-01T00:00:00Z").alias("created_at"), F.when(F.substring("record_id", -1, 1) == "2", "2025-07-01T00:00:00Z").otherwise("").alias("acknowledged_at"))
    gone = known.where(F.char_length("record_id") == 2).select(F.lit("gone").alias("table_name"), "record_id", "rule_id", "field_name", F.lit("2025-06-01T00:00:00Z").alias("created_at"), F.lit("").alias("acknowledged_at"))
    return old.union(gone)


_MERGED = f"""WITH {ALL}, merged AS (SELECT table_name, record_id, rule_id, field_name, severity, actual_value,
  CASE WHEN right(record_id, 1) IN ('1', '2', '3') THEN '2025-06-01T00:00:00Z' ELSE '{NOW}' END AS created_at,
  CASE WHEN right(record_id, 1) = '2' THEN '2025-07-01T00:00:00Z' WHEN right(record_id, 1) IN ('1', '3') THEN '' END AS acknowledged_at FROM found) """


_CONFIG = """config AS (SELECT * FROM (VALUES ('brand_missing', 'part', true, 'error', 'error'), ('promo_has_brand', 'part', true, 'warn', 'info'), ('one_word', 'core', true, 'error', 'warn'),
  ('name_length', 'core', false, 'debug', 'debug'), ('size_range', 'core', true, 'warn', 'warn')) x(rule_id, ruleset, enabled, severity, default_severity))"""


def issue_merge(spark, sf_dir):
    found = _found(spark, sf_dir)
    return V.merge_issues(_store(found), found, NOW)


def issue_summary(spark, sf_dir):
    return V.issue_summary(_found(spark, sf_dir))


def issue_max_severity(spark, sf_dir):
    return V.record_summary(issue_merge(spark, sf_dir))


def issue_list(spark, sf_dir):
    return V.list_issues(issue_merge(spark, sf_dir), ["warn", "error"], offset=10, limit=40).select(*V.IDENTITY, "severity")


def rule_overrides(spark, sf_dir):
    rules = V.override(V.load_rules(PART_RULES), {"name_length": (False, None), "one_word": (True, "error")})
    return V.issue_summary(V.row_local("part", _parts(spark, sf_dir), "id", rules))


def _configured(spark):
    rules = spark.createDataFrame([(r.rule_id, "part" if r.field == "brand" else r.ruleset, r.severity) for r in V.load_rules(PART_RULES)], "rule_id string, ruleset string, severity string")
    kind = "rule_id string, enabled boolean, severity string"
    before = spark.createDataFrame([("one_word", True, "error"), ("size_range", False, None)], kind)
    changes = spark.createDataFrame([("name_length", False, None), ("size_range", None, None), ("brand_missing", True, "odd"), ("promo_has_brand", True, "warn")], kind)
    return V.list_config(rules, V.set_config(before, changes), spark.createDataFrame([("part", True), ("none", False)], "ruleset string, enabled boolean"))


def rule_config(spark, sf_dir):
    """Every rule as configured, with the number of its violations."""
    fired = V.row_local("part", _parts(spark, sf_dir), "id", V.load_rules(PART_RULES)).groupBy("rule_id").agg(F.count("*").alias("n"))
    return _configured(spark).join(fired, "rule_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def issue_warnings(spark, sf_dir):
    """Open warnings of all parts of code PROMO and of large ones."""
    ids = _parts(spark, sf_dir).where("code = 'PROMO' OR size > 40").select(F.col("id").cast("string").alias("record_id"))
    return V.warnings_of(issue_merge(spark, sf_dir), _configured(spark), "part", ids)


def incremental_neighbours(spark, sf_dir):
    part = _tables(spark, sf_dir)["part"].select("p_partkey", "p_name")
    before = part.where("p_partkey < 4")
    after = before.withColumn("p_name", F.concat(F.substring_index("p_name", " ", 1), F.lit(" anvil")))
    return V.neighbours(before.unionByName(after), part, "p_partkey", ["p_name"])


def time_rules_due(spark, sf_dir):
    state = _tables(spark, sf_dir)["orders"].select(F.col("o_orderkey").alias("rule"), F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("last_run_at"))
    return V.rules_due(state, "1998-01-08 00:00:00").select("rule")


QUERIES = {
    "val_presence": (_one("brand_missing"), _one_sql("brand_missing")),
    "val_absence": (_one("promo_has_brand"), _one_sql("promo_has_brand")),
    "val_regex": (_one("one_word"), _one_sql("one_word")),
    "val_length": (_one("name_length"), _one_sql("name_length")),
    "val_range": (_one("size_range"), _one_sql("size_range")),
    **{f"val_check_digit_{k}": (check_digits(k), _digit_sql(k)) for k in ("luhn", "isbn10", "isbn13", "issn", "orcid")},
    "val_related_equals": (related("equals"), _related_sql("o_custkey % 5 = c_nationkey % 5")),
    "val_related_not_equals": (related("not_equals"), _related_sql("o_custkey % 5 <> c_nationkey % 5")),
    "val_related_in_set": (related("in_set"), _related_sql("c_mktsegment IN ('BUILDING', 'HOUSEHOLD')")),
    "val_duplicate_name": (duplicate_name, "SELECT p_partkey, p_name, others FROM (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) - 1 AS others FROM part) WHERE others > 0"),
    "val_ancestor_exists": (ancestor_exists, WITH + "SELECT id FROM tree t WHERE rank = 'CUSTOMER' AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.id = t.id AND p.ancestor IN ('R1', 'R2'))"),
    "val_ancestor_field_check": (
        ancestor_field_check,
        WITH
        + """, y AS (SELECT *, CAST(1700 + length(name) * 7 + coalesce(ordinal, 0) AS INTEGER) AS year FROM tree),
        near AS (SELECT p.id, p.ancestor, y.year AS top_year FROM pairs p JOIN y ON y.id = p.ancestor WHERE y.rank IN ('REGION', 'NATION') QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY p.depth) = 1)
        SELECT y.id, near.ancestor, y.year, near.top_year FROM y JOIN near USING (id) WHERE y.year < near.top_year""",
    ),
    "val_foreign_key": (foreign_key, "SELECT o_orderkey, custkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN -1 ELSE o_custkey END AS custkey FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = custkey)"),
    "val_uncited_reference": (uncited, "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "val_reindex_all": (_found, f"WITH {ALL} SELECT * FROM found"),
    "issue_merge": (issue_merge, _MERGED + "SELECT * FROM merged"),
    "issue_summary": (issue_summary, f"WITH {ALL} SELECT table_name, rule_id, severity, count(*) AS n FROM found GROUP BY ALL"),
    "issue_max_severity": (
        issue_max_severity,
        _MERGED + "SELECT table_name, record_id, count(*) AS n, list_extract(['debug', 'info', 'warn', 'error'], max(list_position(['debug', 'info', 'warn', 'error'], severity))) AS max_severity FROM merged WHERE coalesce(acknowledged_at, '') = '' GROUP BY ALL",
    ),
    "issue_list": (
        issue_list,
        _MERGED
        + "SELECT table_name, record_id, rule_id, field_name, severity FROM merged WHERE severity IN ('warn', 'error') AND coalesce(acknowledged_at, '') = '' ORDER BY list_position(['debug', 'info', 'warn', 'error'], severity) DESC, rule_id, created_at DESC, table_name, record_id, field_name LIMIT 40 OFFSET 10",
    ),
    "rule_overrides": (rule_overrides, f"WITH {PART}, {_LOCAL} SELECT table_name, rule_id, CASE rule_id WHEN 'one_word' THEN 'error' ELSE severity END AS severity, count(*) AS n FROM local WHERE rule_id <> 'name_length' GROUP BY ALL"),
    "rule_config": (rule_config, f"WITH {PART}, {_LOCAL}, {_CONFIG} SELECT rule_id, ruleset, enabled, k.severity, default_severity, count(record_id) AS n FROM config k LEFT JOIN local USING (rule_id) GROUP BY ALL"),
    "issue_warnings": (
        issue_warnings,
        _MERGED
        + f""", {_CONFIG} SELECT table_name, record_id, rule_id, field_name, k.severity, actual_value FROM merged JOIN config k USING (rule_id)
           WHERE table_name = 'part' AND enabled AND coalesce(acknowledged_at, '') = '' AND record_id IN (SELECT CAST(id AS VARCHAR) FROM part_rows WHERE code = 'PROMO' OR size > 40)""",
    ),
    "incremental_neighbours": (
        incremental_neighbours,
        "WITH v AS (SELECT p_name FROM part WHERE p_partkey < 4 UNION SELECT split_part(p_name, ' ', 1) || ' anvil' FROM part WHERE p_partkey < 4) SELECT p_partkey FROM part WHERE p_name IN (SELECT p_name FROM v) UNION SELECT p_partkey FROM part WHERE p_partkey < 4",
    ),
    "time_rules_due": (time_rules_due, "SELECT o_orderkey AS rule FROM orders WHERE o_orderkey % 13 = 0 OR o_orderdate <= TIMESTAMP '1998-01-01 00:00:00'"),
}
