"""Rule-based validation of whole tables.

A rule is data: what it checks, where, how severe it is.  Row-local rules of one
table are packed into one array column and evaluated in a single scan;
relational rules are joins or windows.  Both give violation rows (table_name,
record_id, rule_id, field_name, severity, actual_value), which are merged into
an issue store that keeps first-seen times and acknowledgements.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.scalars import empty, severity_name, severity_rank, text

IDENTITY = ["table_name", "record_id", "rule_id", "field_name"]
VIOLATION = "table_name string, record_id string, rule_id string, field_name string, severity string, actual_value string"


@dataclass(frozen=True)
class Rule:
    """A row-local rule: it fires where ``when`` holds and ``fails`` holds."""

    rule_id: str
    field: str
    fails: Column
    severity: str = "warn"
    when: Column | None = None
    ruleset: str = "core"


# Mechanisms: each gives the failing condition of a column.
def presence(field: str) -> Column:
    return empty(F.col(field))


def absence(field: str) -> Column:
    return ~empty(F.col(field))


def pattern(field: str, regex: str) -> Column:
    """Fails where a value doesn't match."""
    return ~text(F.col(field)).rlike(regex)


def length(field: str, least: int = 0, most: int | None = None) -> Column:
    n = F.char_length(text(F.col(field)))
    return (n < least) | ((n > most) if most is not None else F.lit(False))


def number_range(field: str, least: float, most: float) -> Column:
    """Fails where a number is out of range or the text isn't a number."""
    n = F.expr(f"try_cast(`{field}` AS double)")
    return n.isNull() | (n < least) | (n > most)


#: Mechanisms by name; more can be registered.
MECHANISMS: dict[str, Callable[..., Column]] = {"presence": presence, "absence": absence, "regex": pattern, "length": length, "range": number_range}


def load_rules(bundle: list[dict]) -> list[Rule]:
    """Rules from plain data: rule_id, field, mechanism, params, severity, when (SQL), ruleset."""
    made = []
    for r in bundle:
        fails = MECHANISMS[r["mechanism"]](r["field"], **r.get("params", {}))
        made.append(Rule(r["rule_id"], r["field"], fails, r.get("severity", "warn"), F.expr(r["when"]) if r.get("when") else None, r.get("ruleset", "core")))
    return made


def override(rules: list[Rule], config: dict[str, tuple[bool, str | None]], rulesets: dict[str, bool] | None = None) -> list[Rule]:
    """Rules without the disabled ones, with severities replaced."""
    out = []
    for rule in rules:
        enabled, severity = config.get(rule.rule_id, (True, None))
        if enabled and (rulesets or {}).get(rule.ruleset, True):
            out.append(replace(rule, severity=severity) if severity else rule)
    return out


def set_config(config: DataFrame, changes: DataFrame, key: str = "rule_id") -> DataFrame:
    """The configuration (key, enabled, severity) after ``changes`` of the same columns.

    A change takes the place of what was known of its key, and one with neither value
    clears it.  Changes without key, of a severity that isn't known or of a key that
    is changed twice aren't made.
    """
    values = [c for c in config.columns if c != key]
    once = changes.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in values]).where(F.col(key).isNotNull() & (F.col("_n") == 1))
    if "severity" in values:
        once = once.where(F.col("severity").isNull() | (severity_rank(F.col("severity")) >= 0))
    some = once.where(F.coalesce(*[F.col(c).cast("string") for c in values]).isNotNull())
    return config.join(once.select(key), key, "left_anti").select(*config.columns).unionByName(some.select(*config.columns))


def list_config(rules: DataFrame, config: DataFrame, rulesets: DataFrame) -> DataFrame:
    """All ``rules`` (rule_id, ruleset, severity) with what counts for each: ``enabled`` and ``severity``, and its ``default_severity``.

    A rule is enabled if neither it nor its set (``rulesets``: ruleset, enabled) is switched off.
    """
    own = config.select("rule_id", F.col("enabled").alias("_own"), F.col("severity").alias("_severity"))
    sets = rulesets.select("ruleset", F.col("enabled").alias("_set"))
    joined = rules.join(own, "rule_id", "left").join(sets, "ruleset", "left")
    on = F.coalesce("_own", F.lit(True)) & F.coalesce("_set", F.lit(True))
    return joined.select("rule_id", "ruleset", on.alias("enabled"), F.coalesce("_severity", "severity").alias("severity"), F.col("severity").alias("default_severity"))


def warnings_of(issues: DataFrame, rules: DataFrame, table: str, ids: DataFrame) -> DataFrame:
    """Open issues of the records ``ids`` (record_id) of a table, of enabled ``rules`` (as listed), with the severity that counts."""
    some = issues.where((F.col("table_name") == table) & is_open()).drop("severity").join(ids.select("record_id").distinct(), "record_id", "left_semi")
    return some.join(rules.where("enabled").select("rule_id", "severity"), "rule_id").select(*IDENTITY, "severity", "actual_value")


def row_local(table: str, rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """All violations of row-local rules from one scan of the table."""
    if not rules:
        return rows.sparkSession.createDataFrame([], VIOLATION)
    checks = [
        F.when(
            (rule.when if rule.when is not None else F.lit(True)) & rule.fails,
            F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.field).alias("field_name"), F.lit(rule.severity).alias("severity"), text(F.col(rule.field).cast("string")).alias("actual_value")),
        )
        for rule in rules
    ]
    hits = rows.select(F.col(key).cast("string").alias("record_id"), F.explode(F.array_compact(F.array(*checks))).alias("v"))
    return hits.select(F.lit(table).alias("table_name"), "record_id", "v.*")


def violation(rows: DataFrame, table: str, key: str, rule_id: str, field: str, severity: str, value: Column | None = None) -> DataFrame:
    return rows.select(
        F.lit(table).alias("table_name"),
        F.col(key).cast("string").alias("record_id"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(field).alias("field_name"),
        F.lit(severity).alias("severity"),
        text((value if value is not None else F.col(field)).cast("string")).alias("actual_value"),
    )


def foreign_key(rows: DataFrame, field: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose non-empty key leads nowhere."""
    keys = other.select(F.col(other_key).alias("_k"))
    return rows.where(~empty(F.col(field).cast("string"))).join(keys, F.col(field) == F.col("_k"), "left_anti")


def uncited(references: DataFrame, key: str, citing: list[tuple[DataFrame, str]]) -> DataFrame:
    """References that no row of the citing tables names."""
    cited = None
    for df, column in citing:
        ids = df.select(F.col(column).alias("_c")).distinct()
        cited = ids if cited is None else cited.union(ids)
    return references.join(cited, F.col(key) == F.col("_c"), "left_anti")


def duplicates(rows: DataFrame, columns: list[str], most: int = 0) -> DataFrame:
    """Rows with more than ``most`` others of equal non-empty values, with ``others``.

    Counts are aggregated before the shuffle and joined back, so a value that
    most rows share isn't gathered in one task.
    """
    some = rows.where(~empty(F.concat(*[text(F.col(c)) for c in columns])))
    counts = some.groupBy(*columns).agg((F.count("*") - 1).alias("others")).where(F.col("others") > most)
    return some.join(counts, columns)


def related(rows: DataFrame, field: str, other: DataFrame, other_key: str, condition: Column, columns: list[str]) -> DataFrame:
    """Rows whose related record (by ``field``) meets the failing condition."""
    far = other.select(F.col(other_key).alias("_k"), *columns)
    return rows.join(far, F.col(field) == F.col("_k")).where(condition)


def ancestor_missing(nodes: DataFrame, pairs: DataFrame, accepted: DataFrame) -> DataFrame:
    """Nodes (id) none of whose ancestors is in ``accepted`` (id)."""
    ok = pairs.join(accepted.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
    return nodes.join(ok, "id", "left_anti")


def merge_issues(store: DataFrame, found: DataFrame, now: str, scope: DataFrame | None = None) -> DataFrame:
    """The new issue store: known issues keep first-seen time and acknowledgement, those that don't fire any more go.

    Of several violations of one identity the most severe one counts with its
    value, of equally severe ones the greatest value.  ``scope`` (table_name,
    record_id) are the records that were validated; issues of all others stay as
    they are.  Without it every record was.  A store with a ``result_id`` keeps those of
    known issues; a new issue's one is made of its identity and ``now``, so it is the
    same when a lost task runs again.
    """
    kept = [*IDENTITY, *(["result_id"] if "result_id" in store.columns else []), "created_at", "acknowledged_at"]
    first = F.struct(severity_rank(F.col("severity")).alias("r"), F.col("actual_value").alias("actual_value"), F.col("severity").alias("severity"))
    new = found.groupBy(*IDENTITY).agg(F.max(first).alias("_v")).select(*IDENTITY, F.col("_v.severity").alias("severity"), F.col("_v.actual_value").alias("actual_value"))
    merged = new.join(store.select(*kept), IDENTITY, "left").withColumn("created_at", F.coalesce("created_at", F.lit(now)))
    if "result_id" in kept:
        merged = merged.withColumn("result_id", F.coalesce("result_id", F.sha2(F.to_json(F.array(*IDENTITY, F.lit(now))), 256)))
    if scope is None:
        return merged
    records = ["table_name", "record_id"]
    return merged.unionByName(store.join(scope.select(*records).distinct(), records, "left_anti").select(*merged.columns))


def is_open(acknowledged: str = "acknowledged_at") -> Column:
    return empty(F.col(acknowledged))


def issue_summary(issues: DataFrame) -> DataFrame:
    """(table_name, rule_id, rule_name if it is known, severity, n), the most frequent first, then by the names."""
    by = ["table_name", "rule_id", *(["rule_name"] if "rule_name" in issues.columns else []), "severity"]
    return issues.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "table_name", "rule_id", "severity")


def record_summary(issues: DataFrame) -> DataFrame:
    """Open issues per record: their number and the highest severity."""
    some = issues.where(is_open()).groupBy("table_name", "record_id").agg(F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).alias("_r"))
    return some.select("table_name", "record_id", "n", severity_name(F.col("_r")).alias("max_severity"))


def list_issues(issues: DataFrame, severities: list[str] | None = None, table: str | None = None, rule: str | None = None, hide_acknowledged: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    some = issues
    if severities:
        some = some.where(F.col("severity").isin(severities))
    if table:
        some = some.where(F.col("table_name") == table)
    if rule:
        some = some.where(F.col("rule_id") == rule)
    if hide_acknowledged:
        some = some.where(is_open())
    order = [F.desc(severity_rank(F.col("severity"))), "rule_id", F.desc("created_at"), *IDENTITY]
    return some.orderBy(*order).offset(offset).limit(min(limit, 500))


def neighbours(changed: DataFrame, rows: DataFrame, key: str, match: list[str]) -> DataFrame:
    """Keys to validate again: rows that match a changed row's old or new values, and the changed rows."""
    values = changed.select(*match).where(~empty(F.concat(*[text(F.col(c)) for c in match]))).distinct()
    near = rows.join(values, match, "left_semi").select(key)
    return near.union(changed.select(key)).distinct()


def rules_due(state: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Time-based rules (rule_id, last_run_at) that never ran or ran at least so many days ago."""
    last = F.try_to_timestamp("last_run_at")
    return state.where(last.isNull() | (last <= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {days} DAYS")))
