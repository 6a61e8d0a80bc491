"""Rule bundles as plain data, compiled to one plan a table.

A bundle is what a JSON file holds::

    {"name": "core",
     "relations": {"taxon:name": {"from_table": "taxon", "from_column": "name_id", "to_table": "name", "to_column": "id"}},
     "rules": [{"rule_id": ..., "table_name": ..., "field_name": ..., "validator_type": ..., "parameters": {...},
                "conditions": [{"relation": ..., "field": ..., "operator": "equals", "value": ...}], ...}]}

``merge`` puts the enabled bundles together and ``validate`` runs them.  All rules of a
table are told by one scan of the columns that they name, with one join for each
relation, however many rules go over it, and one closure for each parent column.

How cases are read:

* Null is the empty text; values are compared as text, as numbers where a mechanism
  is about numbers.
* Conditions are joined by AND.  One over a relation doesn't hold if the key is empty or
  leads nowhere, whatever its operator is; mechanisms over a relation don't fire then.
* Of several records with the key that a relation leads to, the least one counts.
* Severity unset: ``error`` for hard enforcement, else ``warn``.  Enforcement unset:
  ``hard`` for an error, else ``soft``.
* A rule of a table that isn't given doesn't run; a rule whose related table or whose
  column isn't there is refused, as are unknown mechanisms, operators, relations and
  severities, and two rules of one id.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import scalars as X
from canopy.operators import hierarchy as H
from canopy.operators import validation as V
from canopy.operators.rules import ror_ok
from canopy.sources import shared

ENFORCEMENTS = ["hard", "soft"]
TRIGGERS = ["on_change", "time_based"]
RESULT = f"{V.VIOLATION}, enforcement string, rule_name string, message string"
#: Rows without a key are dealt to so many values, none of which any record has.
SALT = 64


class BadBundle(ValueError):
    """A bundle that can't be compiled."""


@dataclass(frozen=True)
class Relation:
    from_table: str
    from_column: str
    to_table: str
    to_column: str
    #: The column holds a comma-separated list, whose first entry leads on.
    first_of_list: bool = False


@dataclass(frozen=True)
class BundleRule:
    rule_id: str
    table: str
    field: str
    mechanism: str
    params: dict = field(default_factory=dict)
    conditions: tuple = ()
    severity: str = "warn"
    enforcement: str = "soft"
    name: str = ""
    message: str = ""
    priority: int = 0
    ruleset: str = ""
    trigger: str = "on_change"
    recheck_days: int = 7


@dataclass(frozen=True)
class Catalogue:
    relations: dict[str, Relation]
    rules: list[BundleRule]


def load(bundle: dict, column: Callable[[str], str] = lambda name: name) -> Catalogue:
    """The active rules of a bundle; ``column`` gives the logical name of a column that the bundle names."""
    relations = {}
    for name, r in bundle.get("relations", {}).items():
        relations[name] = Relation(r["from_table"], column(r["from_column"]), r["to_table"], column(r["to_column"]), bool(r.get("first_of_list", False)))
    rules = []
    for r in bundle.get("rules", []):
        if not r.get("is_active", True):
            continue
        rule_id, table = r["rule_id"], r["table_name"]
        severity, enforcement = r.get("severity") or None, r.get("enforcement") or None
        severity = severity or ("error" if enforcement == "hard" else "warn")
        enforcement = enforcement or ("hard" if severity == "error" else "soft")
        first, second = ("error_message", "warning_message") if severity == "error" else ("warning_message", "error_message")
        if r["validator_type"] not in MECHANISMS:
            raise BadBundle(f"{rule_id}: unknown mechanism {r['validator_type']}")
        for value, known in ((severity, X.SEVERITIES), (enforcement, ENFORCEMENTS), (r.get("trigger") or TRIGGERS[0], TRIGGERS)):
            if value not in known:
                raise BadBundle(f"{rule_id}: {value} is none of {', '.join(known)}")
        days = r.get("recheck_days") or 0
        made = _Names(rule_id, relations, column)
        rules.append(
            BundleRule(
                rule_id, table, column(r["field_name"]), r["validator_type"], made.params(table, r.get("parameters") or {}), made.conditions(table, r.get("conditions") or []),
                severity, enforcement, r.get("rule_name", ""), r.get(first) or r.get(second) or "", r.get("priority", 0), bundle.get("name", ""), r.get("trigger") or TRIGGERS[0], days if days > 0 else 7,
            )
        )
    return Catalogue(relations, rules)


class _Names:
    """Parameters and conditions of a rule under logical column names; joins that are written out become relations."""

    def __init__(self, rule_id: str, relations: dict[str, Relation], column: Callable[[str], str]):
        self.rule_id, self.relations, self.column = rule_id, relations, column

    def path(self, table: str, raw: dict, prefix: str = "") -> tuple[str, ...]:
        """The relations that a condition goes over: one name, several in order, or a join that is written out."""
        join, named = raw.get(f"{prefix}join"), raw.get(f"{prefix}relation")
        if join:
            to_table, _, to_column = join["to"].partition(".")
            return (self.add(Relation(table, self.column(join["from"]), to_table, self.column(to_column))),)
        return tuple([named] if isinstance(named, str) else named or [])

    def add(self, relation: Relation) -> str:
        name = f"{relation.from_table}.{relation.from_column}>{relation.to_table}.{relation.to_column}"
        self.relations.setdefault(name, relation)
        return name

    def conditions(self, table: str, raw: list[dict]) -> tuple:
        return tuple(self.condition(table, c) for c in raw)

    def condition(self, table: str, c: dict) -> tuple:
        if c["operator"] not in OPERATORS:
            raise BadBundle(f"{self.rule_id}: unknown operator {c['operator']}")
        return self.path(table, c), self.column(c["field"]), c["operator"], c.get("value")

    def params(self, table: str, raw: dict) -> dict:
        out = dict(raw)
        for key in ("field", "self_field", "parent_column", "rank_column", "code_column"):
            if key in out:
                out[key] = self.column(out[key])
        if "relation" in raw or "join" in raw:
            out["path"] = self.path(table, raw)
        if "parent_column" in out:
            out["up"] = self.add(Relation(table, out["parent_column"], table, self.column(out.get("key_column", "id"))))
        for key in ("match", "stop_when"):
            if isinstance(out.get(key), dict):
                out[key] = self.conditions(table, [out[key]])
        if raw.get("table"):  # rows of a table are counted
            out["match"] = [(self.column(m["target"]), self.column(m["self"])) for m in raw.get("match", [])]
            out["where"] = self.conditions(raw["table"], raw.get("where", []))
        if "assert" in raw:
            a = raw["assert"]
            if a["operator"] not in OPERATORS or a["operator"] in ("in", "not_in"):
                raise BadBundle(f"{self.rule_id}: unknown operator {a['operator']}")
            out["assert"] = (self.path(table, a, "self_"), self.column(a["self_field"]), self.path(table, a, "ancestor_"), self.column(a["ancestor_field"]), a["operator"])
        return out


def read(spark: SparkSession, path: str, column: Callable[[str], str] = lambda name: name) -> Catalogue:
    """The bundle of a JSON file."""
    return load(json.loads(shared.read(spark, path)), column)


def merge(bundles: list[Catalogue], rulesets: dict[str, bool] | None = None, config: dict[str, tuple[bool | None, str | None]] | None = None) -> Catalogue:
    """The rules of the enabled bundles by priority and id, with the rules that are switched off left out and severities replaced.

    Relations are those of all bundles, also of disabled ones, as others name them.
    A severity that is replaced leaves the enforcement as it is.
    """
    relations: dict[str, Relation] = {}
    for b in bundles:
        for name, relation in b.relations.items():
            if relations.setdefault(name, relation) != relation:
                raise BadBundle(f"two relations are called {name}")
    rules: dict[str, BundleRule] = {}
    for b in bundles:
        for rule in b.rules:
            if not (rulesets or {}).get(rule.ruleset, True):
                continue
            if rule.rule_id in rules:
                raise BadBundle(f"two rules are called {rule.rule_id}")
            for path in _paths(rule):
                if missing := [name for name in path if name not in relations]:
                    raise BadBundle(f"{rule.rule_id}: unknown relation {missing[0]}")
            rules[rule.rule_id] = rule
    first = {}  # a join that is written out is the relation that says the same, so it is made once
    names = {name: first.setdefault(relation, name) for name, relation in relations.items()}
    out = []
    for rule in rules.values():
        rule = _renamed(rule, names)
        enabled, severity = (config or {}).get(rule.rule_id, (None, None))
        if severity and severity not in X.SEVERITIES:
            raise BadBundle(f"{rule.rule_id}: unknown severity {severity}")
        if enabled is not False:
            out.append(replace(rule, severity=severity) if severity else rule)
    return Catalogue(relations, sorted(out, key=lambda r: (r.priority, r.rule_id)))


def _paths(rule: BundleRule) -> list[tuple[str, ...]]:
    p = rule.params
    some = [c[0] for c in rule.conditions] + [p.get("path", ())]
    some += [c[0] for key in ("match", "stop_when", "where") for c in p.get(key, ()) if len(c) == 4]
    return some + ([p["assert"][0], p["assert"][2]] if "assert" in p else [])


def _renamed(rule: BundleRule, names: dict[str, str]) -> BundleRule:
    """The rule, whose relations go by other names."""
    path = lambda p: tuple(names[n] for n in p)
    conditions = lambda some: tuple((path(c[0]), *c[1:]) if len(c) == 4 else c for c in some)
    p = dict(rule.params)
    if "path" in p:
        p["path"] = path(p["path"])
    if "up" in p:
        p["up"] = names[p["up"]]
    for key in ("match", "stop_when", "where"):
        if key in p:
            p[key] = conditions(p[key])
    if "assert" in p:
        one, own, other, far, operator = p["assert"]
        p["assert"] = (path(one), own, path(other), far, operator)
    return replace(rule, params=p, conditions=conditions(rule.conditions))


def catalogue_rows(spark: SparkSession, catalogue: Catalogue) -> DataFrame:
    """The rules as rows (rule_id, ruleset, table_name, rule_name, severity, enforcement, priority), as ``validation.list_config`` takes them."""
    rows = [(r.rule_id, r.ruleset, r.table, r.name, r.severity, r.enforcement, r.priority) for r in catalogue.rules]
    return spark.createDataFrame(rows, "rule_id string, ruleset string, table_name string, rule_name string, severity string, enforcement string, priority int")


# --- from rules to one plan a table


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _ordered(compare: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A comparison of numbers; what isn't a number can't fail it."""
    return lambda a, b: F.coalesce(compare(_number(a), _number(b)), F.lit(True))


#: How two texts are compared, by name.
OPERATORS: dict[str, Callable] = {
    "equals": lambda a, b: a == b,
    "not_equals": lambda a, b: a != b,
    "in": lambda a, b: a.isin(list(b)),
    "not_in": lambda a, b: ~a.isin(list(b)),
    "less_than": _ordered(lambda a, b: a < b),
    "less_than_or_equals": _ordered(lambda a, b: a <= b),
    "greater_than": _ordered(lambda a, b: a > b),
    "greater_than_or_equals": _ordered(lambda a, b: a >= b),
}


class _Node:
    """Columns of a table that rules name, and the relations that they follow from it."""

    def __init__(self) -> None:
        self.fields: dict[str, str] = {}
        self.hops: dict[str, tuple[str, _Node]] = {}

    def slot(self, name: str) -> str:
        return self.fields.setdefault(name, f"f{len(self.fields)}")

    def hop(self, relation: str) -> tuple[str, _Node]:
        return self.hops.setdefault(relation, (f"h{len(self.hops)}", _Node()))

    def text(self, name: str, path: tuple[str, ...] = ()) -> Column:
        """The text of a column, of this table's record or of the one that the path leads to."""
        at, node = [], self
        for relation in path:
            step, node = node.hop(relation)
            at.append(step)
        return X.text(F.col(".".join([*at, node.slot(name)])))

    def found(self, path: tuple[str, ...]) -> Column:
        at, node = [], self
        for relation in path:
            step, node = node.hop(relation)
            at.append(step)
        return F.col(".".join(at)).isNotNull() if at else F.lit(True)

    def holds(self, conditions: tuple) -> Column:
        """Whether all conditions hold of a record."""
        out = F.lit(True)
        for path, name, operator, value in conditions:
            literal = [str(v) for v in value] if isinstance(value, (list, tuple)) else F.lit("" if value is None else str(value))
            out = out & self.found(path) & OPERATORS[operator](self.text(name, path), literal)
        return out


def _key(value: Column, spread: Column) -> Column:
    """A join key: records without one are dealt to values that no record has, so that they don't meet in one task."""
    return F.when(X.empty(value), F.concat(F.lit("-"), F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("string"))).otherwise(F.concat(F.lit("="), value))


class Compiled:
    """The plans of a catalogue over given tables; closures are made once for each parent column."""

    def __init__(self, catalogue: Catalogue, tables: dict[str, DataFrame], keys: dict[str, str] | None = None):
        self.catalogue, self.tables, self.keys, self.closures = catalogue, tables, keys or {}, {}

    def key_of(self, table: str) -> str:
        return self.keys.get(table, "id")

    def column(self, table: str, name: str) -> Column:
        if table not in self.tables:
            raise BadBundle(f"the rules need the table {table}")
        if name not in self.tables[table].columns:
            raise BadBundle(f"the table {table} has no column {name}")
        return F.col(f"`{name}`").cast("string")

    def rows(self, node: _Node, table: str) -> DataFrame:
        """The named columns of a table, and a struct for each relation, null where it leads nowhere."""
        relations = {name: self.catalogue.relations[name] for name in node.hops}
        for name, relation in relations.items():
            if relation.from_table != table:
                raise BadBundle(f"the relation {name} doesn't start at {table}")
        own = {name: node.slot(name) for name in [*node.fields, *[r.from_column for r in relations.values()]]}
        out = self.tables[table].select(*[self.column(table, name).alias(slot) for name, slot in own.items()])
        for name, (slot, far_node) in node.hops.items():
            relation = relations[name]
            self.column(relation.to_table, relation.to_column)
            far_key = far_node.slot(relation.to_column)
            far = self.rows(far_node, relation.to_table).where(~X.empty(F.col(far_key)))
            far = far.groupBy(F.concat(F.lit("="), F.col(far_key)).alias("_k")).agg(F.min(F.struct(*far.columns)).alias(slot))
            value = X.first_of_list(F.col(own[relation.from_column])) if relation.first_of_list else F.col(own[relation.from_column])
            out = out.withColumn("_k", _key(value, F.struct(*own.values()))).join(far, "_k", "left").drop("_k")
        return out

    def closure(self, table: str, parent: str) -> DataFrame:
        if (table, parent) not in self.closures:
            self.closures[table, parent] = H.closure(self.tree(table, parent))
        return self.closures[table, parent]

    def tree(self, table: str, parent: str) -> DataFrame:
        return self.tables[table].select(self.column(table, self.key_of(table)).alias("id"), self.column(table, parent).alias("parent_id"))

    def violations(self, table: str, only: DataFrame | None = None) -> DataFrame:
        """Violations of all rules of one table, of the records ``only`` (record_id) if that is given."""
        plan = _Plan(self, table)
        checks = []
        for rule in self.catalogue.rules:
            if rule.table != table:
                continue
            fails, value = MECHANISMS[rule.mechanism](plan, rule)
            told = {"rule_id": rule.rule_id, "field_name": rule.field, "severity": rule.severity, "enforcement": rule.enforcement, "rule_name": rule.name, "message": rule.message}
            checks.append(F.when(plan.node.holds(rule.conditions) & fails, F.struct(*[F.lit(v).alias(k) for k, v in told.items()], value.alias("actual_value"))))
        id_ = plan.node.slot(self.key_of(table))
        rows = self.rows(plan.node, table)
        if only is not None:
            rows = rows.join(only.select(F.col("record_id").alias(id_)).distinct(), id_, "left_semi")
        for n, (value, far) in enumerate(plan.lookups):
            rows = rows.withColumn("_k", _key(value, F.col(id_))).join(far.select(F.concat(F.lit("="), F.col("k")).alias("_k"), F.col("v").alias(f"x{n}")), "_k", "left").drop("_k")
        hits = rows.select(F.col(id_).alias("record_id"), F.explode(F.array_compact(F.array(*checks))).alias("v"))
        return hits.select(F.lit(table).alias("table_name"), "record_id", "v.rule_id", "v.field_name", "v.severity", "v.actual_value", "v.enforcement", "v.rule_name", "v.message")


class _Plan:
    """What the rules of one table need beside its own scan: values to look up, each found by one key."""

    def __init__(self, compiled: Compiled, table: str):
        self.compiled, self.table, self.node, self.lookups = compiled, table, _Node(), []

    @property
    def id(self) -> Column:
        return self.node.text(self.compiled.key_of(self.table))

    def own(self, rule: BundleRule) -> Column:
        return self.node.text(rule.params.get("field", rule.field))

    def lookup(self, key: Column, far: DataFrame) -> Column:
        """The value ``v`` that ``far`` (k, v; k once) has for a key, null if it has none."""
        self.lookups.append((key, far))
        return F.col(f"x{len(self.lookups) - 1}")


Checked = tuple[Column, Column]


def _of_field(fails: Callable[..., Column]) -> Callable[[_Plan, BundleRule], Checked]:
    def check(plan: _Plan, rule: BundleRule) -> Checked:
        own = plan.own(rule)
        return fails(own, rule.params), own

    return check


def _range(own: Column, p: dict) -> Column:
    n = _number(own)
    return n.isNull() | (n < p.get("min", float("-inf"))) | (n > p.get("max", float("inf")))


def _length(own: Column, p: dict) -> Column:
    n = F.char_length(own)
    return (n < p.get("min", 0)) | (n > p.get("max", 2**31 - 1))


CHECK_DIGITS: dict[str, Callable[[Column], Column]] = {"orcid": X.orcid_ok, "issn": X.issn_ok, "isbn10": X.isbn10_ok, "isbn13": X.isbn13_ok, "luhn": X.luhn_ok, "rorid": ror_ok}


def _check_digit(own: Column, p: dict) -> Column:
    return ~X.text(CHECK_DIGITS[p["format"]](own).cast("string")).eqNullSafe("true")


def _related(passes: Callable[[Column, Column, dict], Column]) -> Callable[[_Plan, BundleRule], Checked]:
    """A field of the related record (``relation``, ``related_field``) against the rule's own field or a set of values."""

    def check(plan: _Plan, rule: BundleRule) -> Checked:
        p = rule.params
        own, far = plan.own(rule), plan.node.text(p["related_field"], p["path"])
        skip = (own == "") | (far == "") if p.get("skip_if_either_empty") else F.lit(False)
        return plan.node.found(p["path"]) & ~skip & ~passes(own, far, p), own

    return check


def _foreign_key(plan: _Plan, rule: BundleRule) -> Checked:
    own = plan.own(rule)
    return (own != "") & ~plan.node.found(rule.params["path"]), own


def _count_across(plan: _Plan, rule: BundleRule) -> Checked:
    """How many records of ``table`` have the values of this one (``match``) and meet ``where``, against ``expected``.

    Records with an empty value aren't compared.  Counts are aggregated before the
    shuffle and joined back, so a value that most rows share isn't gathered.
    """
    p = rule.params
    joined = lambda node, names: F.to_json(F.array(*[node.text(n) for n in names]))
    targets, selfs = [t for t, _ in p["match"]], [s for _, s in p["match"]]
    far = _Node()
    key, meets = joined(far, targets), far.holds(p["where"])
    some = plan.compiled.rows(far, p["table"]).where(meets & reduce(Column.__and__, [far.text(t) != "" for t in targets]))
    counts = some.groupBy(key.alias("k")).agg(F.count("*").alias("v"))
    full = reduce(Column.__and__, [plan.node.text(s) != "" for s in selfs])
    mine = joined(plan.node, selfs)
    n = F.coalesce(plan.lookup(F.when(full, mine), counts), F.lit(0))
    if p.get("exclude_self") and p["table"] == plan.table:
        n = n - ((joined(plan.node, targets) == mine) & plan.node.holds(p["where"])).cast("int")
    bounds = p["expected"]
    return full & ((n < bounds.get("min", 0)) | (n > bounds.get("max", 2**62))), plan.own(rule)


def _no_cycle(plan: _Plan, rule: BundleRule) -> Checked:
    parent = rule.params["parent_column"]
    around = H.cycle_nodes(plan.compiled.tree(plan.table, parent)).select(F.col("id").alias("k"), F.lit(True).alias("v"))
    return plan.lookup(plan.id, around).isNotNull(), plan.node.text(parent)


def _accepted(plan: _Plan, conditions: tuple, *more: tuple[str, str, tuple]) -> DataFrame:
    """Records (ancestor, and ``more``: name, column, path) of the table that meet the conditions."""
    node = _Node()
    meets, id_ = node.holds(conditions), node.text(plan.compiled.key_of(plan.table))
    values = [node.text(column, path).alias(name) for name, column, path in more]
    return plan.compiled.rows(node, plan.table).where(meets).select(id_.alias("ancestor"), *values)


def _ancestor_exists(plan: _Plan, rule: BundleRule) -> Checked:
    parent = rule.params["parent_column"]
    pairs, accepted = plan.compiled.closure(plan.table, parent), _accepted(plan, rule.params["match"])
    fine = pairs.join(accepted, "ancestor", "left_semi").select(F.col("id").alias("k")).distinct().withColumn("v", F.lit(True))
    return plan.lookup(plan.id, fine).isNull(), plan.node.text(parent)


def _ancestor_field(plan: _Plan, rule: BundleRule) -> Checked:
    """The rule's value against that of the closest ancestor that ``stop_when`` names; empty values aren't compared."""
    self_path, self_field, far_path, far_field, operator = rule.params["assert"]
    pairs = plan.compiled.closure(plan.table, rule.params["parent_column"])
    near = H.nearest_ancestor(pairs, _accepted(plan, rule.params["stop_when"], ("v", far_field, far_path))).select(F.col("id").alias("k"), "v")
    own, far = plan.node.text(self_field, self_path), X.text(plan.lookup(plan.id, near))
    return (own != "") & (far != "") & ~OPERATORS[operator](own, far), own


def _parent_rank(plan: _Plan, rule: BundleRule) -> Checked:
    """The parent's rank stands before the record's own in the list of its code; ranks that aren't listed aren't compared."""
    p = rule.params
    path = p.get("path", ())
    own, far, code = plan.node.text(p["rank_column"], path), plan.node.text(p["rank_column"], (p["up"], *path)), plan.node.text(p["code_column"], path)
    low = high = F.lit(0)
    for of_code, order in p["rank_order"].items():
        ranks = F.array(*map(F.lit, order))
        low = F.when(code == of_code, F.array_position(ranks, own)).otherwise(low)
        high = F.when(code == of_code, F.array_position(ranks, far)).otherwise(high)
    return (low > 0) & (high > 0) & (high >= low), plan.node.text(p["parent_column"])


#: Mechanisms by name: (plan, rule) to whether a record fails and the value that is told; more can be registered.
MECHANISMS: dict[str, Callable[[_Plan, BundleRule], Checked]] = {
    "presence": _of_field(lambda own, p: own == ""),
    "absence": _of_field(lambda own, p: own != ""),
    "regex": _of_field(lambda own, p: ~own.rlike(p["pattern"])),
    "length": _of_field(_length),
    "range": _of_field(_range),
    "check_digit": _of_field(_check_digit),
    "related_field_equals": _related(lambda own, far, p: own == far),
    "related_field_not_equals": _related(lambda own, far, p: own != far),
    "related_field_in_set": _related(lambda own, far, p: far.isin(list(p["values"]))),
    "foreign_key_exists": _foreign_key,
    "count_across": _count_across,
    "no_self_cycle": _no_cycle,
    "ancestor_exists": _ancestor_exists,
    "ancestor_field_check": _ancestor_field,
    "parent_rank_higher": _parent_rank,
}


def validate(catalogue: Catalogue, tables: dict[str, DataFrame], keys: dict[str, str] | None = None, only: dict[str, DataFrame] | None = None) -> DataFrame:
    """All violations (``RESULT``) of the tables that are there.

    ``only`` restricts tables to records (record_id); tables that it doesn't name aren't
    validated then.  Rules still look at the whole of all tables.
    """
    compiled = Compiled(catalogue, tables, keys)
    wanted = [t for t in dict.fromkeys(r.table for r in catalogue.rules) if t in tables and (only is None or t in only)]
    if not wanted:
        return next(iter(tables.values())).sparkSession.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, [compiled.violations(t, None if only is None else only[t]) for t in wanted])


def blocked(violations: DataFrame) -> DataFrame:
    """Records (table_name, record_id) that a violation with hard enforcement keeps from being saved."""
    return violations.where("enforcement = 'hard'").select("table_name", "record_id").distinct()


def admit(rows: DataFrame, violations: DataFrame, table: str, key: str = "id") -> DataFrame:
    """The rows of a table that no hard violation blocks."""
    keys = blocked(violations).where(F.col("table_name") == table).select(F.col("record_id").alias("_record"))
    return rows.join(keys, F.col(key).cast("string") == F.col("_record"), "left_anti")
