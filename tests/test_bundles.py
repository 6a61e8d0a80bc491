"""Rule bundles: each mechanism, conditions over relations, defaults, merging, enforcement."""

import json

import pytest

from canopy.operators import bundles as B
from canopy.operators import validation as V
from canopy.sources.archive import logical

RELATIONS = {
    "taxon:name": {"from_table": "taxon", "from_column": "name_id", "to_table": "name", "to_column": "id"},
    "taxon:parent": {"from_table": "taxon", "from_column": "parent_id", "to_table": "taxon", "to_column": "id"},
    "name:reference": {"from_table": "name", "from_column": "reference_id", "to_table": "reference", "to_column": "id", "first_of_list": True},
}


def rule(mechanism, of="name", field="label", conditions=(), **parameters):
    return {"rule_id": "r", "table_name": of, "field_name": field, "validator_type": mechanism, "conditions": list(conditions), "parameters": parameters}


def bundle(*rules, name="b", relations=RELATIONS):
    return {"name": name, "relations": relations, "rules": list(rules)}


@pytest.fixture(scope="module")
def tables(spark):
    name = [("n1", "Genus", "GENUS", "ZOO", "1800", "r1"), ("n2", "Genus one", "SPECIES", "ZOO", "1790", "r1, r2"), ("n3", None, "SPECIES", "BOT", "x", "r9"), ("n4", "", "FAMILY", "ZOO", "", ""), ("n5", "Genus one", "SPECIES", "ZOO", "1900", None)]
    taxon = [("t1", "", "n4"), ("t2", "t1", "n1"), ("t3", "t2", "n2"), ("t4", "t1", "n3"), ("t5", "t9", "n9"), ("t6", "t7", "n5"), ("t7", "t6", ""), ("t8", "t3", "n1"), ("t9x", "t9x", None)]
    reference = [("r1", "1800"), ("r2", "1790"), ("", "0")]
    return {
        "name": spark.createDataFrame(name, "id string, label string, rank string, code string, year string, reference_id string"),
        "taxon": spark.createDataFrame(taxon, "id string, parent_id string, name_id string"),
        "reference": spark.createDataFrame(reference, "id string, year string"),
    }


def fired(tables, *rules, **merge):
    found = B.validate(B.merge([B.load(bundle(*rules))], **merge), tables)
    return {(r["record_id"], r["actual_value"]) for r in found.collect()}


UP = {"parent_column": "parent_id"}
NAMED = lambda operator, value, field="rank": {"relation": "taxon:name", "field": field, "operator": operator, "value": value}
CASES = [
    (rule("presence"), {"n3", "n4"}),
    (rule("absence"), {"n1", "n2", "n5"}),
    (rule("regex", pattern=r"^\S+$"), {"n2", "n3", "n4", "n5"}),
    (rule("regex", conditions=[{"field": "label", "operator": "not_equals", "value": ""}], pattern=r"^\S+$"), {"n2", "n5"}),
    (rule("length", min=1, max=5), {"n2", "n3", "n4", "n5"}),
    (rule("range", field="year", min=1795), {"n2", "n3", "n4"}),
    (rule("presence", conditions=[{"field": "rank", "operator": "in", "value": ["GENUS", "FAMILY"]}]), {"n4"}),
    (rule("presence", conditions=[{"field": "rank", "operator": "not_in", "value": ["GENUS", "FAMILY"]}, {"field": "code", "operator": "equals", "value": "BOT"}]), {"n3"}),
    # keys: empty ones aren't looked up, the first of a list counts, a record of an empty key is never found
    (rule("foreign_key_exists", field="reference_id", relation="name:reference"), {"n3"}),
    (rule("foreign_key_exists", "taxon", "name_id", relation="taxon:name"), {"t5"}),
    # conditions over a relation don't hold where it leads nowhere, whatever they ask
    (rule("absence", "taxon", "id", [NAMED("not_equals", "SPECIES")]), {"t1", "t2", "t8"}),
    (rule("absence", "taxon", "id", [{"relation": ["taxon:parent", "taxon:name"], "field": "rank", "operator": "equals", "value": "GENUS"}]), {"t3"}),
    (rule("absence", "taxon", "id", [{"join": {"from": "name_id", "to": "name.id"}, "field": "rank", "operator": "equals", "value": "GENUS"}]), {"t2", "t8"}),
    (rule("related_field_equals", field="year", relation="name:reference", related_field="year"), {"n2"}),
    (rule("related_field_not_equals", field="year", relation="name:reference", related_field="year"), {"n1"}),
    (rule("related_field_in_set", "taxon", "parent_id", [NAMED("equals", "SPECIES")], relation=["taxon:parent", "taxon:name"], related_field="rank", values=["GENUS"]), {"t4"}),
    (rule("count_across", table="name", match=[{"target": "label", "self": "label"}], exclude_self=True, expected={"max": 0}), {"n2", "n5"}),
    (rule("count_across", table="name", match=[{"target": "label", "self": "label"}], expected={"min": 2}), {"n1"}),
    (rule("count_across", table="name", match=[{"target": "label", "self": "label"}, {"target": "year", "self": "year"}], exclude_self=True, expected={"max": 0}), set()),
    (rule("count_across", "taxon", "name_id", table="name", match=[{"target": "id", "self": "name_id"}], where=[{"field": "rank", "operator": "equals", "value": "GENUS"}], expected={"max": 0}), {"t2", "t8"}),
    (rule("no_self_cycle", "taxon", "parent_id", **UP), {"t6", "t7", "t9x"}),
    (rule("ancestor_exists", "taxon", "parent_id", [NAMED("equals", "SPECIES")], match=NAMED("equals", "GENUS"), **UP), {"t4", "t6"}),
    (
        rule("ancestor_field_check", "taxon", "year", stop_when=NAMED("equals", "GENUS"), **UP, **{"assert": {"self_relation": "taxon:name", "self_field": "year", "ancestor_relation": "taxon:name", "ancestor_field": "year", "operator": "greater_than_or_equals"}}),
        {"t3"},
    ),
    (rule("parent_rank_higher", "taxon", "parent_id", rank_column="rank", code_column="code", join={"from": "name_id", "to": "name.id"}, rank_order={"ZOO": ["FAMILY", "GENUS", "SPECIES"]}, **UP), {"t8"}),
]


def test_mechanisms(tables):
    """All cases as the rules of one bundle, so that they share scans and joins."""
    rules = [{**r, "rule_id": f"r{k:02}"} for k, (r, _) in enumerate(CASES)]
    found = B.validate(B.merge([B.load(bundle(*rules))]), tables).collect()
    for k, (r, expected) in enumerate(CASES):
        assert {v["record_id"] for v in found if v["rule_id"] == f"r{k:02}"} == expected, r
    assert len({(v["record_id"], v["rule_id"]) for v in found}) == len(found)


def test_check_digits(spark):
    good = {"orcid": "0000-0002-1825-0097", "issn": "2049-3630", "isbn10": "0306406152", "isbn13": "9780306406157", "luhn": "79927398713", "rorid": "05dxps055"}
    bad = {k: v[:-1] + ("1" if v[-1] != "1" else "2") for k, v in good.items()}
    rows = spark.createDataFrame([("good", *good.values()), ("bad", *bad.values())], f"id string, {', '.join(f'{k} string' for k in good)}")
    rules = [{**rule("check_digit", "t", k, format=k), "rule_id": k} for k in good]
    found = B.validate(B.merge([B.load(bundle(*rules))]), {"t": rows}).collect()
    assert {(v["record_id"], v["rule_id"]) for v in found} == {("bad", k) for k in good}


def test_values_that_are_told(tables):
    check = rule("ancestor_field_check", "taxon", "year", stop_when=NAMED("equals", "GENUS"), **UP, **{"assert": {"self_relation": "taxon:name", "self_field": "year", "ancestor_relation": "taxon:name", "ancestor_field": "year", "operator": "greater_than"}})
    # t8 is a genus below another of the same year
    assert fired(tables, check) == {("t3", "1790"), ("t8", "1800")}


def test_one_join_a_relation_and_only_the_named_columns(tables, capsys):
    """However many rules go over a relation, by its name or written out, it is joined once."""
    over = [{**rule("absence", "taxon", "id", [NAMED("equals", v)]), "rule_id": v} for v in ("GENUS", "SPECIES", "FAMILY")]
    over.append({**rule("absence", "taxon", "id", [{"join": {"from": "name_id", "to": "name.id"}, "field": "code", "operator": "equals", "value": "ZOO"}]), "rule_id": "join"})
    plan = B.validate(B.merge([B.load(bundle(*over))]), tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert "reference_id" not in plan.replace("LogicalRDD", "").split("Project")[1]


def test_defaults_and_messages(tables):
    made = lambda **more: {**rule("presence"), "error_message": "E", "warning_message": "W", "rule_name": "Label", **more}
    for more, expected in (
        ({}, ("warn", "soft", "W")),
        ({"enforcement": "hard"}, ("error", "hard", "E")),
        ({"severity": "error"}, ("error", "hard", "E")),
        ({"severity": "error", "enforcement": "soft"}, ("error", "soft", "E")),
        ({"severity": "info", "enforcement": "hard"}, ("info", "hard", "W")),
        ({"warning_message": ""}, ("warn", "soft", "E")),
    ):
        r = B.load(bundle(made(**more))).rules[0]
        assert (r.severity, r.enforcement, r.message) == expected
    found = B.validate(B.load(bundle(made())), tables).first()
    assert (found["rule_name"], found["message"], found["table_name"], found["field_name"]) == ("Label", "W", "name", "label")


def test_merging(tables):
    one = B.load(bundle({**rule("presence"), "rule_id": "a", "priority": 9}, {**rule("presence"), "rule_id": "off", "is_active": False}, name="one"))
    two = B.load(bundle({**rule("absence"), "rule_id": "b"}, name="two", relations={}))
    assert [(r.rule_id, r.ruleset) for r in B.merge([one, two]).rules] == [("b", "two"), ("a", "one")]
    assert [r.rule_id for r in B.merge([one, two], {"one": False}).rules] == ["b"]
    kept = B.merge([one, two], None, {"a": (False, "error"), "b": (None, "error"), "none": (False, None)}).rules
    assert [(r.rule_id, r.severity, r.enforcement) for r in kept] == [("b", "error", "soft")]
    assert B.validate(B.merge([one, two], {"one": False, "two": False}), tables).count() == 0


def test_bundles_that_are_refused(tables):
    for bad in (
        rule("no_such"),
        rule("presence", conditions=[{"field": "label", "operator": "like", "value": ""}]),
        {**rule("presence"), "severity": "fatal"},
        {**rule("presence"), "enforcement": "firm"},
        {**rule("presence"), "trigger": "never"},
    ):
        with pytest.raises(B.BadBundle):
            B.load(bundle(bad))
    with pytest.raises(B.BadBundle, match="unknown relation"):
        B.merge([B.load(bundle(rule("foreign_key_exists", relation="nowhere")))])
    with pytest.raises(B.BadBundle, match="two rules"):
        B.merge([B.load(bundle(rule("presence"))), B.load(bundle(rule("absence")))])
    with pytest.raises(B.BadBundle, match="two relations"):
        B.merge([B.load(bundle()), B.load(bundle(relations={"taxon:name": {**RELATIONS["taxon:name"], "from_column": "parent_id"}}))])
    with pytest.raises(B.BadBundle, match="unknown severity"):
        B.merge([B.load(bundle(rule("presence")))], None, {"r": (None, "fatal")})
    with pytest.raises(B.BadBundle, match="no column"):
        B.validate(B.load(bundle(rule("presence", field="colour"))), tables)
    with pytest.raises(B.BadBundle, match="the table name"):
        B.validate(B.load(bundle(rule("foreign_key_exists", "taxon", "name_id", relation="taxon:name"))), {"taxon": tables["taxon"]})
    with pytest.raises(B.BadBundle, match="doesn't start"):
        B.validate(B.load(bundle(rule("foreign_key_exists", relation="taxon:name"))), tables)


def test_stored_column_names_and_files(spark, tables, tmp_path):
    stored = {"name": "f", "relations": {}, "rules": [{**rule("presence", field="col__label", conditions=[{"field": "col__rank", "operator": "equals", "value": "FAMILY"}]), "rule_id": "p"}, {**rule("absence", "taxon", "col__id", [{"join": {"from": "col__name_id", "to": "name.col__id"}, "field": "col__rank", "operator": "equals", "value": "GENUS"}]), "rule_id": "j"}]}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(stored))
    found = B.validate(B.read(spark, f"file://{path}", lambda c: c.removeprefix("col__")), {t: logical(rows) for t, rows in tables.items()})
    assert {(r["rule_id"], r["record_id"]) for r in found.collect()} == {("p", "n4"), ("j", "t2"), ("j", "t8")}


def test_records_that_are_asked_for(spark, tables):
    """Only the named records are validated, against the whole of all tables."""
    catalogue = B.merge([B.load(bundle({**CASES[16][0], "rule_id": "dup"}, {**CASES[21][0], "rule_id": "genus"}))])
    only = {"name": spark.createDataFrame([("n5",), ("n5",), ("n1",), ("gone",)], "record_id string")}
    found = B.validate(catalogue, tables, only=only).collect()
    assert [(r["rule_id"], r["record_id"]) for r in found] == [("dup", "n5")]


def test_repeated_rows_and_odd_tables(spark, tables):
    """A repeated record is told as often as it is there; of several related records the least counts; empty tables and more columns do no harm."""
    taxon = tables["taxon"].union(tables["taxon"].where("id = 't2'")).selectExpr("*", "1 AS h0", "2 AS f0", "3 AS _k")
    name = tables["name"].unionByName(tables["name"].where("id = 'n1'").selectExpr("id", "label", "'AAA' AS rank", "code", "year", "reference_id"))
    check = rule("absence", "taxon", "id", [NAMED("equals", "AAA")])
    found = B.validate(B.load(bundle(check)), {"taxon": taxon, "name": name}).collect()
    assert sorted(r["record_id"] for r in found) == ["t2", "t2", "t8"]
    rules = [{**r, "rule_id": f"r{k}"} for k, (r, _) in enumerate(CASES)]
    assert B.validate(B.merge([B.load(bundle(*rules))]), {t: rows.limit(0) for t, rows in tables.items()}).count() == 0


def test_hard_rules_block(tables):
    catalogue = B.merge([B.load(bundle({**rule("presence"), "rule_id": "hard", "enforcement": "hard"}, {**rule("absence"), "rule_id": "soft"}))])
    found = B.validate(catalogue, tables)
    assert {(r["table_name"], r["record_id"]) for r in B.blocked(found).collect()} == {("name", "n3"), ("name", "n4")}
    assert {r["id"] for r in B.admit(tables["name"], found, "name").collect()} == {"n1", "n2", "n5"}
    assert [(r["rule_id"], r["n"]) for r in V.issue_summary(found).collect()] == [("soft", 3), ("hard", 2)]
