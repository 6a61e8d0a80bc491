"""Time-based rules: when they are due, what a sweep keeps, failures and rivals."""

import pytest

from canopy.operators import bundles as B
from canopy.operators import timers as T

DAY = "2026-01-{:02}T00:00:00Z"


def catalogue(*rules):
    made = [{"table_name": "t", "field_name": "v", "validator_type": "presence", "parameters": {}, "trigger": "time_based", **r} for r in rules]
    return B.load({"name": "timed", "rules": made})


def table(spark, **values):
    return {"t": spark.createDataFrame(list(values.items()), "id string, v string")}


def found(timers):
    return {(r["rule_id"], r["record_id"]): (r["created_at"], r["acknowledged_at"]) for r in timers.issues().collect()}


def test_when_a_rule_is_due():
    assert T.due(None, 7, DAY.format(1)) and T.due("", 7, DAY.format(1)) and T.due("some day", 7, DAY.format(1))
    assert T.due(DAY.format(1), 7, DAY.format(8)) and not T.due(DAY.format(2), 7, DAY.format(8))
    assert T.due("2026-01-01T02:00:00+02:00", 7, "2026-01-08 00:00:00") and not T.due("2026-01-01T02:00:00+01:00", 7, "2026-01-08 00:00:00")
    with pytest.raises(ValueError):
        T.due("x", 7, "now")


def test_sweeps(spark, tmp_path):
    timers = T.TimedRules(spark, f"file://{tmp_path}/t")
    assert timers.state() == {} and timers.issues().count() == 0
    rules = catalogue({"rule_id": "week"}, {"rule_id": "month", "recheck_days": 30}, {"rule_id": "other", "trigger": "on_change"}, {"rule_id": "elsewhere", "table_name": "u"})
    assert timers.sweep(rules, table(spark, a="", b="", c="x"), DAY.format(1)) == {"week": T.RAN, "month": T.RAN}
    assert found(timers) == {(r, k): (DAY.format(1), None) for r in ("week", "month") for k in "ab"}
    # nothing is due yet, so nothing is known of the change
    assert timers.sweep(rules, table(spark, a="x"), DAY.format(5)) == {"week": T.EARLY, "month": T.EARLY}
    assert len(found(timers)) == 4
    assert timers.acknowledge(spark.createDataFrame([("week", "t", "b"), ("none", "t", "b")], "rule_id string, table_name string, record_id string"), DAY.format(6))
    # the weekly rule: a is mended, b keeps its time and acknowledgement, d is new
    assert timers.sweep(rules, table(spark, a="x", b="", d=""), DAY.format(8)) == {"week": T.RAN, "month": T.EARLY}
    assert found(timers) == {("month", "a"): (DAY.format(1), None), ("month", "b"): (DAY.format(1), None), ("week", "b"): (DAY.format(1), DAY.format(6)), ("week", "d"): (DAY.format(8), None)}
    assert timers.state() == {"week": DAY.format(8), "month": DAY.format(1)}
    # the same sweep again changes nothing
    assert timers.sweep(rules, table(spark), DAY.format(8)) == {"week": T.EARLY, "month": T.EARLY}


def test_a_rule_that_fails_is_due_again_and_stops_no_other(spark, tmp_path, monkeypatch):
    timers = T.TimedRules(spark, f"file://{tmp_path}/t")
    rules = catalogue({"rule_id": "bad", "field_name": "missing"}, {"rule_id": "good"})
    assert timers.sweep(rules, table(spark, a=""), DAY.format(1)) == {"bad": T.FAILED, "good": T.RAN}
    assert timers.state() == {"good": DAY.format(1)}
    assert timers.sweep(catalogue({"rule_id": "bad"}, {"rule_id": "good"}), table(spark, a=""), DAY.format(2)) == {"bad": T.RAN, "good": T.EARLY}
    # a run that fails in a task keeps the time and the issues of the last one
    broken = {"t": spark.range(1).selectExpr("'a' AS id", "raise_error('lost') AS v")}
    assert timers.sweep(catalogue({"rule_id": "good"}), broken, DAY.format(20)) == {"good": T.FAILED}
    assert timers.state()["good"] == DAY.format(1) and ("good", "a") in found(timers)


def test_rivals_and_writers_that_die(spark, tmp_path, monkeypatch):
    timers = T.TimedRules(spark, f"file://{tmp_path}/t")
    both = catalogue({"rule_id": "one"}, {"rule_id": "two"})
    real, rival = T.shared.create, {"left": True}

    def late(session, path, text):
        if rival.pop("left", None):  # another sweep is done just before this one is published
            assert timers.sweep(catalogue({"rule_id": "one"}), table(spark, z=""), DAY.format(2)) == {"one": T.RAN}
        return real(session, path, text)

    monkeypatch.setattr(T.shared, "create", late)
    assert timers.sweep(both, table(spark, a=""), DAY.format(2)) == {"one": T.RIVAL, "two": T.RAN}
    assert set(found(timers)) == {("one", "z"), ("two", "a")}

    def dies(session, path, text):
        raise RuntimeError("lost")

    monkeypatch.setattr(T.shared, "create", dies)
    with pytest.raises(RuntimeError):
        timers.sweep(both, table(spark, b=""), DAY.format(20))
    monkeypatch.setattr(T.shared, "create", real)
    assert set(found(timers)) == {("one", "z"), ("two", "a")}
    assert timers.sweep(both, table(spark, b=""), DAY.format(20)) == {"one": T.RAN, "two": T.RAN}
    assert set(found(timers)) == {("one", "b"), ("two", "b")}
