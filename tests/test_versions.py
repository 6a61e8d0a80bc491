"""Compound edits: at once or not at all, rivals, writers that die."""

import pytest

from canopy.operators import edits
from canopy.operators.versions import Versions

NAME, TAXON = "id string, label string, modified string, modified_by string", "id string, name_id string, modified string, modified_by string"
E_NAME, E_TAXON = "edit string, op string, id string, label string, expected string", "edit string, op string, id string, name_id string, expected string"


@pytest.fixture
def store(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/v", [("taxon", "name_id", "name")])
    store.create({"name": spark.createDataFrame([("n1", "a", "1", "x"), ("n2", "b", "1", "x")], NAME), "taxon": spark.createDataFrame([("t1", "n1", "1", "x"), ("t2", None, "1", "x")], TAXON)})
    return store


def batch(spark, names=(), taxa=()):
    return {"name": spark.createDataFrame(list(names), E_NAME), "taxon": spark.createDataFrame(list(taxa), E_TAXON)}


def outcomes(checked):
    return {(t, r["edit"], r["id"]): r["outcome"] for t, rows in checked.items() for r in rows.collect()}


def content(store, version=None):
    return {t: {tuple(r)[:2] for r in rows.collect()} for t, rows in store.read(version).items()}


def test_edits_are_whole(spark, store):
    got = outcomes(
        store.commit(
            batch(
                spark,
                [("good", "create", "n3", "c", ""), ("late", "create", "n4", "d", ""), ("used", "delete", "n1", None, "1"), ("free", "delete", "n2", None, "1"), ("twice", "create", "n9", "i", ""), ("again", "create", "n9", "j", "")],
                [("good", "update", "t2", "n3", "1"), ("late", "create", "t4", "n4", ""), ("late", "update", "t1", "n4", "0"), ("lost", "create", "t5", "nowhere", ""), ("leans", "create", "t6", "n4", "")],
            ),
            "me",
            "2",
        )
    )
    assert got == {
        ("name", "good", "n3"): "applied", ("taxon", "good", "t2"): "applied", ("name", "late", "n4"): "incomplete", ("taxon", "late", "t4"): "incomplete", ("taxon", "late", "t1"): "conflict",
        ("name", "used", "n1"): "in_use", ("name", "free", "n2"): "applied", ("taxon", "lost", "t5"): "dangling", ("taxon", "leans", "t6"): "dangling", ("name", "twice", "n9"): "repeated", ("name", "again", "n9"): "repeated",
    }
    assert content(store) == {"name": {("n1", "a"), ("n3", "c")}, "taxon": {("t1", "n1"), ("t2", "n3")}}
    assert content(store, 0) == {"name": {("n1", "a"), ("n2", "b")}, "taxon": {("t1", "n1"), ("t2", None)}}
    assert store.compact() and content(store) == content(store, 1)
    store.commit(batch(spark, [("back", "create", "n2", "b2", "")], [("off", "delete", "t2", None, "2")]), "me", "3")
    assert content(store) == {"name": {("n1", "a"), ("n3", "c"), ("n2", "b2")}, "taxon": {("t1", "n1")}}


def test_rivals_and_crashes(spark, store, monkeypatch):
    rival, publish = Versions(spark, store.folder, store.links), store._publish
    first = []

    def late(version, entry):
        if not first:
            first.append(outcomes(rival.commit(batch(spark, [("r", "update", "n1", "rival", "1")], [("r", "update", "t2", "n2", "1")]), "you", "2")))
        return publish(version, entry)

    monkeypatch.setattr(store, "_publish", late)
    got = outcomes(store.commit(batch(spark, [("mine", "update", "n2", "mine", "1"), ("same", "update", "n1", "lost", "1")], [("same", "create", "t3", "n1", "")]), "me", "2"))
    assert set(first[0].values()) == {"applied"}
    assert got == {("name", "mine", "n2"): "applied", ("name", "same", "n1"): "conflict", ("taxon", "same", "t3"): "incomplete"}
    assert content(store) == {"name": {("n1", "rival"), ("n2", "mine")}, "taxon": {("t1", "n1"), ("t2", "n2")}}
    before = content(store)

    def dies(version, entry):
        raise OSError("the machine went away")

    monkeypatch.setattr(store, "_publish", dies)
    with pytest.raises(OSError):
        store.commit(batch(spark, [("x", "create", "n7", "x", "")], [("x", "create", "t7", "n7", "")]), "me", "3")
    assert content(rival) == before
    monkeypatch.undo()
    with pytest.raises(edits.VersionConflict):
        store.create({"name": spark.createDataFrame([], NAME)})
