"""State that is written batch by batch: issue stores, streams of changes and versioned tables."""

import threading

import pytest
from pyspark.sql import functions as F

from canopy.operators import edits
from canopy.operators import validation as V
from canopy.sources import shared
from canopy.streaming import changes


def found(spark, rows):
    return spark.createDataFrame(rows, V.VIOLATION)


def test_merge_takes_the_most_severe_with_its_value(spark):
    new = found(spark, [("t", "1", "r", "f", "error", "a"), ("t", "1", "r", "f", "warn", "z"), ("t", "2", "r", "f", "info", "b"), ("t", "2", "r", "f", "info", "c")])
    store = spark.createDataFrame([], "table_name string, record_id string, rule_id string, field_name string, created_at string, acknowledged_at string")
    got = {r["record_id"]: (r["severity"], r["actual_value"]) for r in V.merge_issues(store, new, "now").collect()}
    assert got == {"1": ("error", "a"), "2": ("info", "c")}


def test_merge_prunes_within_its_scope(spark):
    store = V.merge_issues(
        spark.createDataFrame([], "table_name string, record_id string, rule_id string, field_name string, created_at string, acknowledged_at string"),
        found(spark, [("t", k, "r", "f", "warn", "x") for k in ("1", "2", "3")]),
        "old",
    )
    scope = spark.createDataFrame([("t", "1"), ("t", "2")], "table_name string, record_id string")
    got = {(r["record_id"], r["created_at"]) for r in V.merge_issues(store, found(spark, [("t", "2", "r", "f", "error", "y")]), "new", scope).collect()}
    assert got == {("2", "old"), ("3", "old")}


def test_a_record_that_was_fixed_has_no_issues(spark, tmp_path):
    rules = V.load_rules([{"rule_id": "named", "field": "name", "mechanism": "presence"}])

    def run():
        changes.validate_changes(
            changes.changes(spark, f"file://{tmp_path}/in", "id bigint, name string"),
            lambda b: V.row_local("t", b, "id", rules).unionByName(V.row_local("u", b, "id", rules)),
            lambda b: b.select(F.explode(F.array(F.lit("t"), F.lit("u"))).alias("table_name"), F.col("id").alias("record_id")),
            f"file://{tmp_path}/issues",
            f"file://{tmp_path}/cp",
        ).awaitTermination()
        return {(r["table_name"], r["record_id"]) for r in changes.latest_violations(spark, f"file://{tmp_path}/issues", V.VIOLATION).collect()}

    write = lambda rows: spark.createDataFrame(rows, "id bigint, name string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    write([(1, ""), (2, ""), (3, "x")])
    assert run() == {(t, i) for t in "tu" for i in ("1", "2")}
    write([(1, "fixed"), (3, "")])
    assert run() == {(t, i) for t in "tu" for i in ("2", "3")}


def table(spark, tmp_path):
    store = edits.VersionedTable(spark, f"file://{tmp_path}/t")
    store.write(spark.createDataFrame([(1, "a", "1", "x"), (2, "b", "1", "x")], "id int, name string, modified string, modified_by string"), 0)
    return store


def change(spark, key, name, expected=""):
    return spark.createDataFrame([(key, "update", name, expected)], "id int, op string, name string, expected string")


def test_versions_are_read_by_number(spark, tmp_path):
    store = table(spark, tmp_path)
    store.commit(change(spark, 1, "new"), "me", "2")
    assert {r["name"] for r in store.read(0).collect()} == {"a", "b"}
    assert {r["name"] for r in store.read().collect()} == {"new", "b"}
    with pytest.raises(edits.VersionConflict):
        store.write(store.read(0), 1)


def test_no_writer_loses_an_update(spark, tmp_path):
    """Two writers start from one version: both changes are kept, and a stale stamp is a conflict."""
    store, held = table(spark, tmp_path), threading.Event()
    slow = edits.VersionedTable(spark, store.folder)
    real = slow.write

    def write(rows, version):
        held.wait(60)
        return real(rows, version)

    slow.write = write
    outcome = []
    other = threading.Thread(target=lambda: outcome.append(slow.commit(change(spark, 1, "slow", "1").unionByName(change(spark, 2, "stale", "1")), "b", "3").collect()))
    other.start()
    store.commit(change(spark, 2, "quick", "1"), "a", "2")
    held.set()
    other.join(120)
    assert {(r["id"], r["name"]) for r in store.read().collect()} == {(1, "slow"), (2, "quick")}
    assert {(r["id"], r["outcome"]) for r in outcome[0]} == {(1, "applied"), (2, "conflict")}


def test_a_field_can_be_emptied(spark, tmp_path):
    store = table(spark, tmp_path)
    store.commit(change(spark, 1, None).withColumn("fields", F.array(F.lit("name"))), "me", "2")
    store.commit(change(spark, 2, None), "me", "3")
    assert {r["id"]: r["name"] for r in store.read().collect()} == {1: None, 2: "b"}


def test_a_begun_file_blocks_nobody(spark, tmp_path):
    """A writer that dies before it publishes leaves a draft; readers and writers go on."""
    store = table(spark, tmp_path)
    (tmp_path / "t" / "log" / ".000000000001.json.dead").write_text("")
    assert store.versions() == [0]
    assert {r["outcome"] for r in store.commit(spark.createDataFrame([(1, "update", "z", "1")], "id int, op string, name string, expected string"), "me", "2").collect()} == {"applied"}
    assert store.versions() == [0, 1] and store.read().where("id = 1").first()["name"] == "z"


def test_one_of_many_writers_creates_a_file(spark, tmp_path):
    won, path = [], f"file://{tmp_path}/one/file.json"
    writers = [threading.Thread(target=lambda i=i: won.append((shared.create(spark, path, str(i)), i))) for i in range(8)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert [str(i) for ok, i in won if ok] == [shared.read(spark, path)]
    assert [x.name for x in (tmp_path / "one").iterdir()] == ["file.json"]


def test_result_ids_are_kept(spark):
    """Known issues keep their id, new ones get one that is the same when it is made again, another at another time."""
    rows = found(spark, [("t", "1", "r", "f", "warn", "a"), ("t", "2", "r", "f", "warn", "b")])
    first = V.merge_issues(spark.createDataFrame([], V.VIOLATION + ", result_id string, created_at string, acknowledged_at string"), rows, "then")
    ids = {r["record_id"]: r["result_id"] for r in first.collect()}
    assert len(set(ids.values())) == 2 and ids == {r["record_id"]: r["result_id"] for r in first.collect()}
    later = {r["record_id"]: r["result_id"] for r in V.merge_issues(first.where("record_id = '1'"), rows, "now").collect()}
    assert later["1"] == ids["1"] and later["2"] not in ids.values()
    scope = spark.createDataFrame([("t", "2")], "table_name string, record_id string")
    assert {r["result_id"] for r in V.merge_issues(first, rows.where("record_id = '2'"), "now", scope).collect()} == set(ids.values())
