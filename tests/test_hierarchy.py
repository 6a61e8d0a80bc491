"""The demonstration tree: order, ancestors, moves, deletes, cycles."""

import pytest
from pyspark.sql import functions as F

from canopy.operators import hierarchy as H

ROWS = [
    ("animalia", None, "KINGDOM"), ("chordata", "animalia", "PHYLUM"), ("mammalia", "chordata", "CLASS"), ("carnivora", "mammalia", "ORDER"),
    ("felidae", "carnivora", "FAMILY"), ("panthera", "felidae", "GENUS"), ("leo", "panthera", "SPECIES"), ("tigris", "panthera", "SPECIES"),
    ("felis", "felidae", "GENUS"), ("catus", "felis", "SPECIES"), ("smilodon", "felidae", "GENUS"), ("other", "", "KINGDOM"),
]
TREE = "id string, parent_id string, ordinal int, name string, rank string"


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([(i, p, 1 if i == "smilodon" else None, i.title(), r) for i, p, r in ROWS], TREE)


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_children_and_roots(tree):
    assert set(ids(H.children(tree))) == {"animalia", "other"}
    page = H.children_page(tree, "felidae").orderBy("ordinal", "name").collect()
    assert {(r["id"], r["has_children"]) for r in page} == {("smilodon", False), ("felis", True), ("panthera", True)}
    assert ids(H.children_page(tree, "felidae", 0, 1)) == ["smilodon"]  # set ordinals come first
    assert ids(H.children_page(tree, "felidae", 1, 1)) == ["felis"]


def test_lines_and_counts(tree):
    pairs = H.closure(tree)
    line = H.classification(tree, pairs).where("id = 'leo'").orderBy("position")
    assert ids(line, "node") == ["animalia", "chordata", "mammalia", "carnivora", "felidae", "panthera", "leo"]
    counts = {r["id"]: (r["descendants"], r["children"]) for r in H.descendant_counts(tree, pairs).collect()}
    assert counts["felidae"] == (6, 3) and counts["leo"] == (0, 0) and counts["animalia"] == (10, 1)


def test_moves(tree):
    assert {r["parent_id"] for r in H.move(tree, "catus", "panthera").where("id = 'catus'").collect()} == {"panthera"}
    for below in ("panthera", "leo"):
        with pytest.raises(H.CycleError):
            H.move(tree, "panthera", below)


def test_deletes(tree):
    assert "leo" not in ids(H.delete_leaf(tree, "leo"))
    with pytest.raises(H.HasChildren):
        H.delete_leaf(tree, "felis")
    left = {r["id"]: r["parent_id"] for r in H.reparent_and_delete(tree, "panthera").collect()}
    assert "panthera" not in left and left["leo"] == left["tigris"] == "felidae"
    assert set(ids(H.cascade_delete(tree, "felidae"))) == {"animalia", "chordata", "mammalia", "carnivora", "other"}


def test_cyclic_data_ends(spark):
    rows = [("a", "c"), ("b", "a"), ("c", "b"), ("d", "a"), ("self", "self"), ("lost", "nowhere")]
    tree = spark.createDataFrame([(i, p, None, i, "") for i, p in rows], TREE)
    assert set(ids(H.cycle_nodes(tree))) == {"a", "b", "c", "self"}
    assert {(r["id"], r["ancestor"]) for r in H.closure(tree).collect()} == {("a", "c"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "a"), ("d", "a"), ("d", "c"), ("d", "b")}


def chain(name, n, top=None):
    return [(f"{name}{i}", f"{name}{i + 1}" if i + 1 < n else top) for i in range(n)]


def test_only_cycles_are_cycles(spark):
    """Chains of any length lie on none, and tails into a cycle don't either."""
    edges = [e for n in range(1, 41) for e in chain(f"c{n}_", n)]
    edges += chain("ring", 7, "ring0") + chain("pair", 2, "pair0") + [("self", "self")] + chain("tail", 23, "ring3") + chain("twig", 5, "tail9") + chain("to_self", 9, "self") + chain("lost", 12, "nowhere")
    tree = spark.createDataFrame([(i, p, None, i, "") for i, p in edges], TREE)
    assert set(ids(H.cycle_nodes(tree))) == {*(f"ring{i}" for i in range(7)), "pair0", "pair1", "self"}
    for n in (1, 2, 3, 4, 5, 10, 40):
        assert ids(H.cycle_nodes(tree.where(F.col("id").startswith(f"c{n}_")))) == []


def test_empty_tree(spark):
    tree = spark.createDataFrame([], TREE)
    assert H.closure(tree).collect() == H.cycle_nodes(tree).collect() == H.children(tree).collect() == []
