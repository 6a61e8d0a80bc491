"""Closures and issues kept up to date by batches of edits against those that are built anew."""

import random

from canopy.operators import hierarchy as H
from canopy.operators import maintained, rules

RANKS = ["FAMILY", "GENUS", "SPECIES", "SUBSPECIES", "ORDER"]


def tables(spark, up, facts):
    taxon = spark.createDataFrame([(k, p, f"n{k}") for k, p in up.items()], "id string, parent_id string, name_id string")
    names = spark.createDataFrame([(f"n{k}", *facts(k)) for k in up], "id string, rank_id string, code_id string, published_in_year string")
    return taxon, names


def test_a_stream_of_moves_equals_a_rebuild(spark):
    dice = random.Random(8)
    up = {f"t{i}": (f"t{dice.randrange(i)}" if i else None) for i in range(40)} | {"lost": "t99"}
    facts = lambda k: (RANKS[hash_of(k) % 5], "ZOOLOGICAL", str(1800 + hash_of(k) * 7 % 100))
    taxon, names = tables(spark, up, facts)
    pairs = H.closure(taxon)
    issues = {tuple(r) for r in rules.taxon_violations(taxon, names).collect()}
    for step in range(4):
        for _ in range(3):
            up[dice.choice(list(up))] = dice.choice([*up, None, "nowhere"])  # cycles too
        for k in dice.sample(list(up), 2):
            del up[k]
        up[f"new{step}"] = dice.choice(list(up))
        if step == 1:
            up["t99"] = dice.choice(list(up))  # a parent that was missing
        after, names = tables(spark, up, facts)
        pairs, touched = maintained.closure_after(pairs, taxon, after)
        assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in H.closure(after).collect()}
        some = {r["id"] for r in touched.collect()}
        found = rules.taxon_violations(after, names, pairs, touched).collect()
        assert {r["record_id"] for r in found} <= some
        issues = {i for i in issues if i[1] not in some} | {tuple(r) for r in found}
        assert issues == {tuple(r) for r in rules.taxon_violations(after, names).collect()}
        taxon = after


def hash_of(key):
    return sum(map(ord, key)) * 31 % 101


def test_nothing_changed(spark):
    taxon, _ = tables(spark, {"a": None, "b": "a"}, lambda k: ("GENUS", "", ""))
    pairs, touched = maintained.closure_after(H.closure(taxon), taxon, taxon)
    assert touched.isEmpty() and [tuple(r) for r in pairs.collect()] == [("b", "a", 1)]
