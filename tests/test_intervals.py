"""Ranges, sums over subtrees, cascades and pages against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import hierarchy as H
from canopy.operators import intervals as I

TREE = "id string, parent_id string, ordinal int, name string, rank string"


def rows_of(kind):
    dice = random.Random(kind)
    if kind == "chain":
        return [(f"n{i}", f"n{i - 1}" if i else None, None, f"n{i}", "") for i in range(70)]
    if kind == "star":
        return [("top", None, None, "top", "")] + [(f"n{i}", "top", dice.choice([None, 1, 2]), f"x{i % 7}", "") for i in range(60)]
    out = [(f"n{i}", f"n{dice.randrange(i)}" if i > 3 else dice.choice([None, ""]), dice.choice([None, 1, 2]), f"x{dice.randrange(9)}", "") for i in range(60)]
    if kind == "cyclic":
        out += [("c0", "c2", None, "c", ""), ("c1", "c0", None, "c", ""), ("c2", "c1", None, "c", ""), ("c3", "c1", None, "c", ""), ("c4", "c3", None, "c", ""), ("me", "me", None, "c", ""), ("lost", "nowhere", None, "c", "")]
    return out


def below_of(rows):
    """Children by parent in order; a parent that isn't there makes a root."""
    ids = {r[0] for r in rows}
    out = {}
    for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[3], r[0])):
        out.setdefault(r[1] if r[1] in ids else None, []).append(r[0])
    return out


def members(below, top):
    return [top] + [x for c in below.get(top, []) for x in members(below, c)]


@pytest.mark.parametrize("kind", ["chain", "star", "bush", "cyclic"])
def test_numbers_are_pre_order(spark, kind):
    rows = rows_of(kind)
    below = below_of(rows)
    order = [x for top in below[None] for x in members(below, top)]
    got = {r["id"]: (r["first"], r["last"], r["depth"]) for r in I.number(spark.createDataFrame(rows, TREE).repartition(5)).collect()}
    assert list(sorted(got, key=got.get)) == order and [got[x][0] for x in order] == list(range(1, len(order) + 1))
    up = {c: p for p, cs in below.items() for c in cs}
    for x in order:
        depth, at = 0, x
        while up[at] is not None:
            depth, at = depth + 1, up[at]
        assert got[x][1] - got[x][0] + 1 == len(members(below, x)) and got[x][2] == depth


def test_preview_and_cascade(spark):
    rows = rows_of("bush")
    below, dice = below_of(rows), random.Random(1)
    tree = spark.createDataFrame(rows, TREE)
    ids = [r[0] for r in rows]
    single = [dice.choice([*ids, "gone", None]) for _ in range(150)]
    double = [(k, dice.choice(ids), dice.choice([*ids, None, "gone"])) for k in range(150)] + [(500, "n7", "n7")]
    dependents = {"notes": (spark.createDataFrame([(x,) for x in single], "node string"), ["node"]), "links": (spark.createDataFrame(double, "k int, a string, b string"), ["a", "b"])}
    ranges = I.number(tree)
    got = {r["id"]: tuple(r)[2:] for r in I.delete_preview(tree, ranges, dependents).collect()}
    for x in ids:
        inside = set(members(below, x))
        assert got[x] == (len(below.get(x, [])), len(inside), sum(s in inside for s in single), sum(a in inside or b in inside for _, a, b in double))
    tops = ["n5", "n9", "n40", "absent"]
    inside = {y for t in tops[:3] for y in members(below, t)}
    assert sorted(r["id"] for r in I.covered(ranges, spark.createDataFrame([(t,) for t in tops * 2], "id string")).collect()) == sorted(inside)
    left, tables = I.cascade(tree, ranges, spark.createDataFrame([(t,) for t in tops], "id string"), dependents)
    assert {r["id"] for r in left.collect()} == set(ids) - inside
    assert sorted(r["k"] for r in tables["links"].collect()) == [k for k, a, b in double if a not in inside and b not in inside]
    assert tables["notes"].count() == sum(s not in inside for s in single)


def test_lowest_common_and_inside(spark):
    rows = rows_of("bush")
    below = below_of(rows)
    ids = [r[0] for r in rows]
    holds = {x: set(members(below, x)) for x in ids}
    dice = random.Random(2)
    pairs = [(dice.choice(ids), dice.choice(ids)) for _ in range(80)] + [("n5", "n5"), ("n5", "gone")]
    ranges = I.number(spark.createDataFrame(rows, TREE))
    for r in I.lowest_common(spark.createDataFrame(pairs, "a string, b string"), ranges).collect():
        both = [x for x in ids if r["a"] in holds[x] and r["b"] in holds[x]]
        assert r["common"] == min(both, key=lambda x: len(holds[x]), default=None)
    for r in I.inside(spark.createDataFrame(pairs, "node string, top string"), ranges).collect():
        assert r["inside"] == (r["node"] in holds.get(r["top"], ()))


@pytest.mark.parametrize("kind", ["chain", "bush", "cyclic"])
def test_closure_by_doubling(spark, kind):
    rows = rows_of(kind)
    if kind == "cyclic":
        rows += [(f"t{i}", f"t{i + 1}" if i < 22 else "r0", None, "t", "") for i in range(23)] + [(f"r{i}", f"r{(i + 1) % 7}", None, "r", "") for i in range(7)]
    ids = {r[0] for r in rows}
    up = {r[0]: r[1] for r in rows if r[1] in ids and r[1] != r[0]}
    want = set()
    for x in ids:
        at, seen, depth = x, {x}, 0
        while (at := up.get(at)) is not None and at not in seen:
            depth += 1
            seen.add(at)
            want.add((x, at, depth))
    tree = spark.createDataFrame(rows, TREE)
    got = H.closure(tree).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    some = {r[0] for r in rows[::7]} | {"c4", "t0", "me"}
    got = H.closure(tree, spark.createDataFrame([(x,) for x in some], "id string")).collect()
    assert {tuple(r) for r in got} == {w for w in want if w[0] in some} and len(got) == len({tuple(r) for r in got})


def test_pages(spark):
    rows = rows_of("star")
    tree = spark.createDataFrame(rows, TREE).repartition(4)
    order = below_of(rows)["top"]
    got = {r["id"]: (r["place"], r["page"], r["total"]) for r in I.pages(tree, 7).where("up = 'top'").collect()}
    assert got == {x: (i + 1, i // 7, 60) for i, x in enumerate(order)}
    seen, after = [], None
    while True:
        page = I.page_after(tree, "top", after, 7).collect()
        if not page:
            break
        assert [r["left"] for r in page] == [60 - len(seen) - k - 1 for k in range(len(page))]
        seen += [r["id"] for r in page]
        after = page[-1].asDict()
    assert seen == order
    assert [r["id"] for r in I.page_after(tree, None).collect()] == ["top"]


def test_nothing(spark):
    tree = spark.createDataFrame([], TREE)
    assert I.number(tree).collect() == I.pages(tree).collect() == I.page_after(tree, None).collect() == []
    assert I.delete_preview(tree, I.number(tree), {"x": (spark.createDataFrame([("a",)], "n string"), ["n"])}).collect() == []


def test_long_chain_in_few_rounds(spark):
    """100,000 levels; a join a level would never end."""
    tree = spark.range(100_000).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent_id"))
    got = H.closure(tree, spark.createDataFrame([("n99999",), ("n3",)], "id string"))
    assert got.groupBy("id").agg(F.count("*").alias("n"), F.max("depth").alias("d")).orderBy("id").collect() == [("n3", 3, 3), ("n99999", 99_999, 99_999)]


def test_common_nodes_are_counted_as_pairs_climb(spark, monkeypatch):
    """Pairs of leaves with few parents climb together; lines that don't meet soon go by doubled steps; ends without a place are left out."""
    for kind, doubled in (("star", False), ("two", True)):
        rows = rows_of("star") if kind == "star" else [("top", None, None, "t", "")] + [(f"{s}{i}", f"{s}{i - 1}" if i else "top", None, "x", "") for s in "ab" for i in range(9)]
        below, dice = below_of(rows), random.Random(3)
        ids = [r[0] for r in rows]
        holds = {x: set(members(below, x)) for x in ids}
        pairs = [(dice.choice(ids), dice.choice([*ids, None, "gone"]), k % 2) for k in range(300)]
        asked, lowest = [], I.lowest_common
        monkeypatch.setattr(I, "lowest_common", lambda *a: asked.append(1) or lowest(*a))
        got = {}
        for r in I.common_counts(spark.createDataFrame(pairs, "a string, b string, of int"), I.number(spark.createDataFrame(rows, TREE))).collect():
            got[r["of"], r["common"]] = got.get((r["of"], r["common"]), 0) + r["n"]
        monkeypatch.undo()
        want = {}
        for a, b, of in pairs:
            if b in holds:
                key = of, min((x for x in ids if a in holds[x] and b in holds[x]), key=lambda x: len(holds[x]))
                want[key] = want.get(key, 0) + 1
        assert got == want and bool(asked) == doubled
