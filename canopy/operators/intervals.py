"""Subtrees as ranges of numbers, and what lies in them as differences of running sums.

Every node gets its place in pre-order and the last place of its subtree.  Sizes and
places come from doubled steps along the lines of ancestors: after k rounds a node
knows the nodes less than 2**k levels below it, and the sum of the offsets of the
2**k nodes above it.  So a tree of depth d takes some log2(d) joins over its rows, and
neither a pair of a node and an ancestor nor a group of siblings is ever gathered:
sums over earlier siblings are taken from one running sum over rows that are dealt by
ranges.

Nodes on a cycle or below one have no place and are left out; a parent that isn't there
makes a root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.hierarchy import is_root
from canopy.plans.materialise import materialise


def sibling_order() -> list[Column]:
    return [F.asc_nulls_last("ordinal"), F.asc("name"), F.asc("id")]


def running(rows: DataFrame, order: list, values: list[str]) -> DataFrame:
    """The rows with ``<value>_before`` for each value: its sum over all rows that come before in the order.

    Rows are dealt by ranges; each range is summed alone, and gets the sum of the ranges before it (one row a range).
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = dealt.groupBy("_range").agg(*(F.sum(v).alias(v) for v in values))
    starts = sums.select("_range", *(zero(F.sum(v).over(outer)).alias(f"_{v}_start") for v in values))
    summed = dealt.withColumns({f"{v}_before": zero(F.sum(v).over(inner)) for v in values}).join(F.broadcast(starts), "_range")
    return summed.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"_{v}_start") for v in values}).drop("_range", *(f"_{v}_start" for v in values))


def sibling_sums(rows: DataFrame, value: str) -> DataFrame:
    """The rows (id, up, …) with ``offset``: the sum of the value over the siblings before, whatever the number of siblings."""
    summed = running(rows, [F.asc_nulls_first("up"), *sibling_order()], [value])
    first = summed.groupBy(F.col("up").alias("_up")).agg(F.min(f"{value}_before").alias("_first"))
    return summed.join(first, F.col("up").eqNullSafe(F.col("_up"))).withColumn("offset", F.col(f"{value}_before") - F.col("_first")).drop("_up", "_first", f"{value}_before")


def _linked(tree: DataFrame) -> DataFrame:
    """The nodes with ``up``, the parent if it is there."""
    known = tree.select(F.col("id").alias("up"))
    up = tree.where(~is_root()).select(F.col("id").alias("_id"), F.col("parent_id").alias("up")).join(known, "up", "left_semi")
    return tree.join(up, F.col("id") == F.col("_id"), "left").select("id", "up", "ordinal", "name")


def number(tree: DataFrame) -> DataFrame:
    """Rows (id, up, first, last, depth): pre-order places from 1 in the order ordinal (nulls last), name, id; depth 0 for roots."""
    linked = materialise(_linked(tree))
    # sizes: how many nodes are less than ``step`` levels below, itself included
    state = linked.select("id", F.col("up").alias("to"), F.lit(1).cast("long").alias("size"))
    left, rounds = None, 0
    while True:
        below = state.where("to is not null").groupBy(F.col("to").alias("id")).agg(F.sum("size").alias("more"))
        far = state.select(F.col("id").alias("to"), F.col("to").alias("far"))
        state = materialise(state.join(below, "id", "left").join(far, "to", "left").select("id", F.col("far").alias("to"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        rounds += 1
        before, left = left, state.where("to is not null").count()
        if left == 0 or left == before:  # a round without an end: what is left leads into a cycle
            break
    placed = linked.join(state.where("to is null").select("id", "size"), "id")
    offsets = sibling_sums(placed, "size").select("id", "up", "size", (F.col("offset") + 1).alias("sum"))
    # places: sums of the offsets along the line of ancestors
    walk = materialise(offsets.select("id", "up", "size", F.col("up").alias("to"), "sum", F.col("up").isNotNull().cast("long").alias("depth")))
    for _ in range(rounds):  # as many rounds as it took to reach all roots
        far = walk.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("sum").alias("far_sum"), F.col("depth").alias("far_depth"))
        more = walk.join(far, "to", "left")
        going = F.col("to").isNotNull()
        walk = materialise(
            more.select(
                "id", "up", "size", F.col("far").alias("to"),
                F.when(going, F.col("sum") + F.col("far_sum")).otherwise(F.col("sum")).alias("sum"),
                F.when(going, F.col("depth") + F.col("far_depth")).otherwise(F.col("depth")).alias("depth"),
            )
        )
    return walk.select("id", "up", F.col("sum").alias("first"), (F.col("sum") + F.col("size") - 1).alias("last"), "depth")


def inside(pairs: DataFrame, ranges: DataFrame) -> DataFrame:
    """``inside`` for rows (node, top): whether node is top or below it; false for ids that have no place."""
    node = ranges.select(F.col("id").alias("node"), F.col("first").alias("_at"))
    top = ranges.select(F.col("id").alias("top"), F.col("first").alias("_low"), F.col("last").alias("_high"))
    return pairs.join(node, "node", "left").join(top, "top", "left").withColumn("inside", F.coalesce(F.col("_at").between(F.col("_low"), F.col("_high")), F.lit(False))).drop("_at", "_low", "_high")


def subtree_sums(ranges: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """Rows (id, <names>): for every node the sums of ``values`` (node, <names>) over its subtree.

    A sum is the running sum at the subtree's last place less the one before its first.
    """
    per = values.groupBy(F.col("node").alias("id")).agg(*(F.sum(n).alias(n) for n in names))
    # kept before it is dealt by ranges, which are found by a pass of their own
    rows = materialise(ranges.select("id", "first", "last").join(per, "id", "left").na.fill(0, names))
    summed = materialise(running(rows, [F.asc("first")], names))
    ends = summed.select(F.col("first").alias("last"), *((F.col(f"{n}_before") + F.col(n)).alias(f"_{n}") for n in names))
    return summed.join(ends, "last").select("id", *((F.col(f"_{n}") - F.col(f"{n}_before")).alias(n) for n in names))


def covered(ranges: DataFrame, tops: DataFrame) -> DataFrame:
    """Ids of all nodes in the subtree of a top (id), each once; tops may lie within one another."""
    some = ranges.join(tops.select("id").distinct(), "id", "left_semi")
    ends = some.select(F.col("last").alias("end")).groupBy("end").agg(F.count("*").alias("ends"))
    marked = ranges.select("id", "first").join(some.select("id", F.lit(1).alias("begins")), "id", "left").join(ends, F.col("first") == F.col("end"), "left").na.fill(0, ["begins", "ends"])
    open_ = running(marked, [F.asc("first")], ["begins", "ends"])
    return open_.where(F.col("begins_before") + F.col("begins") > F.col("ends_before")).select("id")


def lowest_common(pairs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (a, b) with ``common``, their lowest common ancestor or one of themselves; null if there is none.

    Longest steps first, a climbs as long as it doesn't hold b; the next one up does.
    """
    depth = ranges.agg(F.max("depth")).first()[0] or 0
    jumps, step = [], ranges.select("id", F.col("up").alias("to")).where("to is not null")
    while 2 ** len(jumps) <= depth:
        step = materialise(step.join(step.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to"))) if jumps else step
        jumps.append(step)
    place = ranges.select(F.col("id").alias("b"), F.col("first").alias("_at"))
    span = ranges.select(F.col("id").alias("_top"), F.col("first").alias("_low"), F.col("last").alias("_high"))
    holds = F.col("_at").between(F.col("_low"), F.col("_high"))
    now = pairs.select("a", "b").distinct().join(place, "b").withColumn("at", F.col("a"))
    for jump in reversed(jumps):
        ahead = jump.select(F.col("id").alias("at"), F.col("to").alias("_top")).join(span, "_top")
        now = now.join(ahead, "at", "left").withColumn("at", F.when(F.col("_top").isNotNull() & ~holds, F.col("_top")).otherwise(F.col("at"))).drop("_top", "_low", "_high")
    up = ranges.select(F.col("id").alias("at"), F.col("up").alias("_up"), F.col("first").alias("_low"), F.col("last").alias("_high"))
    found = now.join(up, "at").select("a", "b", F.when(holds, F.col("at")).otherwise(F.col("_up")).alias("common"))
    return pairs.join(found, ["a", "b"], "left")


def common_counts(pairs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (of, common, n): how many of the rows (a, b, of) have each node as the lowest that holds both ends; rows with an end that has no place are left out.

    If neither end holds the other, their parents have the same lowest common node.  So
    all ends climb one step and the rows that are alike by then are counted as one, as
    long as that leaves half of them at most; what is left goes by doubled steps.
    """
    nodes = ranges.select("id", "first", "last", "up")
    side = lambda end: nodes.select(*(F.col(c).alias(end if c == "id" else f"_{end}_{c}") for c in nodes.columns))
    holds = lambda x, y: F.col(f"_{y}_first").between(F.col(f"_{x}_first"), F.col(f"_{x}_last"))
    going, n, before, found = pairs, F.count("*"), None, []
    while True:
        ends = going.join(side("a"), "a").join(side("b"), "b")
        done = F.when(holds("a", "b"), F.col("a")).when(holds("b", "a"), F.col("b"))
        to = [F.when(done.isNull(), F.col(f"_{end}_up")).alias(end) for end in ("a", "b")]
        step = materialise(ends.select("of", done.alias("common"), *to, *(["n"] if before else [])).groupBy("of", "common", "a", "b").agg(n.alias("n")))
        found.append(step.where("common is not null").select("of", "common", "n"))
        going, n = step.where("a is not null and b is not null").select("of", "a", "b", "n"), F.sum("n")
        left = going.count()
        if left == 0:
            break
        if before and left * 2 > before:
            lowest = lowest_common(going.select("a", "b").distinct(), ranges).where("common is not null")
            found.append(going.join(lowest, ["a", "b"]).select("of", "common", "n"))
            break
        before = left
    return reduce(DataFrame.unionByName, found)


#: A dependent's rows and the columns that name a node; a row of two columns counts once if either does.
Dependents = dict[str, tuple[DataFrame, list[str]]]


def delete_preview(tree: DataFrame, ranges: DataFrame, dependents: Dependents) -> DataFrame:
    """What deleting each node would remove: rows (id, parent_id, children, subtree, <dependents>) for every node with a place.

    Rows of two columns count at either end, less once at the lowest node that holds both.
    """
    marks = []
    names = list(dependents)
    zeros = lambda name, n: [n.alias(k) if k == name else F.lit(0).cast("long").alias(k) for k in ["nodes", *names]]
    both = []
    for name, (rows, columns) in dependents.items():
        for column in columns:
            marks.append(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("node")).agg(F.count("*").alias("n")).select("node", *zeros(name, F.col("n"))))
        if len(columns) == 2:
            both.append(rows.select(F.col(columns[0]).alias("a"), F.col(columns[1]).alias("b"), F.lit(names.index(name)).alias("of")))
    if both:
        common = common_counts(reduce(DataFrame.unionByName, both), ranges)
        per = [F.when(F.col("of") == k, -F.col("n")).otherwise(F.lit(0).cast("long")).alias(name) for k, name in enumerate(names)]
        marks.append(common.select(F.col("common").alias("node"), F.lit(0).cast("long").alias("nodes"), *per))
    marks.append(ranges.select(F.col("id").alias("node"), F.lit(1).cast("long").alias("n")).select("node", *zeros("nodes", F.col("n"))))
    sums = subtree_sums(ranges, reduce(DataFrame.unionByName, marks), ["nodes", *names])
    direct = tree.where(~is_root()).groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    out = tree.select("id", "parent_id").join(sums, "id").join(direct, "id", "left").na.fill(0, ["children"])
    return out.select("id", "parent_id", "children", F.col("nodes").alias("subtree"), *names)


def cascade(tree: DataFrame, ranges: DataFrame, tops: DataFrame, dependents: Dependents) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The tree and its dependents without the subtrees of the tops and all rows that name a node there."""
    gone = materialise(covered(ranges, tops)).select(F.col("id").alias("_gone"))
    keep = lambda rows, column: rows.join(gone, F.col(column) == F.col("_gone"), "left_anti")
    return keep(tree, "id"), {name: reduce(keep, columns, rows) for name, (rows, columns) in dependents.items()}


def pages(tree: DataFrame, size: int = 100) -> DataFrame:
    """Rows (id, up, place, page, total) of all nodes among their siblings, from one pass over ranges of rows."""
    placed = sibling_sums(_linked(tree).withColumn("one", F.lit(1).cast("long")), "one")
    totals = placed.groupBy(F.col("up").alias("_up")).agg(F.count("*").alias("total"))
    return placed.join(totals, F.col("up").eqNullSafe(F.col("_up"))).select("id", "up", (F.col("offset") + 1).alias("place"), F.floor(F.col("offset") / size).alias("page"), "total")


def page_after(tree: DataFrame, parent: str | None, after: dict | None = None, limit: int = 100) -> DataFrame:
    """The next rows behind the last one (ordinal, name, id) of the page before, with ``left``: how many more there are behind each.

    Only rows behind that key are looked at, and each task keeps ``limit`` of them, so a
    late page of a parent with millions of children costs no more than the first.
    """
    rows = tree.where(F.col("parent_id") == parent) if parent else tree.where(is_root())
    if after is not None:
        rows = rows.where(_behind(after))
    counted = rows.agg(F.count("*").alias("n")).scalar()
    page = rows.orderBy(*sibling_order()).limit(limit)
    order = Window.partitionBy(F.lit(0)).orderBy(*sibling_order())  # over the page alone
    return page.withColumn("left", counted - F.row_number().over(order))


def _behind(key: dict) -> Column:
    name, ident = F.lit(key["name"]), F.lit(key["id"])
    later = (F.col("name") > name) | ((F.col("name") == name) & (F.col("id") > ident))
    if key.get("ordinal") is None:
        return F.col("ordinal").isNull() & later
    ordinal = F.lit(key["ordinal"])
    return F.col("ordinal").isNull() | (F.col("ordinal") > ordinal) | ((F.col("ordinal") == ordinal) & later)
