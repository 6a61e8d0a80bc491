"""Hierarchy queries over an adjacency list (id, parent_id, ...).

All operators take whole trees.  A parent that is null or empty marks a root.
Cyclic data terminates; no node is its own ancestor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.plans.materialise import materialise


class CycleError(ValueError):
    """A node would become its own ancestor."""


class HasChildren(ValueError):
    """A node with children can't be deleted alone."""


def is_root(parent: str = "parent_id") -> Column:
    return F.col(parent).isNull() | (F.col(parent) == "")


def with_has_children(nodes: DataFrame, tree: DataFrame, few: bool = False) -> DataFrame:
    """The nodes with ``has_children``; of ``few`` nodes only their own children are grouped."""
    below = tree.where(~is_root())
    if few:
        below = below.join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    parents = below.select(F.col("parent_id").alias("_p")).distinct()
    return nodes.join(parents, nodes["id"] == parents["_p"], "left").withColumn("has_children", F.col("_p").isNotNull()).drop("_p")


def children(tree: DataFrame, parent: str | None = None) -> DataFrame:
    """Children of a node, or the roots, with ``has_children``."""
    some = tree.where(F.col("parent_id") == parent) if parent else tree.where(is_root())
    return with_has_children(some, tree)


def children_page(tree: DataFrame, parent: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page in the total order ordinal (nulls last), name, id; only the page's rows are kept by each task."""
    page = tree.where(F.col("parent_id") == parent) if parent else tree.where(is_root())
    page = page.orderBy(F.asc_nulls_last("ordinal"), "name", "id").offset(offset).limit(limit)
    return with_has_children(page, tree, few=True)


def children_total(tree: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows (id, total): how many children each node in ``parents`` (id) has over all its pages."""
    counts = tree.where(~is_root()).groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("total"))
    return parents.select("id").join(counts, "id", "left").na.fill(0, ["total"])


def reveal(tree: DataFrame, pairs: DataFrame, nodes: DataFrame, limit: int = 100) -> DataFrame:
    """The way from the root to each of ``nodes`` (id): rows (id, step, node, page), with the page of its siblings that shows each node on it."""
    line = pairs.unionByName(tree.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))).join(nodes.select("id").distinct(), "id", "left_semi")
    order = Window.partitionBy(F.coalesce("parent_id", F.lit(""))).orderBy(F.asc_nulls_last("ordinal"), "name", "id")
    tops = line.select(F.col("ancestor").alias("node")).distinct()
    siblings = tops.join(tree.select(F.col("id").alias("node"), F.coalesce("parent_id", F.lit("")).alias("_up")), "node").select("_up").distinct()
    placed = tree.join(siblings, F.coalesce("parent_id", F.lit("")) == F.col("_up"), "left_semi").select(F.col("id").alias("ancestor"), F.floor((F.row_number().over(order) - 1) / limit).cast("int").alias("page"))
    step = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("depth")))
    return line.join(placed, "ancestor").select("id", step.alias("step"), F.col("ancestor").alias("node"), "page")


def children_of_all(tree: DataFrame, parents: DataFrame, limit: int = 100) -> DataFrame:
    """The first page of every node in ``parents`` (id), with the position in it."""
    order = Window.partitionBy("parent_id").orderBy(F.asc_nulls_last("ordinal"), "name", "id")
    some = tree.join(parents.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return with_has_children(some.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit), tree)


def _edges(tree: DataFrame) -> DataFrame:
    """Rows (id, to) from each node to its parent, if that is there and another one."""
    known = tree.select(F.col("id").alias("to"))
    return tree.where(~is_root() & (F.col("id") != F.col("parent_id"))).select("id", F.col("parent_id").alias("to")).join(known, "to", "left_semi").select("id", "to")


def _doubled(jump: DataFrame) -> DataFrame:
    return jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to"))


def closure(tree: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """All pairs (id, ancestor, depth) with depth from 1, for all nodes or those in ``start`` (id).

    Steps are doubled: pairs of up to 2**k levels and the step of 2**k levels give those
    of up to 2**(k + 1), each once, so a tree of depth d takes some log2(d) joins.  Only
    rows that lead into a cycle can come again; they are told by a round in which no
    step ends, and from then on each pair is kept with its least depth.  A node is no
    ancestor of its own.
    """
    jump = materialise(_edges(tree))
    if start is not None:
        return _lines(jump, start)
    pairs, step, left, cyclic = jump.select("id", F.col("to").alias("ancestor"), F.lit(1).alias("depth")), 1, jump.count(), False
    known = 0
    while left:
        ahead = jump.join(pairs.select(F.col("id").alias("to"), "ancestor", (F.col("depth") + step).alias("depth")), "to").select("id", "ancestor", "depth")
        pairs = pairs.union(jump.select("id", F.col("to").alias("ancestor"), F.lit(step).alias("depth"))) if step > 1 and cyclic else pairs
        pairs = pairs.union(ahead)
        if cyclic:
            pairs = pairs.where("id <> ancestor").groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))
        pairs, jump, step = materialise(pairs), materialise(_doubled(jump)), step * 2
        before, left = left, jump.count()
        if left == before and left:
            now = pairs.join(jump.select("id"), "id", "left_semi").select("id", "ancestor").distinct().count()
            if cyclic and now == known:
                break
            cyclic, known = True, now
    return pairs.select("id", "ancestor", "depth")


def _lines(jump: DataFrame, start: DataFrame) -> DataFrame:
    """Pairs of the nodes of ``start`` alone: steps of all lengths, the longest taken first."""
    jumps, left = [], jump.count()
    while left:
        jumps.append(jump)
        jump = materialise(_doubled(jump))
        before, left = left, jump.count()
        if left == before and 2 ** len(jumps) > left:  # all that is left leads into a cycle and has been around it
            break
    some = start.select("id").distinct()
    pairs = some.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    for k in reversed(range(len(jumps))):
        ahead = pairs.join(jumps[k].select(F.col("id").alias("ancestor"), "to"), "ancestor").select("id", F.col("to").alias("ancestor"), (F.col("depth") + 2**k).alias("depth"))
        pairs = materialise(pairs.union(ahead))
    return pairs.where("id <> ancestor").groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))


def classification(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every node's line from the root down, the node itself last: (id, position, node, name, rank)."""
    line = pairs.unionByName(tree.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    order = Window.partitionBy("id").orderBy(F.desc("depth"))
    named = tree.select(F.col("id").alias("ancestor"), "name", "rank")
    return line.join(named, "ancestor").select("id", F.row_number().over(order).alias("position"), F.col("ancestor").alias("node"), "name", "rank")


def descendant_counts(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """Number of descendants (without the node) and of children of every node."""
    counts = pairs.groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("depth") == 1).alias("c"))
    return tree.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("descendants"), F.coalesce("c", F.lit(0)).alias("children"))


def is_descendant(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """``inside`` for rows (node, top): whether node is top or below it."""
    hit = pairs.select(F.col("id").alias("node"), F.col("ancestor").alias("top"), F.lit(True).alias("_hit"))
    return candidates.join(hit, ["node", "top"], "left").withColumn("inside", (F.col("node") == F.col("top")) | F.col("_hit").isNotNull()).drop("_hit")


def subtree(tree: DataFrame, top: str) -> DataFrame:
    """Ids of a node and all below it, level by level; other branches aren't walked."""
    found = front = materialise(tree.where(F.col("id") == top).select("id"))
    while not front.isEmpty():
        below = tree.join(front.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
        front = materialise(below.join(found, "id", "left_anti").distinct())
        found = materialise(found.union(front))
    return found


def delete_preview(tree: DataFrame, tops: DataFrame, pairs: DataFrame, dependents: dict[str, DataFrame]) -> DataFrame:
    """What deleting each top (id) would remove: children, descendants with itself, and rows of each dependent (node)."""
    members = pairs.join(tops.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("ancestor").alias("top"), F.col("id").alias("node"))
    members = members.union(tops.select(F.col("id"), F.col("id")))
    out = tops.select("id").join(members.groupBy(F.col("top").alias("id")).agg(F.count("*").alias("subtree")), "id")
    direct = tree.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    out = out.join(direct, "id", "left")
    for name, rows in dependents.items():
        counts = rows.groupBy("node").agg(F.count("*").alias("n"))  # before the join, so a hot node is one row
        per = members.join(counts, "node").groupBy(F.col("top").alias("id")).agg(F.sum("n").alias(name))
        out = out.join(per, "id", "left")
    return out.na.fill(0)


def move(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """The tree with ``node`` under ``parent``; refuses itself and nodes below it."""
    if not subtree(tree, node).where(F.col("id") == parent).isEmpty():
        raise CycleError(f"{parent} is {node} or below it")
    return tree.withColumn("parent_id", F.when(F.col("id") == node, F.lit(parent)).otherwise(F.col("parent_id")))


def delete_leaf(tree: DataFrame, node: str) -> DataFrame:
    if not tree.where(F.col("parent_id") == node).isEmpty():
        raise HasChildren(node)
    return tree.where(F.col("id") != node)


def reparent_and_delete(tree: DataFrame, node: str) -> DataFrame:
    """The tree without ``node``; its children go to its parent."""
    up = tree.where(F.col("id") == node).select(F.col("parent_id").alias("_up"), F.lit(node).alias("_node"))
    joined = tree.where(F.col("id") != node).join(F.broadcast(up), F.col("parent_id") == F.col("_node"), "left")
    return joined.withColumn("parent_id", F.when(F.col("_node").isNotNull(), F.col("_up")).otherwise(F.col("parent_id"))).drop("_up", "_node")


def cascade_delete(tree: DataFrame, top: str) -> DataFrame:
    return tree.join(subtree(tree, top), "id", "left_anti")


def cycle_nodes(tree: DataFrame) -> DataFrame:
    """Nodes that lie on a parent cycle.

    Every step is doubled: a row leads from a node to the one ``step`` above it, and
    nodes whose walk has ended at a root drop out.  An acyclic chain that is still
    walked has a node that drops out in the next round, so a round without a drop
    leaves only nodes that lead into a cycle.  From then on no tail and no cycle is
    longer than what is left, and after as many steps all rows end on cycles.
    """
    jump = tree.where(~is_root()).select("id", F.col("parent_id").alias("to"))
    # a node without children lies on no cycle: two rounds take most of a broad tree away
    for _ in range(2):
        jump = jump.join(jump.select(F.col("to").alias("id")).distinct(), "id", "left_semi")
    jump = materialise(jump)
    n, step, dropped = jump.count(), 1, True
    while n and (dropped or step < n):
        jump = materialise(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")))
        step *= 2
        before, n = n, jump.count()
        dropped = n < before
    return jump.select(F.col("to").alias("id")).distinct()


def nearest_ancestor(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The closest ancestor of each node among ``marked`` (ancestor, ...), with its columns."""
    hit = pairs.join(marked, "ancestor")
    others = [c for c in marked.columns if c != "ancestor"]
    return hit.groupBy("id").agg(F.min_by(F.struct("ancestor", *others), F.col("depth")).alias("_x")).select("id", "_x.*")
