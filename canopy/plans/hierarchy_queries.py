"""Registered hierarchy queries over the derived tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import hierarchy as H
from canopy.operators import intervals as I
from canopy.operators import maintained
from canopy.sources.archive import Archive

TREE = """tree AS (
  SELECT 'R' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, CAST(r_regionkey AS INTEGER) AS ordinal, r_name AS name, 'REGION' AS rank FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, CAST(n_nationkey AS INTEGER), n_name, 'NATION' FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, NULL, s_name, 'SUPPLIER' FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, NULL, c_name, 'CUSTOMER' FROM customer)"""
PAIRS = """pairs AS (
  SELECT id, parent_id AS ancestor, 1 AS depth FROM tree WHERE parent_id IS NOT NULL
  UNION ALL SELECT p.id, t.parent_id, p.depth + 1 FROM pairs p JOIN tree t ON t.id = p.ancestor WHERE t.parent_id IS NOT NULL)"""
WITH = f"WITH RECURSIVE {TREE}, {PAIRS} "


def _tree(spark, sf_dir):
    return Archive.derive(spark, sf_dir)["tree"]


def roots(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return H.children(tree).select("id", "name", "ordinal", "has_children")


def children_page(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    tops = tree.where(H.is_root())
    return H.children_of_all(tree, tops).select("parent_id", "position", "id", "name", "has_children")


def page_of_nation(spark, sf_dir):
    return H.children_page(_tree(spark, sf_dir), "N1", offset=5, limit=20).select("id", "name", "has_children")


def classification_all(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return H.classification(tree, H.closure(tree))


def ancestors(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return H.closure(tree, tree.where("id = 'C7'")).select("ancestor", "depth")


def descendant_counts(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return H.descendant_counts(tree, H.closure(tree))


def is_descendant(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    tops = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.concat(F.lit("R"), k))  # the five regions
    pairs = tree.where("rank in ('SUPPLIER', 'NATION')").select(F.col("id").alias("node"), F.explode(tops).alias("top"))
    return I.inside(pairs, I.number(tree))


#: The nine tables that hang on a node, by SQL that Spark and the oracle share: (columns that name a node, SQL).
DEPENDENTS = {
    "synonym": (["taxon"], "SELECT 'S' || l_suppkey AS taxon FROM {lineitem} WHERE l_linenumber = 1"),
    "vernacular": (["taxon"], "SELECT 'C' || o_custkey AS taxon FROM {orders}"),
    "distribution": (["taxon"], "SELECT 'N' || c_nationkey AS taxon FROM {customer}"),
    "media": (["taxon"], "SELECT 'S' || l_suppkey AS taxon FROM {lineitem} WHERE l_returnflag = 'R'"),
    "treatment": (["taxon"], "SELECT 'C' || o_custkey AS taxon FROM {orders} WHERE o_orderstatus = 'F'"),
    "species_estimate": (["taxon"], "SELECT 'N' || s_nationkey AS taxon FROM {supplier}"),
    "taxon_property": (["taxon"], "SELECT 'R' || n_regionkey AS taxon FROM {nation}"),
    "species_interaction": (["taxon", "related"], "SELECT 'S' || l_suppkey AS taxon, 'C' || o_custkey AS related FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey"),
    "taxon_concept_relation": (["taxon", "related"], "SELECT 'S' || s_suppkey AS taxon, 'N' || (s_suppkey % 25) AS related FROM {supplier}"),
}
_SOURCES = ["lineitem", "orders", "customer", "supplier", "nation"]


def dependents(spark, sf_dir):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _SOURCES}
    return {name: (spark.sql(sql, **{t: df for t, df in tables.items() if "{" + t + "}" in sql}), columns) for name, (columns, sql) in DEPENDENTS.items()}


def delete_preview(spark, sf_dir):
    """What deleting each region or nation would remove from the tree and from all nine dependents."""
    tree = _tree(spark, sf_dir)
    return I.delete_preview(tree, I.number(tree), dependents(spark, sf_dir)).join(tree.where("rank in ('REGION', 'NATION')").select("id"), "id", "left_semi")


def cascade_tables(spark, sf_dir):
    """What is left of the tree and of all dependents by node, before and after a region and a nation of another one are deleted."""
    tree, rows = _tree(spark, sf_dir), dependents(spark, sf_dir)
    left, tables = I.cascade(tree, I.number(tree), tree.where("id in ('R2', 'N3')").select("id"), rows)
    named = lambda df, name, columns, when: df.groupBy(F.coalesce(*columns).alias("node")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(when).alias("snapshot"), "node", "n")
    out = named(left, "taxon", ["id"], "after").unionByName(named(tree, "taxon", ["id"], "before"))
    for name, (before, columns) in rows.items():
        out = out.unionByName(named(tables[name], name, columns, "after")).unionByName(named(before, name, columns, "before"))
    return out


def ranges(spark, sf_dir):
    return I.number(_tree(spark, sf_dir)).select("id", "first", "last", "depth")


def pages(spark, sf_dir):
    return I.pages(_tree(spark, sf_dir), 20)


def page_after(spark, sf_dir):
    """The next page of a nation's suppliers and customers behind a row that need not be there any more."""
    return I.page_after(_tree(spark, sf_dir), "N1", {"ordinal": None, "name": "Customer#000000030", "id": "C30"}, 15).select("id", "name", "left")


def closure_maintained(spark, sf_dir):
    """All pairs after a batch of moves and deletes, from the pairs before; ``touched`` are the nodes whose line may have changed."""
    tree = _tree(spark, sf_dir)
    up = F.when(F.col("id") == "N1", F.lit("R4")).when(F.col("id") == "R0", F.lit("N7")).when(F.col("id").startswith("S") & F.col("id").endswith("3"), F.lit("C5")).otherwise(F.col("parent_id"))
    after = tree.where("id not in ('N9', 'C8')").withColumn("parent_id", up)
    pairs, touched = maintained.closure_after(H.closure(tree), tree, after)
    marked = touched.withColumn("touched", F.lit(True))
    return pairs.join(marked, "id", "left").select("id", "ancestor", "depth", F.coalesce("touched", F.lit(False)).alias("touched"))


def move(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    moved = H.move(tree, "N1", "R4")
    try:
        H.move(moved, "R4", "N1")
        status = "moved"
    except H.CycleError:
        status = "rejected"
    return moved.select("id", "parent_id", F.lit(status).alias("into_itself"))


def reparent_delete(spark, sf_dir):
    return H.reparent_and_delete(_tree(spark, sf_dir), "N3").select("id", "parent_id")


def cascade_delete(spark, sf_dir):
    return H.cascade_delete(_tree(spark, sf_dir), "R2").select("id", "parent_id")


def cycle_nodes(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    planted = tree.withColumn("parent_id", F.when(F.col("id") == "R0", "N1").when(F.col("id") == "N1", "S1").when(F.col("id") == "S1", "R0").otherwise(F.col("parent_id")))
    return H.cycle_nodes(planted)


def children_total(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return H.children_total(tree, tree)


def reveal(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return H.reveal(tree, H.closure(tree), tree.where("rank = 'SUPPLIER'"), limit=20)


def closure_stats(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return H.closure(tree).groupBy("depth").agg(F.count("*").alias("pairs"), F.countDistinct("ancestor").alias("ancestors"))




def _tables():
    return ", ".join(f"{name} AS ({sql.format(**{t: t for t in _SOURCES})})" for name, (_, sql) in DEPENDENTS.items())


def _preview():
    counts = []
    for name, (columns, _) in DEPENDENTS.items():
        keyed = f"(SELECT *, row_number() OVER () AS k FROM {name})"
        ends = " UNION ".join(f"SELECT top, k FROM m JOIN keyed_{name} x ON x.{c} = m.node" for c in columns)
        counts.append((f"keyed_{name} AS MATERIALIZED {keyed}, per_{name} AS (SELECT top, count(*) AS n FROM ({ends}) GROUP BY top)", f"coalesce((SELECT n FROM per_{name} p WHERE p.top = t.id), 0) AS {name}"))
    return f"""{WITH}, {_tables()}, m AS (SELECT p.ancestor AS top, p.id AS node FROM pairs p JOIN tree n ON n.id = p.ancestor AND n.rank IN ('REGION', 'NATION') UNION ALL SELECT id, id FROM tree WHERE rank IN ('REGION', 'NATION')),
        {', '.join(c for c, _ in counts)} SELECT t.id, t.parent_id, (SELECT count(*) FROM tree k WHERE k.parent_id = t.id) AS children, (SELECT count(*) FROM m WHERE m.top = t.id) AS subtree, {', '.join(c for _, c in counts)}
        FROM tree t WHERE t.rank IN ('REGION', 'NATION')"""


def _cascade():
    tables = {"taxon": ["id"]} | {name: columns for name, (columns, _) in DEPENDENTS.items()}
    parts = []
    for name, columns in tables.items():
        source = "tree" if name == "taxon" else name
        kept = " AND ".join(f"{c} NOT IN (SELECT id FROM gone)" for c in columns)
        for when, where in (("before", "true"), ("after", kept)):
            parts.append(f"SELECT '{name}' AS table_name, '{when}' AS snapshot, {columns[0]} AS node, count(*) AS n FROM {source} WHERE {where} GROUP BY {columns[0]}")
    return f"{WITH}, {_tables()}, gone AS (SELECT id FROM tree WHERE id IN ('R2', 'N3') UNION SELECT id FROM pairs WHERE ancestor IN ('R2', 'N3')) " + " UNION ALL ".join(parts)


_HAS = "EXISTS (SELECT 1 FROM tree k WHERE k.parent_id = t.id) AS has_children"
_CYCLE_TREE = """SELECT id, CASE id WHEN 'R0' THEN 'N1' WHEN 'N1' THEN 'S1' WHEN 'S1' THEN 'R0' ELSE parent_id END AS parent_id FROM tree"""

QUERIES = {
    "hier_roots": (roots, f"WITH {TREE} SELECT id, name, ordinal, {_HAS} FROM tree t WHERE parent_id IS NULL"),
    "hier_children_page": (
        children_page,
        f"""WITH {TREE} SELECT t.parent_id, row_number() OVER (PARTITION BY t.parent_id ORDER BY t.ordinal NULLS LAST, t.name, t.id) AS position, t.id, t.name, {_HAS}
            FROM tree t JOIN tree r ON r.id = t.parent_id WHERE r.parent_id IS NULL QUALIFY position <= 100""",
    ),
    "hier_page_of_node": (page_of_nation, f"WITH {TREE} SELECT id, name, {_HAS} FROM tree t WHERE parent_id = 'N1' ORDER BY ordinal NULLS LAST, name, id LIMIT 20 OFFSET 5"),
    "hier_classification_all": (
        classification_all,
        WITH
        + """, line AS (SELECT * FROM pairs UNION ALL SELECT id, id, 0 FROM tree)
        SELECT l.id, row_number() OVER (PARTITION BY l.id ORDER BY l.depth DESC) AS position, l.ancestor AS node, t.name, t.rank FROM line l JOIN tree t ON t.id = l.ancestor""",
    ),
    "hier_ancestors": (ancestors, WITH + "SELECT ancestor, depth FROM pairs WHERE id = 'C7'"),
    "hier_descendant_counts": (
        descendant_counts,
        WITH + "SELECT t.id, count(p.id) AS descendants, count(p.id) FILTER (p.depth = 1) AS children FROM tree t LEFT JOIN pairs p ON p.ancestor = t.id GROUP BY t.id",
    ),
    "hier_is_descendant": (
        is_descendant,
        WITH + "SELECT a.id AS node, b.id AS top, EXISTS (SELECT 1 FROM pairs p WHERE p.id = a.id AND p.ancestor = b.id) AS inside FROM tree a, tree b WHERE a.rank IN ('SUPPLIER', 'NATION') AND b.rank = 'REGION'",
    ),
    "hier_delete_preview": (delete_preview, _preview()),
    "hier_cascade_tables": (cascade_tables, _cascade()),
    "hier_ranges": (
        ranges,
        f"""WITH RECURSIVE {TREE}, placed AS (SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY ordinal NULLS LAST, name, id) AS k FROM tree),
            line AS (SELECT id, [k] AS way FROM placed WHERE parent_id IS NULL UNION ALL SELECT p.id, list_append(l.way, p.k) FROM line l JOIN placed p ON p.parent_id = l.id),
            {PAIRS}, sizes AS (SELECT ancestor AS id, count(*) AS n FROM pairs GROUP BY ancestor)
            SELECT l.id, row_number() OVER (ORDER BY way) AS first, row_number() OVER (ORDER BY way) + coalesce(n, 0) AS last, CAST(len(way) - 1 AS BIGINT) AS depth FROM line l LEFT JOIN sizes s ON s.id = l.id""",
    ),
    "hier_pages": (
        pages,
        f"""WITH {TREE} SELECT id, parent_id AS up, row_number() OVER w AS place, CAST((row_number() OVER w - 1) // 20 AS BIGINT) AS page, count(*) OVER (PARTITION BY parent_id) AS total
            FROM tree WINDOW w AS (PARTITION BY parent_id ORDER BY ordinal NULLS LAST, name, id)""",
    ),
    "hier_page_after": (
        page_after,
        f"""WITH {TREE}, behind AS (SELECT * FROM tree WHERE parent_id = 'N1' AND (name, id) > ('Customer#000000030', 'C30'))
            SELECT id, name, count(*) OVER () - row_number() OVER (ORDER BY name, id) AS left FROM behind ORDER BY name, id LIMIT 15""",
    ),
    "closure_maintained": (
        closure_maintained,
        f"""WITH RECURSIVE {TREE}, now AS (SELECT id, CASE WHEN id = 'N1' THEN 'R4' WHEN id = 'R0' THEN 'N7' WHEN id LIKE 'S%3' THEN 'C5' ELSE parent_id END AS parent_id FROM tree WHERE id NOT IN ('N9', 'C8')),
            links AS (SELECT n.id, n.parent_id FROM now n JOIN now p ON p.id = n.parent_id),
            walk AS (SELECT id, parent_id AS ancestor, 1 AS depth FROM links UNION ALL SELECT w.id, l.parent_id, w.depth + 1 FROM walk w JOIN links l ON l.id = w.ancestor WHERE w.depth < 12),
            old AS (SELECT id, parent_id AS ancestor, 1 AS depth FROM tree WHERE parent_id IS NOT NULL UNION ALL SELECT o.id, t.parent_id, o.depth + 1 FROM old o JOIN tree t ON t.id = o.ancestor WHERE t.parent_id IS NOT NULL),
            hot AS (SELECT id FROM tree WHERE id IN ('N1', 'R0', 'N9', 'C8') OR id LIKE 'S%3' OR parent_id IN ('N9', 'C8')),
            touched AS (SELECT id FROM hot UNION SELECT id FROM old WHERE ancestor IN (SELECT id FROM hot))
            SELECT id, ancestor, CAST(min(depth) AS INTEGER) AS depth, id IN (SELECT id FROM touched) AS touched FROM walk WHERE id <> ancestor GROUP BY id, ancestor""",
    ),
    "hier_move": (move, f"WITH {TREE} SELECT id, CASE WHEN id = 'N1' THEN 'R4' ELSE parent_id END AS parent_id, 'rejected' AS into_itself FROM tree"),
    "hier_reparent_delete": (
        reparent_delete,
        f"WITH {TREE} SELECT id, CASE WHEN parent_id = 'N3' THEN (SELECT parent_id FROM tree WHERE id = 'N3') ELSE parent_id END AS parent_id FROM tree WHERE id <> 'N3'",
    ),
    "hier_cascade_delete": (cascade_delete, WITH + "SELECT id, parent_id FROM tree t WHERE id <> 'R2' AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.id = t.id AND p.ancestor = 'R2')"),
    "hier_cycle_nodes": (
        cycle_nodes,
        f"""WITH RECURSIVE {TREE}, c AS ({_CYCLE_TREE}), walk AS (SELECT id AS start, parent_id AS spot, 1 AS n FROM c WHERE parent_id IS NOT NULL
            UNION ALL SELECT w.start, c.parent_id, w.n + 1 FROM walk w JOIN c ON c.id = w.spot WHERE c.parent_id IS NOT NULL AND w.spot <> w.start AND w.n < 8)
            SELECT DISTINCT start AS id FROM walk WHERE spot = start""",
    ),
    "hier_children_total": (children_total, f"WITH {TREE} SELECT t.id, count(k.id) AS total FROM tree t LEFT JOIN tree k ON k.parent_id = t.id GROUP BY t.id"),
    "hier_reveal": (
        reveal,
        WITH
        + """, line AS (SELECT p.* FROM pairs p JOIN tree t ON t.id = p.id WHERE t.rank = 'SUPPLIER' UNION ALL SELECT id, id, 0 FROM tree WHERE rank = 'SUPPLIER'),
        placed AS (SELECT id, CAST((row_number() OVER (PARTITION BY coalesce(parent_id, '') ORDER BY ordinal NULLS LAST, name, id) - 1) // 20 AS INTEGER) AS page FROM tree)
        SELECT l.id, CAST(row_number() OVER (PARTITION BY l.id ORDER BY l.depth DESC) AS INTEGER) AS step, l.ancestor AS node, page FROM line l JOIN placed ON placed.id = l.ancestor""",
    ),
    "hier_closure_stats": (closure_stats, WITH + "SELECT depth, count(*) AS pairs, count(DISTINCT ancestor) AS ancestors FROM pairs GROUP BY depth"),
}
