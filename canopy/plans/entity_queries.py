"""Registered lists, histories, vocabularies and scalar functions over the derived relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import scalars as X
from canopy.functions import vocabulary as Voc
from canopy.operators import entities as E
from canopy.operators import hierarchy as H
from canopy.operators import history as N
from canopy.operators import ranks as Ranks
from canopy.operators import rules as Rules
from canopy.plans.hierarchy_queries import WITH
from canopy.plans.validation_queries import _MERGED, issue_merge
from canopy.sources.archive import Archive


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def list_vernacular(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = d.select(F.col("source").alias("taxon_id"), F.concat_ws("-", "lang", "n_chars").alias("name"), F.col("lang").alias("language"), F.col("quality").alias("preferred"), F.col("doc_id").alias("id"))
    return E.vernaculars(rows, limit=25).select("taxon_id", "position", "name", "preferred", "id")


def list_distribution(spark, sf_dir):
    a = Archive.derive(spark, sf_dir)
    where = a["supplier"].join(a["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(a["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    where = where.select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("area"), F.col("r_name").alias("gazetteer"))
    pairs = a["lineitem"].groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    rows = pairs.join(where, "l_suppkey").select(_text("P", "l_partkey").alias("taxon_id"), "area", "gazetteer", F.col("l_suppkey").alias("id"))
    return E.distributions(rows, limit=10).select("taxon_id", "position", "gazetteer", "area", "id")


def list_type_material(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    rows = o.select(_text("C", "o_custkey").alias("name_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("id"))
    return E.type_materials(rows, limit=20)


def list_interaction(spark, sf_dir):
    a = Archive.derive(spark, sf_dir)
    rows = a["lineitem"].select(
        _text("P", "l_partkey").alias("taxon_id"),
        F.when(F.col("l_partkey") % 61 == 0, "").otherwise(_text("S", "l_suppkey")).alias("related_id"),
        F.when(F.col("l_partkey") % 61 == 0, "by text").otherwise("").alias("related_text"),
        F.col("l_returnflag").alias("type"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("id"),
    )
    taxa = a["supplier"].select(_text("S", "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return E.interactions(rows, taxa, limit=15).groupBy("taxon_id", "type", "related_name").agg(F.count("*").alias("n"))


def _relations(spark, sf_dir):
    """Every part but the first is a recombination of the first part of the same name and brand."""
    p = _read(spark, sf_dir, "part")
    first = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("first"))
    return p.join(first, ["p_name", "p_brand"]).where("p_partkey <> first").select(F.col("p_partkey").alias("name_id"), F.col("first").alias("related_id"), F.lit("BASIONYM").alias("type"))


_RELATIONS = "relations AS (SELECT p_partkey AS name_id, first AS related_id FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS first FROM part) WHERE p_partkey <> first)"


def list_relations(spark, sf_dir):
    return E.relations_of(_relations(spark, sf_dir))


def _references(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        _text("Author ", "o_custkey").alias("author"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued"),
        F.col("o_orderpriority").alias("title"),
        F.lit("").alias("citation"),
        F.lit(None).cast("string").alias("doi"),
    )


def list_references(spark, sf_dir):
    return E.references(_references(spark, sf_dir), "urgent", offset=100, limit=200).select("id", "author", "issued")


def list_agents(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    rows = c.select(F.col("c_mktsegment").alias("role"), F.col("c_name").alias("family"), F.lit("").alias("given"), F.col("c_custkey").alias("id"))
    return E.agents(rows, limit=30).select("role", "position", "id")


def _synonyms(spark, sf_dir):
    pairs = Archive.derive(spark, sf_dir)["part_synonym"]
    return pairs.select("id", "taxon_id", F.col("id").alias("name_id"))


def syn_list(spark, sf_dir):
    names = Archive.derive(spark, sf_dir)["part_name"]
    return E.synonyms(_synonyms(spark, sf_dir), names, limit=40).select("taxon_id", "position", "id", "canonical")


def syn_partners(spark, sf_dir):
    return E.synonym_partners(_synonyms(spark, sf_dir), limit=40)


def list_with_badges(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return E.with_badges(p, "p_partkey", "part", issue_merge(spark, sf_dir))


def name_dependencies(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    taxa = p.where("p_size > 25").select(F.col("id").alias("name_id"))
    synonyms = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name_id"))
    return E.dependencies(p, taxa, synonyms, _relations(spark, sf_dir))


def nomen_history(spark, sf_dir):
    """A taxon per part name: the last part is accepted, parts of an odd size are its synonyms."""
    p = _read(spark, sf_dir, "part")
    last = p.groupBy("p_name").agg(F.max("p_partkey").alias("name_id")).select(F.col("p_name").alias("taxon_id"), "name_id", F.lit(True).alias("accepted"))
    others = p.where("p_size % 2 = 1").select(F.col("p_name").alias("taxon_id"), F.col("p_partkey").alias("name_id"), F.lit(False).alias("accepted"))
    year = F.when(F.col("p_size") % 10 == 0, "").otherwise((F.col("p_size") + 1700).cast("string"))
    names = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("label"), year.alias("year"))
    return N.nomenclatural_history(last.unionByName(others), names, _relations(spark, sf_dir))


_HISTORY = f"""WITH {_RELATIONS}, n AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS label, CASE WHEN p_size % 10 = 0 THEN '' ELSE CAST(p_size + 1700 AS VARCHAR) END AS year FROM part),
  involved AS (SELECT taxon_id, name_id, max(accepted) AS accepted FROM (
     SELECT p_name AS taxon_id, max(p_partkey) AS name_id, 1 AS accepted FROM part GROUP BY p_name UNION ALL SELECT p_name, p_partkey, 0 FROM part WHERE p_size % 2 = 1) GROUP BY ALL),
  anchored AS (SELECT i.*, coalesce(r.related_id, i.name_id) AS anchor FROM involved i LEFT JOIN relations r USING (name_id)),
  clusters AS (SELECT taxon_id, anchor, max(accepted) AS accepted FROM anchored GROUP BY ALL),
  members AS (SELECT taxon_id, anchor, name_id, max(k) AS k FROM (
     SELECT taxon_id, anchor, name_id, 1 + accepted AS k FROM anchored UNION ALL SELECT taxon_id, anchor, anchor, 0 FROM clusters
     UNION ALL SELECT c.taxon_id, c.anchor, r.name_id, 0 FROM clusters c JOIN relations r ON r.related_id = c.anchor) GROUP BY ALL),
  placed AS (SELECT taxon_id, anchor, row_number() OVER (PARTITION BY taxon_id ORDER BY accepted DESC, year = '', year, label, anchor) AS cluster FROM clusters JOIN n ON n.id = anchor)
  SELECT m.taxon_id, p.cluster, m.anchor, row_number() OVER (PARTITION BY m.taxon_id, m.anchor ORDER BY m.name_id <> m.anchor, n.year = '', n.year, n.label, m.name_id) AS position, m.name_id,
    CASE WHEN m.name_id = m.anchor THEN 'original' ELSE 'recombination' END AS role, CASE k WHEN 2 THEN 'accepted' WHEN 1 THEN 'synonym' ELSE 'unlinked' END AS involvement, n.year, n.label
  FROM members m JOIN n ON n.id = m.name_id JOIN placed p USING (taxon_id, anchor)"""


def onto_downcast(spark, sf_dir):
    tree = Archive.derive(spark, sf_dir)["tree"]
    mapped = tree.where("rank = 'REGION' and ordinal > 1 or rank = 'NATION' and ordinal % 4 = 0").select("id", F.concat(F.lit("as "), "name").alias("value"))
    return N.downcast(tree, H.closure(tree), mapped)


#: Vocabulary tables of a collection, by SQL that Spark and the oracle share.
VOCABULARY_TABLES = {
    "nom_status": "SELECT DISTINCT o_orderpriority AS id FROM {orders} UNION ALL SELECT CAST(NULL AS {string}) AS id",
    "sex": "SELECT DISTINCT l_linestatus AS id FROM {lineitem}",
    "reference_type": "SELECT DISTINCT p_type AS id FROM {part}",
    "name_part": "SELECT DISTINCT upper(c_mktsegment) || '_PART' AS id FROM {customer} UNION ALL SELECT '' AS id",
    "gazetteer": "SELECT 'N' || n_nationkey AS id, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_name END AS name FROM {nation}",
    "species_interaction_type": "SELECT DISTINCT l_returnflag AS id, 'by ' || l_returnflag AS name FROM {lineitem} UNION ALL SELECT '' AS id, 'none' AS name",
    "rank": "SELECT DISTINCT p_brand AS id, 'brand ' || substr(p_brand, 8) || substr(p_brand, 1, 7) AS name FROM {part}",
    "geo_time": "SELECT 'S' || s_suppkey AS id, 'age ' || (s_suppkey % 9) AS name FROM {supplier}",
}
LICENSES = ["CC0-1.0", "CC-BY-4.0", "ODbL-1.0"]


def vocab_bundle(spark, sf_dir):
    tables = {t: _read(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "customer", "nation", "supplier")}
    made = {v: spark.sql(sql.replace("{string}", "STRING"), **{t: rows for t, rows in tables.items() if "{" + t + "}" in sql}) for v, sql in VOCABULARY_TABLES.items()}
    return Voc.of_tables(made, LICENSES)


def _vocab_oracle():
    names = {t: t for t in ("orders", "lineitem", "part", "customer", "nation", "supplier")}
    parts = []
    for v, sql in VOCABULARY_TABLES.items():
        name, order = ("replace(lower(coalesce(id, '')), '_', ' ')" if v in Voc.FLAT else "coalesce(name, '')"), ("coalesce(name, ''), " if v in Voc.BY_NAME else "")
        where = "WHERE id <> ''" if v in Voc.REQUIRED else ""
        parts.append(f"SELECT '{v}' AS vocabulary, coalesce(id, '') AS id, {name} AS name, row_number() OVER (ORDER BY {order}coalesce(id, '')) - 1 AS position FROM ({sql.format(**names, string='VARCHAR')}) {where}")
    parts += [f"SELECT 'license', '{x}', '{x}', {k}" for k, x in enumerate(LICENSES)]
    return " UNION ALL ".join(parts)


#: Parents of all codes and ranks, some of no code, of another code's rank or of none.
_CODES = ["ZOOLOGICAL", "BOTANICAL", "BACTERIAL", "VIRUS", "CULTIVARS", ""]
_OTHER_RANKS = ["", "SECTION_BOTANY", "SECTION_ZOOLOGY", "SUBSECTION_BOTANY", "SPECIES_AGGREGATE", "NO_RANK"]
_ALL_RANKS = sorted({r for order in Rules.RANK_ORDER.values() for r in order}) + _OTHER_RANKS
PARENT_NAMES = f"""SELECT 'n' || p_partkey AS id, CASE p_partkey % 6 {' '.join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CODES))} END AS code_id,
    CASE (p_partkey * 7 + p_size) % {len(_ALL_RANKS)} {' '.join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(_ALL_RANKS))} END AS rank_id,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS canonical_full, CASE WHEN p_partkey % 22 = 0 THEN '' ELSE p_type END AS canonical_simple, CASE WHEN p_partkey % 44 = 0 THEN '' ELSE p_brand END AS scientific_name FROM {{part}}"""
PARENTS = "SELECT 't' || p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE 'n' || p_partkey END AS name_id FROM {part}"


def child_ranks(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    found = Ranks.new_children(spark.sql(PARENTS, part=part), spark.sql(PARENT_NAMES, part=part), Ranks.table(spark))
    ids = lambda rows: F.array_join(F.transform(rows, lambda r: r["child_rank"]), ",")
    return found.select("id", "code", "rank", "prefix", ids(F.col("child_ranks")).alias("children"), ids(F.filter("child_ranks", lambda r: r["typical"])).alias("typical"))


def _child_ranks_oracle():
    """The rank table as values, and the rule told by pairs."""
    rows = [(r.code, r.rank, Ranks.GROUPS.index(r.group), n, list(r.only_under), r.typical) for n, r in enumerate(Ranks.fixed())]
    values = ", ".join(f"('{c}', '{r}', {g}, {n}, {u}::VARCHAR[], {t})" for c, r, g, n, u, t in rows)
    return f"""WITH k(code, rank, g, n, only_under, typical) AS (VALUES {values}), t AS ({PARENTS.format(part='part')}), names AS ({PARENT_NAMES.format(part='part')}),
        p AS (SELECT t.id, coalesce(code_id, '') AS code, coalesce(rank_id, '') AS rank, CASE WHEN coalesce(rank_id, '') IN ('GENUS', 'SUBGENUS', 'INFRAGENUS', 'SUPERGENUS', 'SUPERSUBGENUS', 'SUPERSUPERSUBGENUS', 'SECTION', 'SUBSECTION', 'SERIES', 'SUBSERIES', 'SPECIES', 'SPECIES_AGGREGATE', 'SUBSPECIES', 'VARIETY', 'SUBVARIETY', 'FORM', 'SUBFORM')
            THEN coalesce(nullif(coalesce(nullif(canonical_full, ''), nullif(canonical_simple, ''), nullif(scientific_name, ''), '') || ' ', ' '), '') ELSE '' END AS prefix FROM t LEFT JOIN names n ON n.id = t.name_id),
        own AS (SELECT p.*, coalesce((SELECT k.rank FROM k WHERE k.code = p.code AND k.rank = p.rank), (SELECT k.rank FROM k WHERE k.code = p.code AND k.rank = regexp_replace(p.rank, '_(ZOOLOGY|BOTANY)$', '')), '') AS known FROM p),
        below AS (SELECT o.id, c.rank AS child, c.typical FROM own o JOIN k c ON c.code = o.code LEFT JOIN k u ON u.code = o.code AND u.rank = o.known
            WHERE u.rank IS NULL OR (c.g >= u.g AND c.n > u.n AND CASE WHEN len(c.only_under) > 0 THEN list_contains(c.only_under, u.rank) ELSE c.g - u.g <= 1 END))
        SELECT id, code, rank, prefix, CASE WHEN code IN (SELECT code FROM k) THEN coalesce((SELECT string_agg(child, ',' ORDER BY child) FROM below b WHERE b.id = p.id), '') END AS children,
            CASE WHEN code IN (SELECT code FROM k) THEN coalesce((SELECT string_agg(child, ',' ORDER BY child) FROM below b WHERE b.id = p.id AND typical), '') END AS typical FROM p"""


def label_build(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    rank = F.when(F.col("p_size") > 25, "SPECIES").otherwise("FAMILY")
    plain, html = X.label(F.concat("p_name", F.lit(" & <x>")), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")), rank, F.col("p_size") < 10)
    return p.select("p_partkey", plain.alias("label"), html.alias("html"))


#: What names of parts end with, and the rank that this tells under each code (zoological, botanical, bacterial, virus, none).
_ENDINGS = {
    "idae": ("FAMILY", "GENUS", "GENUS", "GENUS", "GENUS"), "inae": ("SUBFAMILY", "SUBTRIBE", "GENUS", "GENUS", "GENUS"), "oidea": ("SUPERFAMILY", "GENUS", "GENUS", "GENUS", "GENUS"), "ini": ("TRIBE", "GENUS", "GENUS", "GENUS", "GENUS"), "ina": ("SUBTRIBE", "GENUS", "GENUS", "GENUS", "GENUS"),
    "oideae": ("GENUS", "SUBFAMILY", "SUBFAMILY", "GENUS", "GENUS"), "aceae": ("GENUS", "FAMILY", "FAMILY", "GENUS", "GENUS"), "phyta": ("GENUS", "PHYLUM", "GENUS", "GENUS", "GENUS"), "opsida": ("GENUS", "CLASS", "GENUS", "GENUS", "GENUS"), "ales": ("GENUS", "ORDER", "ORDER", "GENUS", "GENUS"), "ieae": ("GENUS", "TRIBE", "TRIBE", "GENUS", "GENUS"),
    "virales": ("GENUS", "ORDER", "ORDER", "ORDER", "GENUS"), "viridae": ("FAMILY", "GENUS", "GENUS", "FAMILY", "GENUS"), "virinae": ("SUBFAMILY", "SUBTRIBE", "GENUS", "SUBFAMILY", "GENUS"), "virus": ("GENUS", "GENUS", "GENUS", "GENUS", "GENUS"),
    "": ("GENUS",) * 5, " minor": ("SPECIES",) * 5, " minor albus": ("SUBSPECIES",) * 5, " minor albus niger magnus": ("",) * 5, " subsp. minor": ("SUBSPECIES",) * 5, " minor subsp. albus VAR. niger": ("VARIETY",) * 5, " sect. Minor": ("SECTION_BOTANY",) * 5, " minor f. albus": ("FORM",) * 5, " cv. minor": ("CULTIVAR",) * 5,
    " marina": ("SUBTRIBE", "SPECIES", "SPECIES", "SPECIES", "SPECIES"),
}
_GUESS_CODES = ["ZOOLOGICAL", "BOTANICAL", "BACTERIAL", "VIRUS", ""]


def rank_guess(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    name = F.concat(F.initcap(F.substring_index("p_name", " ", 1)), pick(list(_ENDINGS), F.col("p_partkey")))
    code = pick(_GUESS_CODES, F.floor(F.col("p_partkey") / len(_ENDINGS)))
    return p.select("p_partkey", code.alias("code"), name.alias("name"), X.guess_rank(code, name).alias("rank"))


def _rank_guess_oracle():
    n, ranks = len(_ENDINGS), [list(r) for r in _ENDINGS.values()]
    ending, code = f"CAST(p_partkey % {n} + 1 AS INTEGER)", f"CAST((p_partkey // {n}) % {len(_GUESS_CODES)} + 1 AS INTEGER)"
    return f"""SELECT p_partkey, list_extract({_GUESS_CODES}, {code}) AS code, upper(substr(w, 1, 1)) || substr(w, 2) || list_extract({list(_ENDINGS)}, {ending}) AS name,
        list_extract(list_extract({ranks}, {ending}), {code}) AS rank FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM part)"""


def year_extract(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    issued = F.when(F.col("o_orderkey") % 9 == 0, "n.d.").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return o.select("o_orderkey", X.year_of(issued).alias("year"))


def reference_label(spark, sf_dir):
    r = _references(spark, sf_dir)
    title = F.when(F.col("id") % 5 == 0, "").otherwise(F.col("title"))
    author = F.when(F.col("id") % 15 == 0, "").otherwise(F.col("author"))
    issued = F.when(F.col("id") % 30 == 0, "").otherwise(F.col("issued"))
    return r.select("id", X.reference_label(author, issued, title, F.lit(""), F.col("id").cast("string")).alias("label"))


def first_csv(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.first_of_list(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ,x, y"))).alias("first"))


def backfill_years(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    own = F.when(F.col("p_size") % 7 == 0, "").otherwise((F.col("p_size") + 1800).cast("string"))
    base = F.when(F.col("p_partkey") % 3 == 0, "").otherwise((F.col("p_partkey") % 60 + 1790).cast("string"))
    old, new = X.backfill_years(own, base, F.col("p_partkey") % 5 == 0)
    return p.select("p_partkey", old.alias("basionym_year"), new.alias("combination_year"))


_REFS = "refs AS (SELECT o_orderkey AS id, 'Author ' || o_custkey AS author, strftime(o_orderdate, '%Y-%m-%d') AS issued, o_orderpriority AS title FROM orders)"
_SYN = "syn AS (SELECT DISTINCT 'P' || l_partkey AS id, 'S' || l_suppkey AS taxon_id FROM lineitem)"


def _paged(rows: str, owner: str, order: str, limit: int, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {owner} ORDER BY {order}) AS position FROM ({rows})) WHERE position <= {limit}"


QUERIES = {
    "list_vernacular": (
        list_vernacular,
        _paged("SELECT source AS taxon_id, concat_ws('-', lang, n_chars) AS name, lang AS language, quality AS preferred, doc_id AS id FROM documents LEFT JOIN labels USING (doc_id)", "taxon_id", "preferred DESC NULLS LAST, language NULLS FIRST, name, id", 25, "taxon_id, position, name, preferred, id"),
    ),
    "list_distribution": (
        list_distribution,
        _paged(
            "SELECT DISTINCT 'P' || l_partkey AS taxon_id, n_name AS area, r_name AS gazetteer, l_suppkey AS id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
            "taxon_id",
            "gazetteer, area, id",
            10,
            "taxon_id, position, gazetteer, area, id",
        ),
    ),
    "list_type_material": (list_type_material, _paged("SELECT 'C' || o_custkey AS name_id, o_orderstatus AS status, o_orderkey AS id FROM orders", "name_id", "status, id", 20, "*")),
    "list_interaction": (
        list_interaction,
        "SELECT taxon_id, type, related_name, count(*) AS n FROM ("
        + _paged(
            "SELECT 'P' || l_partkey AS taxon_id, l_returnflag AS type, CASE WHEN l_partkey % 61 = 0 THEN 'by text' ELSE s_name END AS related_name, l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_quantity AS id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey",
            "taxon_id",
            "type, related_name, id",
            15,
            "*",
        )
        + ") GROUP BY ALL",
    ),
    "list_relations": (
        list_relations,
        f"WITH {_RELATIONS} SELECT name_id, 'BASIONYM' AS type, 'outgoing' AS direction, related_id AS counterpart FROM relations UNION ALL SELECT related_id, 'BASIONYM', 'incoming', name_id FROM relations",
    ),
    "list_references": (list_references, f"WITH {_REFS} SELECT id, author, issued FROM refs WHERE contains(lower(author), 'urgent') OR contains(lower(title), 'urgent') ORDER BY author, issued, title, id LIMIT 200 OFFSET 100"),
    "list_agents": (list_agents, _paged("SELECT c_mktsegment AS role, c_name, c_custkey AS id FROM customer", "role", "c_name, id", 30, "role, position, id")),
    "syn_list": (syn_list, f"WITH {_SYN} " + _paged("SELECT syn.*, p_name AS canonical FROM syn JOIN part ON id = 'P' || p_partkey", "taxon_id", "canonical, id", 40, "taxon_id, position, id, canonical")),
    "syn_partners": (syn_partners, f"WITH {_SYN} " + _paged("SELECT * FROM syn", "id", "taxon_id", 40, "*")),
    "list_with_badges": (
        list_with_badges,
        _MERGED
        + """, s AS (SELECT record_id, count(*) AS n, max(list_position(['debug', 'info', 'warn', 'error'], severity)) AS k FROM merged WHERE table_name = 'part' AND coalesce(acknowledged_at, '') = '' GROUP BY record_id)
        SELECT p_partkey, p_name, coalesce(n, 0) AS n_issues, coalesce(list_extract(['debug', 'info', 'warn', 'error'], k), '') AS max_severity FROM part LEFT JOIN s ON record_id = CAST(p_partkey AS VARCHAR)""",
    ),
    "name_dependencies": (
        name_dependencies,
        f"""WITH {_RELATIONS}, l AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1),
            r AS (SELECT id, count(*) AS n FROM (SELECT name_id AS id FROM relations UNION ALL SELECT related_id FROM relations) GROUP BY 1)
            SELECT p_partkey AS id, CAST(p_size > 25 AS BIGINT) AS taxa, coalesce(l.n, 0) AS synonyms, coalesce(r.n, 0) AS relations FROM part LEFT JOIN l ON l.id = p_partkey LEFT JOIN r ON r.id = p_partkey""",
    ),
    "nomen_history": (nomen_history, _HISTORY),
    "onto_downcast": (
        onto_downcast,
        WITH
        + """, m AS (SELECT id, 'as ' || name AS value FROM tree WHERE rank = 'REGION' AND ordinal > 1 OR rank = 'NATION' AND ordinal % 4 = 0),
        line AS (SELECT * FROM pairs UNION ALL SELECT id, id, 0 FROM tree), hit AS (SELECT line.id, arg_min(value, depth) AS value FROM line JOIN m ON m.id = line.ancestor GROUP BY line.id)
        SELECT tree.id, coalesce(value, '') AS value FROM tree LEFT JOIN hit USING (id)""",
    ),
    "vocab_bundle": (vocab_bundle, _vocab_oracle()),
    "child_ranks": (child_ranks, _child_ranks_oracle()),
    "label_build": (
        label_build,
        """WITH l AS (SELECT p_partkey, p_size, CASE WHEN p_size < 10 THEN '†' ELSE '' END AS d, p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_brand END AS a FROM part)
           SELECT p_partkey, d || p_name || ' & <x>' || a AS label, d || CASE WHEN p_size > 25 THEN '<i>' || p_name || ' &amp; &lt;x&gt;</i>' ELSE p_name || ' &amp; &lt;x&gt;' END || replace(a, '''', '&#39;') AS html FROM l""",
    ),
    "rank_guess": (rank_guess, _rank_guess_oracle()),
    "year_extract": (year_extract, "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE strftime(o_orderdate, '%Y') END AS year FROM orders"),
    "reference_label": (
        reference_label,
        f"""WITH {_REFS}, r AS (SELECT id, CASE WHEN id % 15 = 0 THEN '' ELSE author END AS a, CASE WHEN id % 30 = 0 THEN '' ELSE '(' || left(issued, 4) || ')' END AS y, CASE WHEN id % 5 = 0 THEN '' ELSE title END AS t FROM refs)
            SELECT id, CASE WHEN a || y || t = '' THEN CAST(id AS VARCHAR) ELSE concat_ws(' ', nullif(a, ''), nullif(y, ''), nullif(t, '')) END AS label FROM r""",
    ),
    "first_csv": (first_csv, "SELECT o_orderkey, trim(o_orderpriority) AS first FROM orders"),
    "backfill_years": (
        backfill_years,
        """WITH y AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size + 1800 AS VARCHAR) END AS o, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey % 60 + 1790 AS VARCHAR) END AS b FROM part)
           SELECT p_partkey, CASE WHEN o <> '' AND b <> '' AND b < o THEN b ELSE '' END AS basionym_year, CASE WHEN o <> '' AND b <> '' AND b < o OR p_partkey % 5 <> 0 AND b = '' THEN o ELSE '' END AS combination_year FROM y""",
    ),
}
