"""Registered name searches over part names and their suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import search as S
from canopy.operators.text_index import TextIndex
from canopy.sources import shared
from canopy.sources.archive import Archive

NAMES = "names AS (SELECT 'P' || p_partkey AS id, p_name AS canonical, p_brand AS authorship FROM part)"
ALIASES = "aliases AS (SELECT DISTINCT 'S' || l_suppkey AS taxon_id, 'P' || l_partkey AS alias_id, p_name AS canonical FROM lineitem JOIN part ON p_partkey = l_partkey)"
SUPPLIERS = "own AS (SELECT 'S' || s_suppkey AS id, s_name AS canonical FROM supplier)"
GRAMS = "list_distinct([substr(lower({0}), CAST(i AS INTEGER), 3) FOR i IN range(1, length({0}) - 1)])"


def _names(archive):
    return archive["part_name"].select("id", "canonical", "authorship")


def _aliases(archive):
    names = archive["part_name"].select("id", "canonical")
    return archive["part_synonym"].join(names, "id").select("taxon_id", F.col("id").alias("alias_id"), "canonical")


def _suppliers(archive):
    return archive["supplier"].select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("canonical"))


def prefix(spark, sf_dir):
    return S.prefix_hits(_names(Archive.derive(spark, sf_dir)), "SM%A").select("id", "canonical")


def substring(spark, sf_dir):
    return S.substring_hits(_names(Archive.derive(spark, sf_dir)), "IN").select("id", "canonical")


def synonym_resolution(spark, sf_dir):
    archive = Archive.derive(spark, sf_dir)
    return S.resolve(_suppliers(archive), _aliases(archive), "s", limit=1000)


def partial_tokens(spark, sf_dir):
    """From the stored index of all texts, which the first search builds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return TextIndex.stored(spark, "documents", docs, "doc_id", F.col("text")).bm25(["thea", "ing"])


def index_edits(spark, sf_dir):
    """A stored index after batches of edits: texts deleted, replaced by those of customers' comments and added, merged between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    comments = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    index = TextIndex.build(spark, shared.folder(spark, "index"), docs, "doc_id", F.col("text"))
    gone = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("text"))
    index.apply(gone, "edits", 1)
    index.apply(docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" customer thing")).alias("text")), "edits", 2)
    index.merge()
    index.apply(comments.select((-1 - F.col("id")).alias("id"), "text"), "edits", 3)
    index.apply(gone, "edits", 3)  # a replay: nothing changes
    return index.bm25(["cust", "thing"], least=1)


def fuzzy_trigram(spark, sf_dir):
    archive = Archive.derive(spark, sf_dir)
    names = _names(archive)
    queries = names.select(F.col("canonical").alias("query")).distinct().withColumn("query_id", F.col("query"))
    # all names against all distinct names: a bulk self-match
    return S.fuzzy_hits(names, queries, least=6).select("query_id", "id", "shared")


def rerank(spark, sf_dir):
    archive = Archive.derive(spark, sf_dir)
    names = _names(archive).withColumn("is_synonym", F.col("id").endswith("3"))
    score = S.rerank_score(F.lit("small"), F.col("canonical"), F.col("is_synonym"), True)
    return names.select("id", "canonical", F.round(score, 6).alias("score"))


def _composite(query, mode):
    """The whole search over parts as taxa and suppliers as their aliases, of which some name several taxa."""

    def run(spark, sf_dir):
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
        names = part.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("canonical"), F.col("p_brand").alias("authorship"))
        alias = supplier.select(F.concat(F.lit("A"), "s_suppkey").alias("alias_id"), F.explode(F.array("s_suppkey", F.col("s_suppkey") + 7)).alias("_key"), F.concat(F.lit("old "), F.col("s_name")).alias("canonical"))
        alias = alias.select("alias_id", F.concat(F.lit("P"), "_key").alias("taxon_id"), "canonical")
        pool = S.search_pool(names, alias)
        index = TextIndex.stored(spark, f"parts-{mode}", pool, "id", S.pool_text(pool, mode), "words" if mode == "partial" else "grams")
        return S.search(names, alias, query, mode, index=index).withColumn("score", F.round("score", 6))

    wanted = mode == "partial"
    terms = query.split() if wanted else list(dict.fromkeys(query[i : i + 3] for i in range(len(query) - 2)))
    units = r"list_filter(regexp_split_to_array(lower(concat_ws(' ', canonical, authorship)), '[^\p{L}\p{N}]+'), lambda x: x <> '')" if wanted else "[substr(lower(canonical), CAST(i AS INTEGER), 3) FOR i IN range(1, length(canonical) - 1)]"
    match = "starts_with(term, t)" if wanted else "term = t"
    far = "" if wanted else f" - 0.5::DOUBLE * levenshtein('{query}', m)"
    sql = f"""WITH pool AS (SELECT DISTINCT 'P' || p_partkey AS taxon_id, p_name AS canonical, p_brand AS authorship, false AS syn FROM part
          UNION SELECT 'P' || (s_suppkey + k), 'old ' || s_name, NULL, true FROM supplier, (VALUES (0), (7)) AS x(k)),
        w AS (SELECT *, {units} AS w FROM pool), c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
        u AS (SELECT taxon_id, canonical, syn, len(w) AS l, unnest(w) AS term FROM w),
        h AS (SELECT t, taxon_id, canonical, syn, l, count(*) AS tf FROM u JOIN (VALUES {', '.join(f"('{t}')" for t in terms)}) AS q(t) ON {match} GROUP BY ALL),
        d AS (SELECT t, count(*) AS df FROM h GROUP BY t),
        b AS (SELECT taxon_id, canonical, syn, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))), 6) AS bm
          FROM h JOIN d USING (t), c GROUP BY ALL HAVING count(*) >= {len(terms) if wanted else 1}),
        one AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY taxon_id ORDER BY syn, bm DESC, canonical) = 1),
        few AS (SELECT *, lower(canonical) AS m, list_last(string_split(lower(canonical), ' ')) AS last FROM one ORDER BY bm DESC, canonical, taxon_id LIMIT 500)
        SELECT taxon_id, canonical AS matched_name, syn AS is_synonym, round(CASE WHEN starts_with(m, '{query}') THEN 8.0::DOUBLE ELSE 0 END + CASE WHEN last = '{query}' THEN 9.0::DOUBLE WHEN starts_with(last, '{query}') THEN 6.0::DOUBLE ELSE 0 END
          + 4.0::DOUBLE * least({len(query)}, strlen(m)) / greatest({len(query)}, strlen(m)) - CASE WHEN syn THEN 2.0::DOUBLE ELSE 0 END{far}, 6) AS score FROM few ORDER BY score DESC, matched_name, taxon_id LIMIT 50"""
    return run, sql


QUERIES = {
    "search_taxa_partial": _composite("old s", "partial"),
    "search_taxa_one_token": _composite("old", "partial"),
    "search_taxa_fuzzy": _composite("old plte", "fuzzy"),
    "search_prefix": (prefix, f"WITH {NAMES} SELECT id, canonical FROM names WHERE starts_with(lower(canonical), 'sma')"),
    "search_names_substring": (substring, f"WITH {NAMES} SELECT id, canonical FROM names WHERE contains(lower(canonical), 'in')"),
    "search_synonym_resolution": (
        synonym_resolution,
        f"""WITH {SUPPLIERS}, {ALIASES}, arms AS (
            (SELECT id AS taxon_id, canonical AS matched_name, 0 AS is_synonym FROM own WHERE starts_with(lower(canonical), 's') ORDER BY 2, 1 LIMIT 1000)
            UNION ALL (SELECT taxon_id, canonical, 1 FROM aliases WHERE starts_with(lower(canonical), 's') ORDER BY 2, 1 LIMIT 1000))
            SELECT * FROM (SELECT * FROM arms QUALIFY row_number() OVER (PARTITION BY taxon_id ORDER BY is_synonym, matched_name) = 1) ORDER BY matched_name, taxon_id LIMIT 1000""",
    ),
    "search_partial_tokens": (
        partial_tokens,
        r"""WITH words AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
            c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
            t AS (SELECT id, len(w) AS l, unnest(w) AS term FROM words),
            h AS (SELECT p.prefix, id, any_value(l) AS l, count(*) AS tf FROM t JOIN (VALUES ('thea'), ('ing')) p(prefix) ON starts_with(term, p.prefix) GROUP BY p.prefix, id),
            d AS (SELECT prefix, count(*) AS df FROM h GROUP BY prefix)
            SELECT id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))), 6) AS score
            FROM h JOIN d USING (prefix), c GROUP BY id HAVING count(*) = 2""",
    ),
    "search_index_edits": (
        index_edits,
        r"""WITH texts AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN text || ' customer thing' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 = 0
              UNION ALL SELECT -1 - c_custkey, c_name || ' ' || c_mktsegment FROM customer),
            words AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM texts WHERE text IS NOT NULL),
            c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words), t AS (SELECT id, len(w) AS l, unnest(w) AS term FROM words),
            h AS (SELECT p.prefix, id, any_value(l) AS l, count(*) AS tf FROM t JOIN (VALUES ('cust'), ('thing')) p(prefix) ON starts_with(term, p.prefix) GROUP BY p.prefix, id),
            d AS (SELECT prefix, count(*) AS df FROM h GROUP BY prefix)
            SELECT id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))), 6) AS score
            FROM h JOIN d USING (prefix), c GROUP BY id""",
    ),
    "search_fuzzy_trigram": (
        fuzzy_trigram,
        f"""WITH {NAMES}, g AS (SELECT id, canonical, unnest({GRAMS.format('canonical')}) AS gram FROM names),
            q0 AS (SELECT DISTINCT canonical AS query FROM names),
            q1 AS (SELECT query, generate_subscripts(x, 1) AS n, unnest(x) AS gram, len(x) AS size FROM (SELECT query, [substr(lower(query), CAST(i AS INTEGER), 3) FOR i IN range(1, length(query) - 1)] AS x FROM q0)),
            q2 AS (SELECT query, gram, min(n) AS n FROM q1 GROUP BY query, gram),
            q AS (SELECT query, gram, row_number() OVER (PARTITION BY query ORDER BY n) AS n, count(*) OVER (PARTITION BY query) AS size FROM q2)
            SELECT q.query AS query_id, g.id, count(*) AS shared FROM q JOIN g USING (gram) WHERE q.n <= 7 OR q.n > q.size - 8 GROUP BY q.query, g.id HAVING count(*) >= 6""",
    ),
    "search_rerank": (
        rerank,
        f"""WITH {NAMES}, s AS (SELECT id, canonical, lower(canonical) AS m, id LIKE '%3' AS syn, list_last(string_split(lower(canonical), ' ')) AS last FROM names)
            SELECT id, canonical, round(CASE WHEN starts_with(m, 'small') THEN 8.0::DOUBLE ELSE 0 END + CASE WHEN last = 'small' THEN 9.0::DOUBLE WHEN starts_with(last, 'small') THEN 6.0::DOUBLE ELSE 0 END
              + 4.0::DOUBLE * least(5, strlen(m)) / greatest(5, strlen(m)) - CASE WHEN syn THEN 2.0::DOUBLE ELSE 0 END - 0.5::DOUBLE * levenshtein('small', m), 6) AS score FROM s""",
    ),
}
