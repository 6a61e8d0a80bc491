"""Name search: prefix, token prefix with BM25, trigram overlap, and re-ranking.

Names are rows (id, canonical, authorship); aliases are rows (alias_id,
taxon_id, canonical), where one alias may lead to several taxa.  Queries are a
constant or a DataFrame of many (query_id, query), which share the postings.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.parsers import MARKERS, NAME

MODES = ("prefix", "partial", "fuzzy")
#: BM25 constants of common full-text engines.
K1, B = 1.2, 0.75
#: Trigrams taken from a query: the first seven and the last eight.
HEAD, TAIL = 7, 8
DEFAULT_LIMIT = 50


def strip_authorship(query: str) -> str:
    """A query of two or more name words without its authorship and markers; other queries as they are."""
    import regex

    found = regex.match(NAME, query)
    words = [w for w in regex.sub(r" \([^)]*\)", "", found[1]).split() if w not in MARKERS] if found else []
    return " ".join(words) if len(words) >= 2 else query


def authorship_of(query: str) -> str:
    """What follows the name in a query whose authorship can be told apart, else ''."""
    import regex

    found = regex.match(NAME, query)
    return query[found.end(1) :].strip() if found and strip_authorship(query) != query else ""


def unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and what is left of each without its accents."""
    pairs = [(chr(n), unaccented(chr(n))) for n in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(column: Column) -> Column:
    """The text without accents, written as one letter or as marks of their own."""
    return F.regexp_replace(F.translate(column, *_plain_letters()), "\\p{M}+", "")


def prefix_hits(names: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Names whose canonical form starts with the query, wildcards ignored, without regard to case."""
    plain = query.replace("%", "").replace("_", "").lower()
    hits = names.where(F.lower("canonical").startswith(plain))
    return hits.orderBy("canonical", "id").limit(limit) if limit else hits


def resolve(names: DataFrame, aliases: DataFrame, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Prefix search over accepted names and aliases; one row per taxon, an accepted hit before an alias.

    Each arm is cut to its first rows before the union, context would be joined after the final cut.
    """
    plain = query.replace("%", "").replace("_", "").lower()
    keep = lambda df: df.where(F.lower("matched_name").startswith(plain)).orderBy("matched_name", "taxon_id").limit(limit)
    own = keep(names.select(F.col("id").alias("taxon_id"), F.col("canonical").alias("matched_name"))).withColumn("is_synonym", F.lit(0))
    other = keep(aliases.select("taxon_id", F.col("canonical").alias("matched_name"))).withColumn("is_synonym", F.lit(1))
    first = Window.partitionBy("taxon_id").orderBy("is_synonym", "matched_name")
    hits = own.unionByName(other).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return hits.orderBy("matched_name", "taxon_id").limit(limit)


def substring_hits(names: DataFrame, query: str) -> DataFrame:
    return names.where(F.contains(F.lower("canonical"), F.lit(query.lower())))


def tokens(column: Column) -> Column:
    return F.filter(F.split(F.lower(column), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, id_col: str, text: Column, prefixes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, id, tf) and (id, length) of all texts; terms are counted before the shuffle.

    With ``prefixes`` only the terms that start with one of them are spread and counted; lengths are those of the whole texts.
    """
    words = docs.select(F.col(id_col).alias("id"), tokens(text).alias("words"))
    wanted = F.col("words")
    if prefixes is not None:
        some = [p.lower() for p in dict.fromkeys(prefixes)]
        wanted = F.filter("words", lambda w: F.exists(F.array(*map(F.lit, some)), lambda p: w.startswith(p)))
    terms = words.select("id", F.explode(wanted).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return terms, words.select("id", F.size("words").cast("long").alias("length"))


def bm25(terms: DataFrame, lengths: DataFrame, prefixes: list[str]) -> DataFrame:
    """(id, score) of texts with a token for every prefix; higher is better, rounded to six digits.

    ``terms`` need only hold what starts with one of the prefixes.
    """
    some = [p.lower() for p in dict.fromkeys(prefixes)]
    parts = F.array(*map(F.lit, some))
    hits = terms.select("term", "id", "tf", F.explode(F.filter(parts, lambda p: F.col("term").startswith(p))).alias("prefix"))
    return _weighed(hits.groupBy("prefix", "id").agg(F.sum("tf").alias("tf")), lengths, len(some))


def all_trigrams(text: Column) -> Column:
    """Every trigram of a lower-cased text, repeats included."""
    lower = F.lower(text)
    windows = F.transform(F.sequence(F.lit(1), F.char_length(lower) - 2), lambda i: F.substring(lower, i, F.lit(3)))
    return F.when(F.char_length(lower) >= 3, windows).otherwise(F.array().cast("array<string>"))


def grams_of(query: str) -> list[str]:
    """``query_trigrams`` of a constant query."""
    lower = query.lower()
    grams = list(dict.fromkeys(lower[i : i + 3] for i in range(len(lower) - 2)))
    return grams if len(grams) <= HEAD + TAIL else list(dict.fromkeys(grams[:HEAD] + grams[-TAIL:]))


def trigram_bm25(docs: DataFrame, id_col: str, text: Column, query: Column) -> DataFrame:
    """(id, score) of texts that share a trigram with a constant query, by the BM25 of what they share."""
    rows = docs.select(F.col(id_col).alias("id"), all_trigrams(text).alias("grams"))
    shared = rows.select("id", F.explode(F.filter("grams", lambda g: F.array_contains(query_trigrams(query), g))).alias("prefix"))
    return _weighed(shared.groupBy("prefix", "id").agg(F.count("*").alias("tf")), rows.select("id", F.size("grams").cast("long").alias("length")), 1)


def _weighed(per: DataFrame, lengths: DataFrame, least: int) -> DataFrame:
    """BM25 of texts from (prefix, id, tf), for those with ``least`` of the prefixes or more."""
    stats = lengths.agg(F.struct(F.count("*").alias("texts"), F.avg("length").alias("mean"))).scalar()
    return bm25_score(per.join(lengths, "id"), stats["texts"], F.coalesce(stats["mean"], F.lit(1.0)), least)


def bm25_score(hits: DataFrame, texts: Column, mean: Column, least: int) -> DataFrame:
    """(id, score), higher is better and rounded to six digits, of hits (prefix, id, tf, length) with ``least`` of the prefixes or more."""
    df = hits.groupBy("prefix").agg(F.count("*").alias("df"))  # one row per prefix
    full = hits.join(F.broadcast(df), "prefix")
    idf = F.log(F.lit(1.0) + (texts - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    score = full.groupBy("id").agg(F.count("*").alias("_found"), F.sum(idf * weight).alias("score"))
    return score.where(F.col("_found") >= least).select("id", F.round("score", 6).alias("score"))


def trigrams(column: Column) -> Column:
    """Distinct trigrams of a lower-cased text, in order."""
    text = F.lower(column)
    windows = F.transform(F.sequence(F.lit(1), F.char_length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(F.char_length(text) >= 3, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def query_trigrams(column: Column) -> Column:
    """The trigrams that a query is looked up by, at most ``HEAD + TAIL``."""
    grams = trigrams(column)
    return F.when(F.size(grams) <= HEAD + TAIL, grams).otherwise(F.concat(F.slice(grams, 1, HEAD), F.slice(grams, -TAIL, TAIL)))


def fuzzy_hits(names: DataFrame, queries: DataFrame, least: int = 1) -> DataFrame:
    """(query_id, id, shared): names that share at least ``least`` trigrams with a query.

    Equal names are looked up once, so that a frequent name is one entry of the postings.
    """
    grams = names.select("canonical").distinct().select("canonical", F.explode(trigrams(F.col("canonical"))).alias("gram"))
    wanted = queries.select("query_id", F.explode(query_trigrams(F.col("query"))).alias("gram"))
    shared = wanted.join(grams, "gram").groupBy("query_id", "canonical").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return shared.join(names.select("id", "canonical"), "canonical").select("query_id", "id", "canonical", "shared")


def rerank_score(query: Column, matched: Column, is_synonym: Column, fuzzy: bool, authorship: Column | None = None, author: Column | None = None) -> Column:
    """Composite score of a hit, as double.

    A query that begins with a capital prefers hits with the same first letter, one
    without any capital those whose last word it begins; a query with capitals further
    on prefers neither.  A hit whose ``authorship`` starts with the ``author`` asked for
    gets a bonus.
    """
    q, m = F.lower(query), F.lower(matched)
    first = F.substring(query, 1, 1)
    last = F.element_at(F.split(F.trim(m), "\\s+"), -1)
    capital = first.rlike("^\\p{Lu}")
    shape = (
        F.when(capital, F.when(F.substring(matched, 1, 1).eqNullSafe(first), 4.0).otherwise(0.0))
        .when(query == q, F.when(last == q, 9.0).when(last.startswith(q), 6.0).otherwise(0.0))
        .otherwise(0.0)
    )
    a, b = F.octet_length(q), F.octet_length(m)
    score = F.when(m.startswith(q), 8.0).otherwise(0.0) + shape + 4.0 * F.least(a, b) / F.greatest(a, b, F.lit(1)) - F.when(is_synonym, 2.0).otherwise(0.0)
    if authorship is not None and author is not None:
        known = (F.coalesce(author, F.lit("")) != "") & F.lower(F.coalesce(authorship, F.lit(""))).startswith(F.lower(author))
        score = score + F.when(known, 3.0).otherwise(0.0)
    return score - 0.5 * F.levenshtein(q, m) if fuzzy else score


def with_context(hits: DataFrame, tree: DataFrame) -> DataFrame:
    """The cut hits (taxon_id) with the parent's id and name, and whether there are children."""
    own = hits.join(tree.select(F.col("id").alias("taxon_id"), "parent_id"), "taxon_id", "left")
    named = own.join(tree.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name")), "parent_id", "left")
    parents = tree.select(F.col("parent_id").alias("_p")).where("_p is not null and _p <> ''").distinct()
    return named.join(parents, F.col("taxon_id") == F.col("_p"), "left").withColumn("has_children", F.col("_p").isNotNull()).drop("_p")


def search_pool(names: DataFrame, aliases: DataFrame, include_synonyms: bool = True) -> DataFrame:
    """What partial and fuzzy searches look through: distinct rows (taxon_id, canonical, …, is_synonym), and all of them as ``id``."""
    written = [c for c in ("scientific_name", "authorship") if c in names.columns]
    pool = names.select(F.col("id").alias("taxon_id"), "canonical", *written, F.lit(False).alias("is_synonym"))
    if include_synonyms:
        others = aliases.select("taxon_id", "canonical", *[c for c in written if c in aliases.columns], F.lit(True).alias("is_synonym"))
        pool = pool.unionByName(others, allowMissingColumns=True)
    return pool.distinct().withColumn("id", F.struct("taxon_id", "canonical", *written, "is_synonym"))


def pool_text(pool: DataFrame, mode: str) -> Column:
    """The text that a mode searches: names and authorships without accents, or the canonical name."""
    if mode == "fuzzy":
        return F.col("canonical")
    return fold(F.concat_ws(" ", "canonical", *[c for c in ("scientific_name", "authorship") if c in pool.columns]))


def search(names: DataFrame, aliases: DataFrame, query: str, mode: str = "prefix", include_synonyms: bool = True, limit: int = DEFAULT_LIMIT, index=None, tree: DataFrame | None = None) -> DataFrame:
    """Rows (taxon_id, matched_name, is_synonym, score), best first.

    Partial and fuzzy hits are found by BM25 over the whole pool, one per taxon; the
    best of them, ten times the limit or 100, are ranked again by ``rerank_score``; a
    single hit isn't scored.  Partial tokens may stand in the canonical or the
    scientific name or the authorship, in any order and with or without accents.

    With ``index``, a ``TextIndex`` of the pool's ``id`` and ``pool_text`` (of trigrams in
    the fuzzy mode), only its postings are read; the index of a pool with aliases serves
    searches with aliases.  With ``tree`` the hits of the final cut get their context.
    """
    given = query
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "fuzzy" and len(query) < 3:
        mode = "prefix"
    if mode != "prefix":
        query = strip_authorship(query)
    if mode == "prefix":
        hits = resolve(names, aliases if include_synonyms else aliases.limit(0), query, limit).withColumn("score", F.lit(0.0))
        return hits if tree is None else with_context(hits, tree)
    pool = search_pool(names, aliases, include_synonyms)
    if mode == "partial":
        wanted = [w for w in re.split(r"[^\w]+|_", unaccented(query).lower()) if w]
        if not wanted:
            return pool.limit(0).select("taxon_id", F.col("canonical").alias("matched_name"), "is_synonym", F.lit(0.0).alias("score"))
        found = index.bm25(wanted) if index else bm25(*postings(pool, "id", pool_text(pool, mode), wanted), wanted)
    else:
        found = index.search_grams(query) if index else trigram_bm25(pool, "id", pool_text(pool, mode), F.lit(query))
    hits = found.select("id.*", F.col("score").alias("_bm25"))
    best = Window.partitionBy("taxon_id").orderBy("is_synonym", F.desc("_bm25"), "canonical")
    hits = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    hits = hits.orderBy(F.desc("_bm25"), "canonical", "taxon_id").limit(max(10 * limit, 100))
    author = F.lit(authorship_of(given)) if "authorship" in pool.columns else None
    score = rerank_score(F.lit(query), F.col("canonical"), F.col("is_synonym"), mode == "fuzzy", F.col("authorship") if author is not None else None, author)
    several = F.count("*").over(Window.partitionBy(F.lit(0))) > 1  # over the few rows of the cut
    hits = hits.select("taxon_id", F.col("canonical").alias("matched_name"), "is_synonym", F.when(several, score).otherwise(0.0).alias("score"))
    hits = hits.orderBy(F.desc("score"), "matched_name", "taxon_id").limit(limit)
    return hits if tree is None else with_context(hits, tree)
