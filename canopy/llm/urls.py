"""URL filtering by association rules over URL tokens.

Fixed rules (host, path prefix, verdict) decide first: the longest rule whose
host is the URL's host or a parent domain and whose path starts the URL's path.
For all other URLs, Spark's FP-growth mines combinations of URL tokens from
labelled URLs.  Rules that lead to a label are pruned by support and confidence
and matched by an inverted index from a rule's rarest token: a URL looks up only
the rules that its own tokens point to, and a rule fires if all its tokens are
there.  The fired rule of highest confidence decides, a URL without one gets the
default verdict.

All tokens of all labelled URLs are mined and rules have any length; support and
confidence alone prune.  Tokens that occur in exactly the same labelled URLs
(twins, such as a host's label by its place and as a word) are one item under
one name, so that a long path that always comes whole gives one item and not all
subsets of its steps; a URL has the item if it has one of the twins.

Null URLs and those without ``://`` have an empty host and path and get the
default verdict.  Repeated rows and empty tables are allowed.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import cut, table

#: Rule table of the query: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SUPPORT, CONFIDENCE = 0.001, 0.9
#: Parts that the URLs of a frequent token are looked up in.
SALTS = 16
ALLOW, BLOCK = "allow", "block"
_LABEL = "label="


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(rest, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that wins, as ``host`` + ``path`` text, and its verdict; nulls if none fits.

    Longest means the most characters of host and path together, then of the host; the rule list is small.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: labels of the host from the right with their place, words of host and path."""
    labels = F.reverse(F.split(host, "\\."))
    placed = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.filter(F.split(host, "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.lit("w:"), w))
    steps = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, "[0-9]+", "0")))
    return F.array_distinct(F.concat(placed, words, steps))


def twins(labelled: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(token, twin): the tokens of ``labelled`` (tokens, verdict) that reach the support, and the least one of those that occur in the same rows.

    Rows of equal tokens are counted before they are spread; two tokens are twins
    if two 64-bit sums over their rows and the number of rows are equal.
    """
    rows = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n"))
    spread = rows.select(F.explode(F.array_distinct("tokens")).alias("token"), "n", F.xxhash64("tokens", "verdict").alias("x"), F.xxhash64("verdict", "tokens").alias("y"))
    seen = spread.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    seen = cut(seen.where(F.col("n") >= support * labelled.count()))
    return seen.join(seen.groupBy("n", "x", "y").agg(F.min("token").alias("twin")), ["n", "x", "y"]).select("token", "twin")


def by_twins(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (tokens, ...) with ``items``: the names of their tokens by ``names`` (token, twin), in order; tokens without a name have none."""
    sets = rows.select("tokens").distinct()
    named = sets.select("tokens", F.explode("tokens").alias("token")).join(names, "token").groupBy("tokens").agg(F.sort_array(F.collect_set("twin")).alias("items"))
    return rows.join(named, "tokens", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Association rules (rule_tokens, verdict, confidence, support) from rows (tokens, verdict).

    Equal token sets of a hot host are one transaction repeated; FP-growth
    counts them per partition before it shuffles.
    """
    spark = labelled.sparkSession
    baskets = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
    if baskets.isEmpty():
        return spark.createDataFrame([], "rule_tokens array<string>, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.size("consequent") == 1).select("antecedent", F.col("consequent")[0].alias("then"), "confidence", "support")
    found = found.where(F.col("then").startswith(_LABEL))
    found = found.where(~F.exists("antecedent", lambda t: t.startswith(_LABEL)))
    return found.select(F.array_sort("antecedent").alias("rule_tokens"), F.substring("then", len(_LABEL) + 1, 100).alias("verdict"), "confidence", "support")


def prune(rules: DataFrame) -> DataFrame:
    """Rules without a more general rule (of fewer tokens, all of them its own) of the same verdict that is at least as confident.

    A rule is listed at its rarest token and looked up at all tokens of the others, so
    rules without a common token are never compared.
    """
    numbered = rules.withColumn("key", F.concat_ws("\x01", "rule_tokens"))
    tokens = numbered.select("key", "verdict", F.explode("rule_tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    entry = tokens.join(often, "token").groupBy("key", "verdict").agg(F.min_by("token", F.struct("often", "token")).alias("token"))
    general = entry.join(numbered.select("key", "verdict", F.col("rule_tokens").alias("few"), F.col("confidence").alias("c")), ["key", "verdict"]).drop("key")
    longer = tokens.join(numbered.select("key", "verdict", F.col("rule_tokens").alias("many"), "confidence"), ["key", "verdict"])
    within = (F.size("few") < F.size("many")) & (F.size(F.array_except("few", "many")) == 0)
    worse = longer.join(general, ["token", "verdict"]).where((F.col("c") >= F.col("confidence")) & within)
    return numbered.join(worse.select("key", "verdict").distinct(), ["key", "verdict"], "left_anti").drop("key")


def match(urls: DataFrame, rules: DataFrame, default: str = ALLOW, names: DataFrame | None = None) -> DataFrame:
    """The rows of ``urls`` (``tokens``, any other columns) with ``mined_verdict`` and ``mined_rule``.

    URLs of equal tokens are looked up once.  The inverted index has one entry
    per rule, at its rarest token, so that a token of every URL has few entries;
    entries are copied to ``SALTS`` places, to which the URLs of a token are dealt.
    ``names`` (token, twin) are the items that the rules were mined from; without
    them each token is its own.
    """
    sets = urls.groupBy("tokens").agg(F.count("*").alias("n"))
    sets = by_twins(sets, names) if names is not None else sets.withColumn("items", F.col("tokens"))
    salt = F.pmod(F.xxhash64("tokens"), F.lit(SALTS)).cast("int")
    exploded = sets.select("tokens", "items", "n", salt.alias("salt"), F.explode("items").alias("token"))
    often = exploded.groupBy("token").agg(F.sum("n").alias("often"))
    numbered = rules.select("*", F.concat_ws(" ", "rule_tokens").alias("name"))
    spread = numbered.select("name", "verdict", F.explode("rule_tokens").alias("token")).join(often, "token")
    entry = spread.groupBy("name", "verdict").agg(F.min_by("token", F.struct("often", "token")).alias("token"))
    index = entry.join(numbered, ["name", "verdict"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fired = exploded.join(index, ["token", "salt"]).where(F.size(F.array_except("rule_tokens", "items")) == 0)
    best = fired.groupBy("tokens").agg(F.max(F.struct("confidence", "support", F.size("rule_tokens").alias("size"), "verdict", "name")).alias("best"))
    return urls.join(best, "tokens", "left").select(
        *[F.col(c) for c in urls.columns],
        F.coalesce("best.verdict", F.lit(default)).alias("mined_verdict"),
        F.col("best.name").alias("mined_rule"),
    )


def learn(labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """The pruned rules that ``labels`` (url, verdict) give, and the names of their items."""
    known = cut(labels.select(tokens_of(host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "verdict"))
    names = cut(twins(known, support))
    items = by_twins(known, names).select(F.col("items").alias("tokens"), "verdict")
    return cut(prune(mine(items, support, confidence))), names


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, mined_rule of every URL.

    ``labels`` (url, verdict) are what FP-growth learns from.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("fixed"), tokens_of(F.col("host"), F.col("path")).alias("tokens"))
    mined, names = learn(labels)
    left = match(rows.where("fixed is null"), mined, names=names)
    fixed = rows.where("fixed is not null").select("*", F.col("fixed").alias("mined_verdict"), F.lit(None).cast("string").alias("mined_rule"))
    return left.unionByName(fixed).select(F.col("_id").alias(id_col), "host", "path", "rule", F.col("mined_verdict").alias("verdict"), "mined_rule")


def rule_labels(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """Labelled URLs (url, verdict): those that a fixed rule decides."""
    _, verdict = longest_rule(host_of(F.col(url_col)), path_of(F.col(url_col)), rules)
    return pages.select(F.col(url_col).alias("url"), verdict.alias("verdict")).where("verdict is not null")


def op9_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_labels(pages))
