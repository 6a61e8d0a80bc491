"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash
range, and no other.  Its size follows the text's, so the sketches of a short and
a very long text still estimate how much of the one is contained in the other,
and the sketch of a union of shingle sets is the union of theirs (``merge``).

Words are runs without ASCII white space; a shingle is five words in a row, or
all words of a shorter text.  Null and empty texts have no shingles.

A sketch without hashes (a short text, or one without words) says nothing about
likeness.  The fingerprint of such a text is a digest of all its shingles
instead of the kept hashes, and its likeness is 1 to an equal fingerprint and 0
to all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.common import table

SHINGLE = 5
#: One hash of so many is kept.
SCALE = 4
#: Rows of a document range in ``with_next``; bounds the rows that a window holds.
RANGE_ROWS = 2000
#: Most ranges whose bounds are held as constants; larger tables have larger ranges.
RANGES = 20_000


def sketch(text: Column, size: int = SHINGLE, scale: int = SCALE) -> list[tuple[str, Column]]:
    """Named steps of a text column's sketch, each to be added with ``withColumn`` before the next.

    They end in ``_sketch``, the ascending array of kept hashes, and ``_bare``, which
    is null but for a text without kept hashes: there it is a digest of its shingles.
    """
    top = -(2**63) + 2**64 // scale
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    at = lambda i, k: F.get(F.col("_words"), i + k)
    rows = F.when(
        F.size("_words") >= size,
        F.transform(F.sequence(F.lit(0), F.size("_words") - size), lambda i: F.xxhash64(*[at(i, k) for k in range(size)])),
    ).when(F.size("_words") > 0, F.array(F.xxhash64("_words"))).otherwise(F.array().cast("array<bigint>"))
    return [
        ("_words", F.transform(words, lambda w: F.xxhash64(w))),
        ("_hashes", rows),
        ("_sketch", F.sort_array(F.array_distinct(F.filter("_hashes", lambda h: h < F.lit(top))))),
        ("_bare", F.when(F.size("_sketch") == 0, F.xxhash64(F.sort_array(F.array_distinct("_hashes"))))),
    ]


def add_sketch(df: DataFrame, text: str, name: str, size: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch as ``name`` and the digest of a text without kept hashes as ``name`` + ``_bare``."""
    for step, column in sketch(F.coalesce(F.col(text), F.lit("")), size, scale):
        df = df.withColumn(step, column)
    return df.drop("_words", "_hashes").withColumnsRenamed({"_sketch": name, "_bare": f"{name}_bare"})


def fingerprint(hashes: Column, bare: Column) -> Column:
    """A sketch as text: its hashes as 16 hex digits each, or ``-`` and the digest of a text without kept hashes."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.when(F.size(hashes) == 0, F.concat(F.lit("-"), digits(bare))).otherwise(F.array_join(F.transform(hashes, digits), ""))


def resemblance(a: Column, b: Column, bare_a: Column, bare_b: Column) -> Column:
    """Estimated share of the joint shingles that both texts have."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, bare_a.eqNullSafe(bare_b).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; null if none of its hashes is kept."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column) -> Column:
    """Sketch of the union of two shingle sets."""
    return F.sort_array(F.array_union(a, b))


def _longs(values: list[int]) -> Column:
    """A constant array, small in the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _place(value: Column, cuts: list[int]) -> Column:
    """0-based number of the last cut that isn't above the value (0 below the first), by two short searches."""
    step = max(1, int(len(cuts) ** 0.5))
    upto = lambda some: F.size(F.filter(some, lambda c: c <= value))
    block = F.greatest(upto(_longs(cuts[::step])) - 1, F.lit(0)) * step
    return F.greatest(block + upto(F.slice(_longs(cuts), block + 1, F.lit(step))) - 1, F.lit(0)).cast("int")


def with_next(docs: DataFrame, id_col: str, columns: list[str], finish) -> DataFrame:
    """``finish(rows, window)`` over ranges of ascending id, where ``lead`` over the window sees the next row.

    Each range also holds a copy of the first rows of the range after it (the
    first after the last), so the next row is always at hand and one shuffle
    does.  Only one bound per range comes to the driver.  Rows of equal id are
    ordered by their other columns; rows without id come first.  Ids are whole
    numbers; rows of one id lie in one range.
    """
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("_order"), F.col(id_col).alias("_id"), *columns)
    n = max(1, min(RANGES, rows.count() // RANGE_ROWS))
    cuts = sorted(set(rows.agg(F.percentile_approx("_order", [k / n for k in range(n)], 100_000)).first()[0] or [0]))
    rows = rows.withColumn("_range", _place(F.col("_order"), cuts))
    first = {r["_range"]: r["_order"] for r in rows.groupBy("_range").agg(F.min("_order").alias("_order")).collect()}
    there = sorted(first) or [0]
    before = dict(zip(there, [there[-1], *there[:-1]]))
    every = range(there[-1] + 1)
    is_first = F.col("_order") == F.get(_longs([first.get(r, 0) for r in every]), F.col("_range"))
    home = F.struct(F.col("_range").alias("at"), F.lit(0).alias("ghost"))
    copy = F.struct(F.get(_longs([before.get(r, 0) for r in every]), F.col("_range")).cast("int").alias("at"), F.lit(1).alias("ghost"))
    places = F.when(is_first, F.array(home, copy)).otherwise(F.array(home))
    dealt = rows.select("*", F.explode(places).alias("_place")).select("_order", "_id", *columns, "_place.*")
    window = Window.partitionBy("at").orderBy("ghost", "_order", *columns)
    return finish(dealt, window).where("ghost = 0").drop("at", "ghost", "_order").withColumnRenamed("_id", id_col)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: text, edited text, the sketches of both, and how alike they and the next document are.

    The edited text has the last quarter of the code points replaced by the
    first as many (or all) of the next document.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def finish(dealt: DataFrame, window) -> DataFrame:
        dealt = add_sketch(dealt, "text", "sketch")
        dealt = dealt.withColumn("_next", F.lead("text").over(window)).withColumn("_far", F.lead(F.struct("sketch", "sketch_bare")).over(window))
        dealt = dealt.withColumn("next_sketch", F.col("_far.sketch")).withColumn("next_sketch_bare", F.col("_far.sketch_bare")).drop("_far")
        dealt = dealt.where("ghost = 0").withColumn("n_chars", F.char_length("text").cast("long"))
        cut = F.floor(F.col("n_chars") / 4).cast("int")
        edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("_next", F.lit(1), cut))
        return add_sketch(dealt.withColumn("edited", edited).drop("_next"), "edited", "edited_sketch")

    made = with_next(rows, id_col, ["text"], finish)
    return (
        made.withColumn("near_edited", resemblance(*map(F.col, ("sketch", "edited_sketch", "sketch_bare", "edited_sketch_bare"))))
        .withColumn("near_next", resemblance(*map(F.col, ("sketch", "next_sketch", "sketch_bare", "next_sketch_bare"))))
        .withColumn("contained_edited", containment(F.col("sketch"), F.col("edited_sketch")))
        .withColumn("contained_next", containment(F.col("sketch"), F.col("next_sketch")))
    )


def op4_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_likeness(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch"), F.col("sketch_bare")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch"), F.col("edited_sketch_bare")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "contained_edited",
        "contained_next",
    )
