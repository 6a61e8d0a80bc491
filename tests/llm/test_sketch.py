"""Scaled sketches: the edited texts, and estimates against exact likeness."""

import hashlib
import re

from pyspark.sql import functions as F

from canopy.llm import sketch


def edited(texts: list[str]) -> list[str]:
    out = []
    for k, text in enumerate(texts):
        cut = len(text) // 4
        out.append(text[: len(text) - cut] + texts[(k + 1) % len(texts)][:cut])
    return out


def shingles(text: str) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in sketch.op4_scaled_sketch(spark, sf_dir).collect()}
    texts = [t for _, t in documents]
    made = edited(texts)
    errors = []
    for k, (i, text) in enumerate(documents):
        row, after = got[i], texts[(k + 1) % len(texts)]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(made[k].encode()).hexdigest()
        exact = shingles(text)
        if len(exact) > 300:
            errors += [abs(row["near_edited"] - jaccard(exact, shingles(made[k]))), abs(row["near_next"] - jaccard(exact, shingles(after)))]
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    same = {}
    for i, text in documents:
        assert same.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.25


def test_containment_of_unequal_texts_and_merge(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    part = " ".join(f"w{i}" for i in range(3_000, 4_500))
    df = sketch.add_sketch(sketch.add_sketch(spark.createDataFrame([(part, long)], "a string, b string"), "a", "x"), "b", "y")
    row = df.select(
        sketch.containment(F.col("x"), F.col("y")).alias("in_long"),
        sketch.containment(F.col("y"), F.col("x")).alias("in_part"),
        (F.size(F.array_except(sketch.merge(F.col("x"), F.col("y")), "y"))).alias("more"),
    ).first()
    assert row["in_long"] == 1.0 and abs(row["in_part"] - 1500 / 20_000) < 0.03 and row["more"] == 0


def test_short_texts_within_a_long_one(spark):
    """Whenever a hash of a contained text is kept, its containment is 1; nothing else is ever kept."""
    words = [f"w{i}" for i in range(20_000)]
    rows = [(k, " ".join(words[97 * k : 97 * k + 7])) for k in range(200)]
    long = sketch.add_sketch(spark.createDataFrame([(" ".join(words),)], "text string"), "text", "y").drop("text")
    df = sketch.add_sketch(spark.createDataFrame(rows, "k int, text string"), "text", "x").join(long, F.lit(True))
    got = df.select("x", "x_bare", sketch.containment(F.col("x"), F.col("y")).alias("c")).collect()
    assert {r["c"] for r in got if r["x"]} == {1.0} and {r["c"] for r in got if not r["x"]} == {None}
    assert all((r["x_bare"] is None) == bool(r["x"]) for r in got)
    kept = sum(len(r["x"]) for r in got)
    assert abs(kept - 600 / sketch.SCALE) < 60  # three shingles a text, of which a fixed share is kept


def test_merge_is_the_sketch_of_the_union(spark):
    parts = [" ".join(f"a{i}" for i in range(900)), " ".join(f"b{i}" for i in range(700))]
    df = spark.createDataFrame([(*parts, " ".join(parts))], "a string, b string, whole string")
    for name in ("a", "b", "whole"):
        df = sketch.add_sketch(df, name, f"{name}_s")
    row = df.select(sketch.merge(F.col("a_s"), F.col("b_s")).alias("m"), "whole_s").first()
    assert set(row["m"]) <= set(row["whole_s"]) and len(set(row["whole_s"]) - set(row["m"])) <= 4  # the shingles over the border


def test_texts_without_kept_hashes(spark):
    rows = [(k, t) for k, t in enumerate([None, "", " ", "one", "one", "two", "three", "four", "five", "six"])]
    got = {r["doc_id"]: r for r in sketch.edited_likeness(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[k]["near_next"] for k in (0, 1, 3)] == [1.0, 1.0, 1.0]
    assert [got[k]["near_next"] for k in (2, 4, 5, 6, 7, 8, 9)] == [0.0] * 7
    assert got[3]["near_edited"] == 1.0  # three letters: nothing is replaced


def test_odd_rows(odd, nothing):
    rows = sketch.edited_likeness(odd).collect()
    assert len(rows) == 11
    ordered = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    want = edited([t for _, _, t in ordered])
    assert sorted(r["edited"] for r in rows) == sorted(want)
    assert sketch.edited_likeness(nothing).collect() == []


def test_single_row(spark):
    row = sketch.edited_likeness(spark.createDataFrame([(5, "abcdefgh")], "doc_id bigint, text string")).first()
    assert row["edited"] == "abcdefab"


def test_ranges_join_up(spark, monkeypatch):
    """With many small ranges the next row is still the next id, and the last row's is the first."""
    monkeypatch.setattr(sketch, "RANGE_ROWS", 3)
    rows = [(i * 7 % 101, f"text of {i * 7 % 101} " * 3) for i in range(101)]
    got = sketch.edited_likeness(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    ordered = [t for _, t in sorted(rows)]
    assert {r["doc_id"]: r["edited"] for r in got} == dict(zip(sorted(i for i, _ in rows), edited(ordered)))
