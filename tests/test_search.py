"""Search modes, trigrams and ranking on literal cases; the stored index against one that is built anew."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from canopy.operators import search as S
from canopy.operators import text_index
from canopy.operators.text_index import Superseded, TextIndex
from canopy.streaming import changes


@pytest.fixture(scope="module")
def data(spark):
    names = spark.createDataFrame([("t1", "Panthera leo"), ("t2", "Ceroplastes"), ("t3", "Ceroplastes rusci"), ("t4", "Alyxia ruscifolia"), ("t5", "Panthera")], "id string, canonical string")
    aliases = spark.createDataFrame([("a1", "t1", "Felis leo"), ("a1", "t5", "Felis leo")], "alias_id string, taxon_id string, canonical string")
    return names, aliases


def found(data, query, mode, **more):
    return [r["matched_name"] for r in S.search(*data, query, mode, **more).collect()]


def test_modes(data):
    assert "Panthera leo" not in found(data, "leo", "prefix")
    assert "Panthera leo" in found(data, "leo", "partial", include_synonyms=False)
    for query in ("Panth leo", "leo Panth", "Panthera leo", "Panthera leo (Linnaeus, 1758)"):
        assert found(data, query, "partial", include_synonyms=False) == ["Panthera leo"]
    assert "Ceroplastes" in found(data, "Cerpolastes", "fuzzy")
    assert found(data, "Pa", "fuzzy")  # too short: prefix
    assert found(data, "rusci", "partial")[0] == "Ceroplastes rusci"
    assert found(data, "  ", "partial") == []
    assert found(data, "P%an_th", "prefix") == ["Panthera", "Panthera leo"]
    with pytest.raises(ValueError):
        S.search(*data, "x", "other")


def test_pro_parte_aliases(data):
    rows = {(r["taxon_id"], r["is_synonym"]) for r in S.search(*data, "Felis", "prefix").collect()}
    assert rows == {("t1", 1), ("t5", 1)}
    assert found(data, "Felis", "prefix", include_synonyms=False) == []


def test_trigrams(spark):
    cases = {"": [], "ab": [], "cat": ["cat"], "aaaa": ["aaa"], "abcd": ["abc", "bcd"], "æøå_": ["æøå", "øå_"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.trigrams(F.col("t")).alias("g")).collect()
    assert {r["t"]: r["g"] for r in rows} == cases
    long = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz",)], "t string").select(S.query_trigrams(F.col("t")).alias("g")).first()["g"]
    assert len(long) == 15 and long[6:8] == ["ghi", "qrs"] and long[-1] == "xyz"


def test_context_and_author_bonus(spark, data):
    tree = spark.createDataFrame([("t1", "t5", "Panthera leo"), ("t5", None, "Panthera")], "id string, parent_id string, name string")
    rows = {r["taxon_id"]: (r["parent_id"], r["parent_name"], r["has_children"]) for r in S.with_context(S.search(*data, "Panthera", "prefix"), tree).collect()}
    assert rows == {"t1": ("t5", "Panthera", False), "t5": (None, None, True)}
    score = lambda author: S.rerank_score(F.lit("leo"), F.lit("Panthera leo"), F.lit(False), False, F.lit("Linnaeus, 1758"), F.lit(author))
    row = spark.range(1).select(score("Linn").alias("a"), score("Smith").alias("b"), score("").alias("c")).first()
    assert row["a"] == row["b"] + 3 == row["c"] + 3


def test_shape_bonus_and_single_hits(spark, data):
    score = lambda query, matched: spark.range(1).select(S.rerank_score(F.lit(query), F.lit(matched), F.lit(False), False)).first()[0]
    ratio = lambda a, b: 4.0 * min(len(a), len(b)) / max(len(a), len(b))
    for query, matched, bonus in [
        ("rusci", "Ceroplastes rusci", 9), ("rusci", "Alyxia ruscifolia", 6), ("rusCI", "Ceroplastes rusci", 0), ("Rusci", "Ceroplastes rusci", 0), ("Cero", "Ceroplastes rusci", 8 + 4), ("cero", "Ceroplastes rusci", 8), ("1x", "Panthera 1x", 9),
    ]:
        assert abs(score(query, matched) - bonus - ratio(query, matched)) < 1e-9, query
    assert [r["score"] for r in S.search(*data, "ceroplastes rusci", "partial").collect()] == [0.0]


TEXTS = {1: "Alpha beta gamma", 2: "beta BETA delta", 3: "", 4: "épsilon alpha", 5: None, 6: "betamax 7seven"}


def scores(df):
    return {r["id"]: r["score"] for r in df.collect()}


def rebuilt(spark, texts, prefixes, least):
    """Scores without an index."""
    df = spark.createDataFrame([(k, v) for k, v in texts.items() if v is not None], "id bigint, text string")
    per, lengths = S.postings(df, "id", F.col("text"), prefixes)
    hits = per.select(F.explode(F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.col("term").startswith(p))).alias("prefix"), "id", "tf").groupBy("prefix", "id").agg(F.sum("tf").alias("tf"))
    return scores(S._weighed(hits, lengths, least))


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id bigint, text string")


def test_stored_index_follows_edits(spark, tmp_path):
    texts, number = dict(TEXTS), 0
    index = TextIndex.build(spark, f"file://{tmp_path}/i", frame(spark, texts), "id", F.col("text"))
    for batch in [{1: "gamma only", 9: "new beta"}, {2: None, 77: None, 9: None}, {9: "again alpha", 2: "beta back"}, {6: "", 10: "betamax"}]:
        number += 1
        assert index.apply(frame(spark, batch), "s", number) and not index.apply(frame(spark, batch), "s", number)
        texts |= batch
        for prefixes, least in ((["bet"], 1), (["al", "ga"], 1), (["beta", "b"], 2), (["zzz"], 1)):
            assert scores(index.bm25(prefixes, least)) == rebuilt(spark, texts, prefixes, least)
        if number == 2:
            index.merge()
            assert len(index.state()["parts"]) == 1
    state = index.state()
    live = [t for t in texts.values() if t is not None]
    assert (state["texts"], state["length"]) == (len(live), sum(len([w for w in t.replace(",", " ").split()]) for t in live))
    index.merge()
    assert scores(index.bm25(["bet"], 1)) == rebuilt(spark, texts, ["bet"], 1)
    assert scores(index.bm25([])) == {}


def test_a_search_opens_the_folders_of_its_terms(spark, tmp_path):
    index = TextIndex.build(spark, f"file://{tmp_path}/i", frame(spark, TEXTS), "id", F.col("text"))
    index.apply(frame(spark, {8: "beta too"}))
    plan = index.bm25(["bet", "al"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [lead") >= 2 and "lead#" in plan and "StartsWith(term,bet)" in plan
    assert "IN (a,b)" in plan


def test_merge_keeps_batches_of_rivals(spark, tmp_path, monkeypatch):
    texts = dict(TEXTS)
    index = TextIndex.build(spark, f"file://{tmp_path}/i", frame(spark, texts), "id", F.col("text"))
    index.apply(frame(spark, {1: "beta one"}))
    rival, store = TextIndex(spark, index.folder), index._store

    def late(postings, name):
        store(postings, name)
        monkeypatch.undo()
        rival.apply(frame(spark, {2: None, 11: "beta eleven"}))

    monkeypatch.setattr(index, "_store", late)
    index.merge()
    assert len(index.state()["parts"]) == 2
    assert scores(index.bm25(["bet"], 1)) == rebuilt(spark, texts | {1: "beta one", 2: None, 11: "beta eleven"}, ["bet"], 1)
    old = index.state(1)
    index.merge()
    monkeypatch.setattr(index, "state", lambda version=None, s=iter([old, TextIndex.state(index)]): next(s))
    with pytest.raises(Superseded):
        index.merge()


def test_index_of_a_stream(spark, tmp_path):
    index = TextIndex.build(spark, f"file://{tmp_path}/i", frame(spark, TEXTS), "id", F.col("text"))
    for k, batch in enumerate([{1: None, 20: "beta stream"}, {20: "no more"}]):
        frame(spark, batch).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        changes.index_texts(changes.changes(spark, f"file://{tmp_path}/in", "id bigint, text string"), index, "id", "text", "in", f"file://{tmp_path}/cp").awaitTermination()
        assert (20 in scores(index.bm25(["bet"]))) == (k == 0)


def test_search_by_index_equals_search(spark, data, tmp_path):
    names, aliases = data
    pool = S.search_pool(names, aliases)
    for mode, unit in (("partial", "words"), ("fuzzy", "grams")):
        index = TextIndex.build(spark, f"file://{tmp_path}/{mode}", pool, "id", S.pool_text(pool, mode), unit)
        for query in ("leo", "cero rus", "Cerpolastes", "Panthera leo", "  "):
            want = S.search(names, aliases, query, mode).collect()
            assert S.search(names, aliases, query, mode, index=index).collect() == want


def test_terms_are_counted_by_segments(spark, monkeypatch):
    """A row for each term of a run of texts; long runs are cut, an empty or deleted text keeps its place."""
    schema = to_arrow_schema(StructType.fromDDL(text_index._schema("bigint")))
    lists = [["b", "a", "b"], [], None, ["b"], ["c", "c", "c", "c"], ["a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 16), pa.int64()), pa.array(lists, pa.list_(pa.string()))], names=["id", "terms"])
    for most, segments in ((100, 1), (5, 2), (1, 4)):
        monkeypatch.setattr(text_index, "SEGMENT", most)
        rows = [r for b in text_index._segments(schema)(iter([batch])) for r in b.to_pylist()]
        texts = {(r["segment"], r["place"]): r for r in rows if r["term"] is None}
        assert len({s for s, _ in texts}) == segments
        assert {r["id"]: (r["length"], r["alive"]) for r in texts.values()} == {10 + k: (len(x or []), x is not None) for k, x in enumerate(lists)}
        terms = [r for r in rows if r["term"] is not None]
        assert len({(r["segment"], r["term"]) for r in terms}) == len(terms)
        got = {(texts[r["segment"], p]["id"], r["term"]): n for r in terms for p, n in zip(r["places"], r["tfs"])}
        assert got == {(10 + k, t): x.count(t) for k, x in enumerate(lists) if x for t in x}
