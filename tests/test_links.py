"""Edits of linked rows on literal cases: compounds, empty batches, nulls and repeated rows."""

from pyspark.sql import functions as F

from canopy.operators import links
from canopy.operators import search as S

STAMP = "modified string, modified_by string"
SYNONYM = f"id string, taxon_id string, name_id string, status_id string, {STAMP}"
CHANGE = "op string, id string, taxon_id string, name_id string, status_id string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_basionyms_come_whole_or_not_at_all(spark):
    names = spark.createDataFrame([("n1", "A b", "", ""), ("n2", "A c", "", "")], f"id string, canonical string, {STAMP}")
    synonyms = spark.createDataFrame([], SYNONYM)
    relations = spark.createDataFrame([], f"name_id string, related_id string, type string, {STAMP}")
    batch = [("t1", "n1", "n9", "Z b"), ("t1", "n1", "n2", "taken"), ("t2", "n8", "n7", "no name"), ("t2", "n2", "n6", None), ("t3", "n2", "n5", "twice"), ("t3", "n1", "n5", "twice"), ("t4", "n1", "n1", "same")]
    n, s, r, checked = links.add_basionyms(names, synonyms, relations, spark.createDataFrame(batch, "taxon_id string, name_id string, basionym_id string, canonical string"), "me", "now")
    assert sorted(x["outcome"] for x in checked.collect()) == ["applied", "exists", "incomplete", "missing", "repeated", "repeated", "self"]
    assert [x for x in rows(n) if x[2]] == [("n9", "Z b", "now", "me")]
    assert [x[1:] for x in rows(s)] == [("t1", "n9", None, "now", "me")]
    assert rows(r) == [("n1", "n9", "BASIONYM", "now", "me")]


def test_pro_parte_synonyms(spark):
    now = spark.createDataFrame([("y1", "t2", "n1", "S", "", ""), ("y1", "t1", "n1", "S", "", ""), ("y2", "t1", "n2", "S", "", "")], SYNONYM)
    changes = [("extend", "y2", "t5", None, None), ("extend", "y2", "t6", None, None), ("extend", "y2", "t1", None, None), ("move", "y1", "t7", None, None), ("add", None, "t1", "n3", "S"), ("remove", "y0", None, None, None), ("add", None, None, "n3", None)]
    checked = links.check_synonyms(now, spark.createDataFrame(changes, CHANGE))
    assert sorted(x["outcome"] for x in checked.collect()) == ["applied"] * 4 + ["incomplete", "missing", "unchanged"]
    after = rows(links.apply_synonyms(now, checked, "me", "now"))
    assert [x[:3] for x in after if x[0] == "y1"] == [("y1", "t7", "n1")]  # two links fall together
    assert [x[1:3] for x in after if x[0] == "y2"] == [("t1", "n2"), ("t5", "n2"), ("t6", "n2")]
    assert [x[1:] for x in after if x[0] not in ("y1", "y2")] == [("t1", "n3", "S", "now", "me")]
    nothing = links.check_synonyms(now, spark.createDataFrame([], CHANGE))
    assert rows(links.apply_synonyms(now, nothing, "me", "now")) == rows(now)


def test_small_joins(spark):
    terms = spark.createDataFrame([("a", "kept")], "id string, name string")
    more = spark.createDataFrame([("a", "new"), ("b", "new"), ("b", "new")], "id string, name string")
    assert rows(links.seed(terms, more)) == [("a", "kept"), ("b", "new")]
    taxa = spark.createDataFrame([("t1", "n1"), ("t2", None)], "id string, name_id string")
    names = spark.createDataFrame([("n1", "BOTANICAL")], "id string, code_id string")
    parents = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "id string")
    assert rows(links.code_for_parent(parents, taxa, names)) == [("t1", "BOTANICAL"), ("t2", ""), ("t3", "")]
    metadata = spark.createDataFrame([(1, "x"), (2, "y")], "id int, title string")
    assert rows(links.touch(metadata, metadata.where("id = 2"), "me", "now")) == [(1, "", ""), (2, "now", "me")]


def test_search_over_accents_and_authors(spark):
    names = spark.createDataFrame([("t1", "Müllera été", "(Linné, 1758)"), ("t2", "Mullera este", "Smith")], "id string, canonical string, authorship string")
    aliases = spark.createDataFrame([], "alias_id string, taxon_id string, canonical string, authorship string")
    got = lambda q, mode="partial": [r["taxon_id"] for r in S.search(names, aliases, q, mode).collect()]
    assert got("mull") == ["t1", "t2"] or got("mull") == ["t2", "t1"]
    assert got("linn") == ["t1"] and got("smi mül") == ["t2"]
    assert got("ét") == ["t1"]
    assert S.authorship_of("Panthera leo (Linnaeus, 1758)") == "(Linnaeus, 1758)" and S.authorship_of("leo") == ""
    assert spark.range(1).select(S.fold(F.lit("Ünïcode é")).alias("x")).first()["x"] == "Unicode e"
