"""Histories, parsers, edits, sources and streams on literal cases."""

import pytest
from pyspark.sql import functions as F

from canopy.functions import parsers as P
from canopy.functions import scalars as X
from canopy.operators import edits
from canopy.operators import entities as E
from canopy.operators import history as N
from canopy.operators import validation as V
from canopy.sources import formats
from canopy.sources.archive import SIDE_TABLES, Archive, ArchiveExists, UnknownVersion, evolve, logical
from canopy.streaming import changes


def test_history(spark):
    names = spark.createDataFrame([("acc", "Panthera leo", "1816"), ("bas", "Felis leo", "1758"), ("syn", "Leo leo", ""), ("own", "Felis other", "1800"), ("alone", "Solo", "")], "id string, label string, year string")
    relations = spark.createDataFrame([("acc", "bas", "BASIONYM"), ("syn", "bas", "BASIONYM"), ("acc", "own", "OTHER")], "name_id string, related_id string, type string")
    involved = spark.createDataFrame([("t1", "acc", True), ("t1", "syn", False), ("t1", "acc", False), ("t1", "own", False), ("t2", "alone", True), ("t2", "gone", False)], "taxon_id string, name_id string, accepted boolean")
    rows = N.nomenclatural_history(involved, names, relations).orderBy("taxon_id", "cluster", "position").collect()
    assert [(r["taxon_id"], r["cluster"], r["name_id"], r["role"], r["involvement"]) for r in rows] == [
        ("t1", 1, "bas", "original", "unlinked"),
        ("t1", 1, "acc", "recombination", "accepted"),
        ("t1", 1, "syn", "recombination", "synonym"),
        ("t1", 2, "own", "original", "synonym"),
        ("t2", 1, "alone", "original", "accepted"),
    ]


def test_parse_name(spark):
    cases = {
        "Panthera leo (Linnaeus, 1758)": ("Panthera leo", 2, "", "Linnaeus", "1758", "", "", 1),
        "Quercus alba var. minor (L.) Mill., 1768": ("Quercus alba minor", 3, "var.", "L.", "", "Mill.", "1768", 1),
        "Felidae Fischer de Waldheim, 1817": ("Felidae", 1, "", "", "", "Fischer de Waldheim", "1817", 1),
        "not a name": ("", 0, "", "", "", "", "", 0),
        "Panthera leo ?? 12": ("Panthera leo", 2, "", "", "", "", "", 2),
        "": ("", 0, "", "", "", "", "", 0),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "n string").select("n", P.parse_name(F.col("n")).alias("r")).select("n", "r.*").collect()
    fields = ["canonical_simple", "cardinality", "marker", "basionym_authorship", "basionym_year", "combination_authorship", "combination_year", "quality"]
    assert {r["n"]: tuple(r[f] for f in fields) for r in rows} == cases


def test_bibtex():
    entry = P.bibtex_entry('% comment\n@Article{key1, title = {The {DNA} of \\& cats}, author = "Doe, Jane and Roe, R.", journal={J. X}, year=1999, month = mar, pages={1--9}, doi={https://doi.org/10.1/ab}}\n@book{b,title={x}}')
    assert entry == {"type": "ARTICLE", "key": "key1", "title": "The DNA of & cats", "author": "Doe, Jane; Roe, R.", "container": "J. X", "issued": "1999-03", "volume": "", "page": "1–9", "doi": "10.1/ab"}
    assert P.bibtex_entry(None)["type"] == P.bibtex_entry("no entry")["title"] == ""
    assert P.bibtex_entry("@misc{k, title = {open")["title"] == "open"


def test_json_records(spark):
    work = '{"title":"T","doi":"https://doi.org/10.7717/peerj.4375","publication_date":"2018-02-13","type":"journal-article","authorships":[{"raw_author_name":"Piwowar, Heather"},{"raw_author_name":"Priem, Jason"}],"biblio":{"first_page":"e4375","last_page":"e4375"}}'
    hit = '{"part":{"id":0},"item":{"id":7,"title":"I"},"year":1900}'
    row = spark.createDataFrame([(work, hit, "{broken")], "w string, h string, b string").select(P.reference_of_work(F.col("w")).alias("w"), P.hit_of_record(F.col("h"), "p/", "i/").alias("h"), P.reference_of_work(F.col("b")).alias("b")).first()
    assert (row["w"]["author"], row["w"]["page"], row["w"]["issued"], row["w"]["doi"]) == ("Piwowar, Heather; Priem, Jason", "e4375", "2018-02-13", "10.7717/peerj.4375")
    assert row["h"]["link"] == "i/7" and row["b"]["title"] is None


def test_rank_guess(spark):
    cases = [("ZOOLOGICAL", "Panthera onca subsp. goldmani", "SUBSPECIES"), ("BOTANICAL", "Rosa gallica var. officinalis", "VARIETY"), ("BOTANICAL", "Rosa gallica f. alba", "FORM"), ("ZOOLOGICAL", "Felidae", "FAMILY"), ("ZOOLOGICAL", "Felinae", "SUBFAMILY"), ("ZOOLOGICAL", "Feloidea", "SUPERFAMILY"), ("ZOOLOGICAL", "Pantherini", "TRIBE"), ("BOTANICAL", "Rosaceae", "FAMILY"), ("BOTANICAL", "Rosoideae", "SUBFAMILY"), ("BOTANICAL", "Roseae", "TRIBE"), ("BOTANICAL", "Rosales", "ORDER"), ("VIRUS", "Coronaviridae", "FAMILY"), ("VIRUS", "Nidovirales", "ORDER"), ("ZOOLOGICAL", "Panthera", "GENUS"), ("ZOOLOGICAL", "Panthera onca", "SPECIES"), ("ZOOLOGICAL", "Panthera onca goldmani", "SUBSPECIES"), ("ZOOLOGICAL", "Rosaceae", "GENUS"), ("ZOOLOGICAL", "Panthera marina", "SUBTRIBE"), ("PHYTOSOCIOLOGICAL", "Rosopsida", "CLASS"), ("BACTERIAL", "Bacilloideae", "SUBFAMILY"), ("VIRUS", "Betavirus", "GENUS"), ("BOTANICAL", "Rosa gallica subsp. x var. Alba", "VARIETY"), ("BOTANICAL", "var. alba", "SPECIES"), ("BOTANICAL", "Rosa Sect. Caninae", "SECTION_BOTANY"), ("ZOOLOGICAL", "a b c d", ""), ("ZOOLOGICAL", "", ""), ("ZOOLOGICAL", None, ""), (None, " Felis  catus ", "SPECIES")]
    rows = spark.createDataFrame(cases, "code string, name string, want string").select("name", "want", X.guess_rank(F.col("code"), F.col("name")).alias("got")).collect()
    assert [(r["name"], r["got"]) for r in rows if r["got"] != r["want"]] == []


def test_edits_are_versioned(spark, tmp_path):
    schema = "id string, name string, modified string, modified_by string"
    store = edits.VersionedTable(spark, f"file://{tmp_path}/t")
    assert store.versions() == []
    store.write(spark.createDataFrame([("1", "a", "m1", "x"), ("2", "b", "m1", "x"), ("3", "c", None, None)], schema), 1)
    batch = spark.createDataFrame([("1", "update", "A", "m1"), ("2", "update", "B", "m0"), ("3", "delete", None, ""), ("4", "create", "D", ""), ("1x", "delete", None, ""), ("5", "create", "E", ""), ("5", "create", "F", "")], "id string, op string, name string, expected string")
    used = spark.createDataFrame([("3",)], "id string")
    got = {(r["id"], r["op"]): r["outcome"] for r in store.commit(batch, "me", "now", "id", used).collect()}
    assert got == {("1", "update"): "applied", ("2", "update"): "conflict", ("3", "delete"): "in_use", ("4", "create"): "applied", ("1x", "delete"): "missing", ("5", "create"): "repeated"}
    assert {tuple(r) for r in store.read().collect()} == {("1", "A", "now", "me"), ("2", "b", "m1", "x"), ("3", "c", None, None), ("4", "D", "now", "me")}
    assert store.versions() == [1, 2] and store.read(1).count() == 3


def test_archive(spark, tmp_path):
    Archive.create(spark, f"file://{tmp_path}/a", "title")
    assert Archive.load(spark, f"file://{tmp_path}/a")["taxon"].count() == 0
    with pytest.raises(ArchiveExists):
        Archive.create(spark, f"file://{tmp_path}/a")


def test_old_archives(spark, tmp_path):
    folder = f"file://{tmp_path}/old"
    spark.createDataFrame([(1, "a", "x1", "7"), (2, None, None, "many")], "rowid int, col__author string, col__year string, col__pages string").write.parquet(f"{folder}/reference")
    spark.createDataFrame([(1, "t", "1")], "id int, title string, version string").write.parquet(f"{folder}/metadata")
    archive = Archive.load(spark, folder, ["reference"], {"reference": {"year": "issued", "rowid": "id"}})
    rows = archive["reference"].orderBy("id").collect()
    assert [(r["id"], r["author"], r["issued"], r["title"], r["pages"]) for r in rows] == [("1", "a", "x1", None, "7"), ("2", None, None, None, "many")]
    assert all(archive[n].count() == 0 for n in SIDE_TABLES)
    assert evolve(archive["reference"], "pages int").orderBy("id").first()["pages"] == 7
    assert evolve(archive["reference"], "pages int").where("pages is null").count() == 1
    both = spark.createDataFrame([("old", "new")], "year string, issued string")
    assert evolve(both, "issued string", {"year": "issued"}).first().asDict() == {"issued": "new", "year": "old"}
    with pytest.raises(ValueError):
        logical(spark.createDataFrame([(1, 2)], "id int, col__ID int"))
    later = f"file://{tmp_path}/later"
    spark.createDataFrame([(1, "t", "10")], "id int, title string, version string").write.parquet(f"{later}/metadata")
    with pytest.raises(UnknownVersion):
        Archive.load(spark, later, [])


def test_rule_configuration(spark):
    kind = "rule_id string, enabled boolean, severity string"
    before = spark.createDataFrame([("a", False, None), ("b", True, "error")], kind)
    changes = [("a", None, None), ("b", True, "odd"), ("c", True, "info"), ("d", True, None), ("d", False, None), (None, True, None)]
    after = V.set_config(before, spark.createDataFrame(changes, kind))
    assert sorted(tuple(r) for r in after.collect()) == [("b", True, "error"), ("c", True, "info")]
    assert V.set_config(before.limit(0), spark.createDataFrame([], kind)).count() == 0
    rules = spark.createDataFrame([("b", "x", "warn"), ("c", "y", "warn"), ("e", None, "warn")], "rule_id string, ruleset string, severity string")
    listed = V.list_config(rules, after, spark.createDataFrame([("y", False)], "ruleset string, enabled boolean"))
    assert sorted((r["rule_id"], r["enabled"], r["severity"]) for r in listed.collect()) == [("b", True, "error"), ("c", False, "info"), ("e", True, "warn")]


def test_sources(spark, tmp_path):
    (tmp_path / "o.owl").write_text(
        '<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s">'
        '<owl:Class rdf:about="http://x/N_1"><rdfs:label>one</rdfs:label></owl:Class>'
        '<owl:Class rdf:about="http://x/N_2"><rdfs:subClassOf rdf:resource="http://x/N_0"/><rdfs:subClassOf rdf:resource="http://x/N_1"/><rdfs:label>two</rdfs:label></owl:Class>'
        '<owl:Class rdf:about="http://x/N_3"><rdfs:subClassOf rdf:resource="http://x/N_1"/></owl:Class></rdf:RDF>'
    )
    assert {(r["id"], r["label"], r["parent_id"]) for r in formats.read_ontology(spark, f"file://{tmp_path}/o.owl").collect()} == {("N_1", "one", None), ("N_2", "two", "N_1")}
    (tmp_path / "v.json").write_text('{"items": [\n{"id": "DE", "name": "Germany"}, {"id": "FR", "name": "France"}]}')
    assert formats.read_vocabulary(spark, f"file://{tmp_path}/v.json").count() == 2
    (tmp_path / "b.bib").write_text("@book{k, title={T}, year=2000}")
    assert [r["title"] for r in formats.read_bibliography(spark, f"file://{tmp_path}/b.bib").collect()] == ["T"]


def test_streamed_postings_follow_the_text(spark, tmp_path):
    for n, rows in enumerate([[(1, None, "red fox"), (2, None, "red dog")], [(1, "red fox", "blue fox"), (2, "red dog", None)]]):
        spark.createDataFrame(rows, "id bigint, old_text string, text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = changes.changes(spark, f"file://{tmp_path}/in", "id bigint, old_text string, text string")
        changes.index_changes(stream, "id", "text", f"file://{tmp_path}/postings", f"file://{tmp_path}/cp").awaitTermination()
    assert {(r["term"], r["id"], r["tf"]) for r in changes.current_postings(spark, f"file://{tmp_path}/postings").collect()} == {("blue", 1, 1), ("fox", 1, 1)}


def test_lists_page_hot_owners(spark):
    rows = spark.range(5000).selectExpr("cast(id div 10000 as string) AS taxon_id", "cast(id as string) AS name", "'en' AS language", "if(id = 4321, 1, null) AS preferred", "id")
    got = E.vernaculars(rows, limit=3).orderBy("position").collect()
    assert [r["id"] for r in got] == [4321, 0, 1]
    plan = E.vernaculars(rows, limit=3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_issue_labels(spark):
    names = spark.createDataFrame([("n1", "One"), ("n2", "Two"), ("n3", "Three")], "id string, label string")
    taxa = spark.createDataFrame([("t1", "n1"), ("t2", "n2"), ("t3", "n2")], "id string, name_id string")
    issues = spark.createDataFrame([("name", "n1"), ("name", "n2"), ("name", "n3"), ("taxon", "t3"), ("reference", "r")], "table_name string, record_id string")
    rows = {(r["table_name"], r["record_id"]): (r["label"], r["taxon_id"]) for r in E.label_issues(issues, names, taxa).collect()}
    assert rows == {("name", "n1"): ("One", "t1"), ("name", "n2"): ("Two", None), ("name", "n3"): ("Three", None), ("taxon", "t3"): ("Two", "t3"), ("reference", "r"): ("r", None)}


def test_pairs_are_dealt_before_they_are_made_distinct(spark):
    """A task holds its share of the distinct pairs, whatever it scans, and no repeat is lost or kept."""
    from canopy.sources.archive import part_synonyms

    items = spark.range(0, 4000, 1, 1).selectExpr("id % 1000 as l_partkey", "id % 500 as l_suppkey")
    pairs = part_synonyms(items)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted((f"P{k}", f"S{k % 500}") for k in range(1000))
    sizes = [r[0] for r in pairs.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 500
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan.split("Aggregate")[-1]  # below the aggregate
