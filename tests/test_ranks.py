"""The rank dimension against brute force, its chains, and vocabulary tables."""

import pytest

from canopy.functions import vocabulary as Voc
from canopy.operators import ranks as R


def brute(ranks, code, parent):
    """Child ranks by the rule, one rank at a time."""
    mine = {r.rank: r for r in ranks if r.code == code}
    if not mine:
        return None
    known = next((p for p in (parent, parent.removesuffix("_ZOOLOGY").removesuffix("_BOTANY")) if p in mine), None)
    if known is None:
        return sorted(mine)
    place = {r: n for (c, _), chain in R.chains(ranks).items() if c == code for n, r in enumerate(chain)}
    out = []
    for r in mine.values():
        g, up = R.GROUPS.index(r.group), R.GROUPS.index(mine[known].group)
        if g < up or (g == up and place[r.rank] <= place[known]):
            continue
        if known in r.only_under if r.only_under else g - up <= 1:
            out.append(r.rank)
    return sorted(out)


def test_child_ranks_of_all_codes_and_parents(spark):
    ranks = R.fixed()
    parents = [(c, r.rank + s) for c in ["ZOOLOGICAL", "BOTANICAL", "BACTERIAL", "VIRUS", "CULTIVARS", None] for r in ranks for s in ("", "_BOTANY")] + [("VIRUS", ""), ("BOTANICAL", None), ("", "GENUS")]
    parents = sorted({(c or "", r or "") for c, r in parents})
    rows = spark.createDataFrame([(c or None, r or None) for c, r in parents], "code string, rank string")
    found = R.with_child_ranks(rows, rows["code"], rows["rank"], R.table(spark)).collect()
    assert len(found) == len(parents)
    for r in found:
        told = r["child_ranks"] if r["child_ranks"] is None else [x["child_rank"] for x in r["child_ranks"]]
        assert told == brute(ranks, r["code"] or "", r["rank"] or ""), r


def test_what_is_known_of_child_ranks(spark):
    rows = spark.createDataFrame([("ZOOLOGICAL", "GENUS"), ("ZOOLOGICAL", "SPECIES"), ("BOTANICAL", "SPECIES"), ("BOTANICAL", "SECTION_BOTANY"), ("ZOOLOGICAL", "KINGDOM"), ("VIRUS", "FAMILY"), ("ZOOLOGICAL", "SUBSPECIES")], "code string, rank string")
    found = {(r["code"], r["rank"]): {x["child_rank"]: x["typical"] for x in r["child_ranks"]} for r in R.with_child_ranks(rows, rows["code"], rows["rank"], R.table(spark)).collect()}
    assert "SUBSPECIES" not in found["ZOOLOGICAL", "GENUS"] and found["ZOOLOGICAL", "GENUS"]["SPECIES"] is True and found["ZOOLOGICAL", "GENUS"]["SUPERSPECIES"] is False
    assert found["ZOOLOGICAL", "SPECIES"] == {"SUBSPECIES": True}
    assert set(found["BOTANICAL", "SPECIES"]) == {"SUBSPECIES", "VARIETY", "FORM"}
    assert {"SUBSECTION", "SERIES", "SPECIES"} <= set(found["BOTANICAL", "SECTION_BOTANY"]) and "SECTION" not in found["BOTANICAL", "SECTION_BOTANY"]
    assert "SUPERKINGDOM" not in found["ZOOLOGICAL", "KINGDOM"] and "GENUS" not in found["ZOOLOGICAL", "KINGDOM"] and "FAMILY" in found["ZOOLOGICAL", "KINGDOM"]
    assert set(found["VIRUS", "FAMILY"]) == {"SUBFAMILY", "GENUS"}
    assert found["ZOOLOGICAL", "SUBSPECIES"] == {}


def test_chains():
    r = lambda rank, parent, group="family": R.Rank("X", rank, group, parent)
    branched = [r("B2", "A"), r("A", ""), r("C", "B1"), r("B1", "A"), r("Z", "elsewhere"), r("G", "C", "genus"), r("L1", "L2"), r("L2", "L1")]
    assert R.chains(branched) == {("X", "family"): ["A", "B1", "C", "B2", "Z"], ("X", "genus"): ["G"]}
    long = [r(f"{n:04}", f"{n - 1:04}" if n else "") for n in range(5000)]
    assert R.chains(reversed(long))["X", "family"] == [f"{n:04}" for n in range(5000)]


def test_rank_tables_that_are_refused(spark):
    for bad in ([R.Rank("X", "A", "family"), R.Rank("X", "A", "genus")], [R.Rank("X", "A", "tribe")], [R.Rank("X", str(n), "genus") for n in range(R.MOST_RANKS + 1)]):
        with pytest.raises(R.NoRankTable):
            R.table(spark, bad)
    assert R.table(spark, []).count() == 0


def test_new_children(spark):
    name = spark.createDataFrame(
        [("n1", "ZOOLOGICAL", "GENUS", "Felis", "Felis s", "Felis L."), ("n2", "ZOOLOGICAL", "SPECIES", "", "Felis catus", "x"), ("n3", "", "SUBSPECIES", None, None, "Felis catus x"), ("n4", "BOTANICAL", "FAMILY", "Fagaceae", "", ""), ("n5", None, "SPECIES", None, "", None)],
        "id string, code_id string, rank_id string, canonical_full string, canonical_simple string, scientific_name string",
    )
    taxon = spark.createDataFrame([(f"t{n}", f"n{n}") for n in range(1, 7)] + [("t7", None), ("t8", "")], "id string, name_id string")
    found = {r["id"]: r for r in R.new_children(taxon, name, R.table(spark)).collect()}
    assert {k: r["prefix"] for k, r in found.items()} == {"t1": "Felis ", "t2": "Felis catus ", "t3": "Felis catus x ", "t4": "", "t5": "", "t6": "", "t7": "", "t8": ""}
    assert {k for k, r in found.items() if r["child_ranks"] is None} == {"t3", "t5", "t6", "t7", "t8"}
    # an archive's own flags, and names without the optional columns
    flags = spark.createDataFrame([("FAMILY", True, False)], "rank string, genus_group boolean, infraspecific boolean")
    few = R.new_children(taxon, name.select("id", "code_id", "rank_id", "scientific_name"), R.table(spark), flags).collect()
    assert {r["id"]: r["prefix"] for r in few}["t2"] == "x " and {r["id"]: r["prefix"] for r in few}["t1"] == ""
    assert R.new_children(taxon.limit(0), name.limit(0), R.table(spark)).count() == 0


def test_vocabulary_tables(spark):
    tables = {
        "sex": spark.createDataFrame([("MALE_X",), (None,), ("FEMALE",)], "id string"),
        "rank": spark.createDataFrame([("A", "z"), ("B", "y"), ("C", None)], "id string, name string"),
        "species_interaction_type": spark.createDataFrame([("", "unset"), ("EATS", "eats")], "id string, name string"),
        "another": spark.createDataFrame([("q",)], "id string"),
    }
    found = [(r["vocabulary"], r["position"], r["id"], r["name"]) for r in Voc.of_tables(tables, ["CC0", "B", "A"]).collect()]
    assert sorted(found) == [
        ("license", 0, "CC0", "CC0"), ("license", 1, "B", "B"), ("license", 2, "A", "A"), ("rank", 0, "C", ""), ("rank", 1, "B", "y"), ("rank", 2, "A", "z"),
        ("sex", 0, "", ""), ("sex", 1, "FEMALE", "female"), ("sex", 2, "MALE_X", "male x"), ("species_interaction_type", 0, "EATS", "eats"),
    ]
