"""Ranks as a dimension: their order per code, what may stand below what, and what new children start from.

A rank has a group (higher, family, genus, species), a place in its group's chain and,
for some, the only ranks that it may stand under.  All of this is data (``Rank``): the
fixed values below, or an archive's own rank table.  A collection is joined with one
row per code, so its size doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions.scalars import empty, text
from canopy.functions.vocabulary import bare_rank
from canopy.operators.rules import RANK_ORDER

GROUPS = ["higher", "family", "genus", "species"]
# Fixed values of the domain.
#: The first rank of each group after the highest, per code; RANK_ORDER has all ranks in order.
FIRST = {
    "BACTERIAL": {"FAMILY": "family", "GENUS": "genus", "SPECIES": "species"},
    "BOTANICAL": {"FAMILY": "family", "GENUS": "genus", "SPECIES": "species"},
    "VIRUS": {"FAMILY": "family", "GENUS": "genus", "SPECIES": "species"},
    "ZOOLOGICAL": {"SUPERFAMILY": "family", "SUPERGENUS": "genus", "SUPERSUPERSPECIES": "species"},
}
#: Ranks that stand under these ranks only.
ONLY_UNDER = {
    "BACTERIAL": {"SUBCLASS": ["CLASS"], "SUBORDER": ["ORDER"], "SUBFAMILY": ["FAMILY"], "TRIBE": ["SUBFAMILY"], "SUBTRIBE": ["TRIBE"], "SUBGENUS": ["GENUS"], "SUBSPECIES": ["SPECIES"]},
    "BOTANICAL": {
        "SUBKINGDOM": ["KINGDOM"], "SUBPHYLUM": ["PHYLUM"], "SUBCLASS": ["CLASS"], "SUBORDER": ["ORDER"], "SUBFAMILY": ["FAMILY"], "TRIBE": ["SUBFAMILY"], "SUBTRIBE": ["TRIBE"],
        "SUBGENUS": ["GENUS"], "SECTION": ["GENUS", "SUBGENUS"], "SUBSECTION": ["SECTION"], "SERIES": ["GENUS", "SUBGENUS", "SECTION", "SUBSECTION"], "SUBSERIES": ["SERIES"],
        "SUBSPECIES": ["SPECIES"], "VARIETY": ["SPECIES", "SUBSPECIES"], "SUBVARIETY": ["VARIETY"], "FORM": ["SPECIES", "SUBSPECIES", "VARIETY", "SUBVARIETY"], "SUBFORM": ["FORM"],
    },
    "VIRUS": {},
    "ZOOLOGICAL": {
        "SUBKINGDOM": ["KINGDOM"], "INFRAKINGDOM": ["SUBKINGDOM"], "SUBPHYLUM": ["PHYLUM"], "INFRAPHYLUM": ["SUBPHYLUM"], "SUBCLASS": ["CLASS"], "INFRACLASS": ["SUBCLASS"],
        "MIRORDER": ["SUPERORDER"], "SUBORDER": ["ORDER"], "INFRAORDER": ["SUBORDER"],
        "SUPERSUBFAMILY": ["FAMILY"], "SUBFAMILY": ["FAMILY", "SUPERSUBFAMILY"], "INFRAFAMILY": ["SUBFAMILY"], "SUPERTRIBE": ["SUBFAMILY"], "TRIBE": ["SUPERTRIBE", "SUBFAMILY"], "SUBTRIBE": ["TRIBE"], "INFRATRIBE": ["SUBTRIBE"],
        "SUPERSUPERSUBGENUS": ["GENUS"], "SUPERSUBGENUS": ["GENUS"], "SUBGENUS": ["GENUS"], "INFRAGENUS": ["SUBGENUS"],
        "SUBSUPERSPECIES": ["SUPERSPECIES"], "SUBSPECIES": ["SPECIES"],
    },
}
#: Ranks that aren't offered at first.
RARE = {
    "ZOOLOGICAL": [
        "SUPERKINGDOM", "SUBKINGDOM", "INFRAKINGDOM", "SUPERPHYLUM", "SUBPHYLUM", "INFRAPHYLUM", "SUPERCLASS", "SUBCLASS", "INFRACLASS", "SUPERCOHORT", "COHORT", "MAGNORDER", "SUPERORDER", "MIRORDER",
        "SUBORDER", "INFRAORDER", "PARVORDER", "NANORDER", "EPIFAMILY", "SUPERSUBFAMILY", "INFRAFAMILY", "SUPERTRIBE", "INFRATRIBE", "SUPERGENUS", "SUPERSUPERSUBGENUS", "SUPERSUBGENUS", "INFRAGENUS",
        "SUPERSUPERSPECIES", "SUPERSPECIES", "SUBSUPERSPECIES",
    ],
}
#: Ranks of species that are neither of the genus group nor below a species.
OF_SPECIES = ["SPECIES", "SPECIES_AGGREGATE"]
#: A rank table is a vocabulary; more rows than this are refused before they are broadcast.
MOST_RANKS = 10_000

RANK = "code string, rank string, group int, position int, only_under array<string>, typical boolean"


class NoRankTable(ValueError):
    """Rows that can't be a rank table."""


@dataclass(frozen=True)
class Rank:
    code: str
    rank: str
    group: str
    parent: str = ""
    only_under: tuple[str, ...] = ()
    typical: bool = True


def fixed() -> list[Rank]:
    """The ranks of the four codes: each one's parent is the rank before it."""
    out = []
    for code, order in RANK_ORDER.items():
        group = GROUPS[0]
        for before, rank in zip(["", *order], order, strict=False):
            group = FIRST[code].get(rank, group)
            out.append(Rank(code, rank, group, before, tuple(ONLY_UNDER[code].get(rank, ())), rank not in RARE.get(code, ())))
    return out


def chains(ranks: Iterable[Rank]) -> dict[tuple[str, str], list[str]]:
    """The ranks of each (code, group) from the top down: parents first, siblings by name.

    A rank whose parent isn't of its group starts a chain of its own; ranks that only
    lead to each other have no top and are in no chain.
    """
    groups: dict[tuple[str, str], dict[str, str]] = {}
    for r in ranks:
        groups.setdefault((r.code, r.group), {})[r.rank] = r.parent
    out = {}
    for key, parents in groups.items():
        below: dict[str, list[str]] = {}
        for rank, parent in parents.items():
            below.setdefault(parent if parent in parents else "", []).append(rank)
        chain, left = [], sorted(below.get("", []), reverse=True)
        while left:
            chain.append(left.pop())
            left += sorted(below.get(chain[-1], []), reverse=True)
        out[key] = chain
    return out


def table(spark: SparkSession, ranks: Iterable[Rank] | None = None) -> DataFrame:
    """The ranks as rows (``RANK``); ``position`` is the place in the group's chain."""
    ranks = fixed() if ranks is None else list(ranks)
    if len(ranks) > MOST_RANKS or len({(r.code, r.rank) for r in ranks}) < len(ranks) or {r.group for r in ranks} - set(GROUPS):
        raise NoRankTable(f"each code and rank once, at most {MOST_RANKS}, of the groups {', '.join(GROUPS)}")
    place = {(code, rank): n for (code, _), chain in chains(ranks).items() for n, rank in enumerate(chain)}
    return spark.createDataFrame([(r.code, r.rank, GROUPS.index(r.group), place.get((r.code, r.rank), -1), list(r.only_under), r.typical) for r in ranks], RANK)


def allowed(ranks: DataFrame) -> DataFrame:
    """(code, parent_rank, child_rank, typical): what may stand below a rank; below the empty rank every rank of the code may.

    A child's group is the parent's or the next one, in the same group its place is a
    later one; a rank that names its parents stands under these alone, though never
    under one of a lower group or a later place.
    """
    p, c = ranks.alias("p"), ranks.alias("c")
    later = (F.col("c.group") > F.col("p.group")) | ((F.col("c.group") == F.col("p.group")) & (F.col("c.position") > F.col("p.position")))
    named = F.when(F.size("c.only_under") > 0, F.array_contains("c.only_under", F.col("p.rank"))).otherwise(F.col("c.group") - F.col("p.group") <= 1)
    below = p.join(c, (F.col("p.code") == F.col("c.code")) & later & named).select(F.col("p.code").alias("code"), F.col("p.rank").alias("parent_rank"), F.col("c.rank").alias("child_rank"), F.col("c.typical").alias("typical"))
    return below.unionByName(ranks.select("code", F.lit("").alias("parent_rank"), F.col("rank").alias("child_rank"), "typical"))


def _by_code(ranks: DataFrame) -> DataFrame:
    """One row a code: its ranks, each with what may stand below it, sorted by name."""
    lists = ranks.select("code", F.col("rank").alias("parent_rank")).unionByName(ranks.select("code", F.lit("").alias("parent_rank")).distinct())
    found = allowed(ranks).groupBy("code", "parent_rank").agg(F.sort_array(F.collect_list(F.struct("child_rank", "typical"))).alias("children"))
    none = F.array().cast("array<struct<child_rank:string,typical:boolean>>")
    whole = lists.join(found, ["code", "parent_rank"], "left").select("code", F.struct("parent_rank", F.coalesce("children", none).alias("children")).alias("e"))
    return whole.groupBy(F.col("code").alias("_code")).agg(F.map_from_entries(F.collect_list("e")).alias("_below"))


def with_child_ranks(parents: DataFrame, code: Column, rank: Column, ranks: DataFrame) -> DataFrame:
    """``child_ranks`` (child_rank, typical; sorted by name) for each parent.

    Null, which is no restriction, where the code has no ranks.  A rank that its code
    doesn't have counts without the suffix of another code's name; if that is unknown
    too, or empty, every rank of the code may follow.
    """
    joined = parents.withColumn("_of", text(code)).withColumn("_rank", text(rank)).join(F.broadcast(_by_code(ranks)), F.col("_of") == F.col("_code"), "left")
    below = lambda key: F.try_element_at("_below", key)
    found = F.coalesce(below(F.col("_rank")), below(bare_rank(F.col("_rank"))), below(F.lit("")))
    return joined.withColumn("child_ranks", found).drop("_of", "_rank", "_code", "_below")


def flags(ranks: DataFrame) -> DataFrame:
    """(rank, genus_group, infraspecific) as the ranks' groups tell them, over all codes."""
    species = F.max(F.when(F.col("rank") == "SPECIES", F.col("position"))).over(Window.partitionBy("code"))
    of_species = F.col("group") == GROUPS.index("species")
    rows = ranks.select("rank", (F.col("group") == GROUPS.index("genus")).alias("g"), F.coalesce(of_species & (F.col("position") > species), F.lit(False)).alias("s"))
    return rows.groupBy("rank").agg(F.bool_or("g").alias("genus_group"), F.bool_or("s").alias("infraspecific"))


def new_children(taxon: DataFrame, name: DataFrame, ranks: DataFrame, rank_flags: DataFrame | None = None) -> DataFrame:
    """What a new child of each taxon starts from: (id, code, rank, child_ranks, prefix).

    The prefix is the parent's name and a blank under ranks of the genus group, species
    and what is below them, else empty: the canonical name, else the simple one, else the
    scientific name.  A taxon without a name has an empty code and rank and no restriction.
    """
    some = {"rank_id", "code_id", "canonical_full", "canonical_simple", "scientific_name"}
    have = [F.col(c) if c in name.columns else F.lit("").alias(c) for c in sorted(some)]
    joined = taxon.select("id", F.col("name_id").alias("_name")).join(name.select(F.col("id").alias("_name"), *have), "_name", "left")
    marked = (flags(ranks) if rank_flags is None else rank_flags).select(F.col("rank").alias("rank_id"), "genus_group", "infraspecific")
    joined = joined.join(marked, "rank_id", "left")  # small; broadcast by Spark's own check of its size
    starts = F.coalesce("genus_group", F.lit(False)) | F.coalesce("infraspecific", F.lit(False)) | text(F.col("rank_id")).isin(OF_SPECIES)
    own = F.coalesce(*[F.when(~empty(F.col(c)), F.col(c)) for c in ("canonical_full", "canonical_simple", "scientific_name")], F.lit(""))
    prefix = F.when(starts & (own != ""), F.concat(own, F.lit(" "))).otherwise("")
    rows = joined.select("id", text(F.col("code_id")).alias("code"), text(F.col("rank_id")).alias("rank"), prefix.alias("prefix"))
    return with_child_ranks(rows, F.col("code"), F.col("rank"), ranks)
