"""Scalar functions as Column expressions: labels, dates, check digits, ranks, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
#: Ranks whose names are set in italics: the genus group, sections and series, species and what is below them.
ITALIC_RANKS = [
    "SUPERGENUS", "GENUS", "SUBGENUS", "INFRAGENUS", "INFRAGENERIC_NAME", "SUPERSECTION_BOTANY", "SECTION_BOTANY", "SUBSECTION_BOTANY", "SUPERSERIES", "SERIES", "SUBSERIES",
    "SPECIES_AGGREGATE", "SPECIES", "SUBSPECIES", "INFRASPECIFIC_NAME", "INFRASUBSPECIFIC_NAME", "SUPERVARIETY", "VARIETY", "SUBVARIETY", "SUPERFORM", "FORM", "SUBFORM",
    "NATIO", "ABERRATION", "LUSUS", "PROLES", "MORPH", "KLEPTON", "GREX", "MUTATIO", "CONVARIETY",
    "STRAIN", "PATHOVAR", "BIOVAR", "CHEMOVAR", "MORPHOVAR", "PHAGOVAR", "SEROVAR", "CHEMOFORM", "FORMA_SPECIALIS",
]
_BOTANICAL_SUFFIXES = [("oideae", "SUBFAMILY"), ("aceae", "FAMILY"), ("phyta", "PHYLUM"), ("opsida", "CLASS"), ("ales", "ORDER"), ("inae", "SUBTRIBE"), ("eae", "TRIBE")]
#: Ranks by suffix of a name's last word, per nomenclatural code, first match wins.
SUFFIX_RANKS = {
    "ZOOLOGICAL": [("oidea", "SUPERFAMILY"), ("idae", "FAMILY"), ("inae", "SUBFAMILY"), ("ini", "TRIBE"), ("ina", "SUBTRIBE")],
    "BOTANICAL": _BOTANICAL_SUFFIXES,
    "PHYTOSOCIOLOGICAL": _BOTANICAL_SUFFIXES,
    "BACTERIAL": [("aceae", "FAMILY"), ("oideae", "SUBFAMILY"), ("ales", "ORDER"), ("eae", "TRIBE")],
    "VIRUS": [("virales", "ORDER"), ("viridae", "FAMILY"), ("virinae", "SUBFAMILY"), ("virus", "GENUS")],
}
#: Ranks by marker between the words of a name.
MARKER_RANKS = {
    "sp.": "SPECIES", "subsp.": "SUBSPECIES", "ssp.": "SUBSPECIES", "var.": "VARIETY", "subvar.": "SUBVARIETY", "f.": "FORM", "forma": "FORM", "subf.": "SUBFORM", "cv.": "CULTIVAR",
    "sect.": "SECTION_BOTANY", "subsect.": "SUBSECTION_BOTANY", "ser.": "SERIES", "subgen.": "SUBGENUS", "grex": "GREX", "morph": "MORPH", "prol.": "PROLES", "proles": "PROLES", "aberr.": "ABERRATION", "ab.": "ABERRATION",
}
SEVERITIES = {"debug": 0, "info": 1, "warn": 2, "error": 3}
DOI = r"^(?:https?://(?:dx\.)?doi\.org/)?(?:urn:)?(?:doi:)?10\.[0-9]+(?:\.[0-9]+)*/.+$"
EMAIL = r"^[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"


def text(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c, F.lit(""))


def empty(c: Column) -> Column:
    return text(c) == ""


def display_name(full: Column, simple: Column, scientific: Column) -> Column:
    return F.coalesce(F.nullif(full, F.lit("")), F.nullif(simple, F.lit("")), scientific, F.lit(""))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def label(canonical: Column, authorship: Column, rank: Column, extinct: Column) -> tuple[Column, Column]:
    """Plain and HTML label of a name: dagger, canonical (italic by rank), authorship."""
    dagger = F.when(extinct, "†").otherwise("")
    after = F.when(empty(authorship), "").otherwise(F.concat(F.lit(" "), authorship))
    safe = escape_html(canonical)
    shown = F.when(rank.isin(ITALIC_RANKS), F.concat(F.lit("<i>"), safe, F.lit("</i>"))).otherwise(safe)
    return F.concat(dagger, canonical, after), F.concat(dagger, shown, escape_html(after))


def year_of(issued: Column) -> Column:
    """The leading four digits of a partial date, else empty."""
    return F.regexp_extract(text(issued), r"^(\d{4})", 1)


def first_of_list(csv: Column) -> Column:
    return F.trim(F.get(F.split(text(csv), ","), F.lit(0)))


def reference_label(author: Column, issued: Column, title: Column, citation: Column, id_: Column) -> Column:
    """Author (Year) Title; the citation or the id where these are missing."""
    year = year_of(issued)
    made = F.concat_ws(" ", F.nullif(author, F.lit("")), F.when(year != "", F.concat(F.lit("("), year, F.lit(")"))), F.nullif(title, F.lit("")))
    return F.coalesce(F.nullif(made, F.lit("")), F.nullif(citation, F.lit("")), id_)


def vocabulary_name(id_: Column) -> Column:
    return F.lower(F.replace(id_, F.lit("_"), F.lit(" ")))


def severity_rank(severity: Column) -> Column:
    out = F.lit(-1)
    for name, rank in SEVERITIES.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    out = F.lit("")
    for name, number in SEVERITIES.items():
        out = F.when(rank == number, name).otherwise(out)
    return out


def _digits(c: Column, x_last: bool) -> Column:
    """Digits as an array of int; a final X counts ten."""
    raw = F.filter(F.split(F.upper(c), ""), lambda d: d.rlike("^[0-9X]$" if x_last else "^[0-9]$"))
    return F.transform(raw, lambda d: F.when(d == "X", 10).otherwise(F.try_to_number(d, F.lit("9")).cast("int")))


def _weighted(digits: Column, weight) -> Column:
    return F.aggregate(F.transform(digits, lambda d, i: d * weight(i)), F.lit(0), lambda a, b: a + b)


def isbn10_ok(c: Column) -> Column:
    return c.rlike("^[0-9]{9}[0-9Xx]$") & (_weighted(_digits(c, True), lambda i: 10 - i) % 11 == 0)


def isbn13_ok(c: Column) -> Column:
    return c.rlike("^[0-9]{13}$") & (_weighted(_digits(c, False), lambda i: 1 + 2 * (i % 2)) % 10 == 0)


def issn_ok(c: Column) -> Column:
    plain = F.replace(c, F.lit("-"), F.lit(""))
    return plain.rlike("^[0-9]{7}[0-9Xx]$") & (_weighted(_digits(plain, True), lambda i: 8 - i) % 11 == 0)


def orcid_ok(c: Column) -> Column:
    """ISO 7064 MOD 11-2 over sixteen characters, with or without the address before them."""
    plain = F.regexp_replace(F.regexp_replace(c, "^https?://orcid.org/", ""), "-", "")
    total = F.aggregate(F.slice(_digits(plain, True), 1, 15), F.lit(0), lambda a, d: (a + d) * 2 % 11)
    check = (12 - total) % 11
    return plain.rlike("^[0-9]{15}[0-9Xx]$") & (check == F.element_at(_digits(plain, True), -1))


def luhn_ok(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def guess_rank(code: Column, name: Column) -> Column:
    """Rank by the last marker after the first word, else by the suffix of the last word under the code, else by the number of words; empty if nothing tells it."""
    words = F.filter(F.split(F.lower(text(name)), " "), lambda w: w != "")
    marker = F.try_element_at(F.filter(words, lambda w, n: (n > 0) & w.isin(list(MARKER_RANKS))), F.lit(-1))
    last, count = text(F.try_element_at(words, F.lit(-1))), F.size(words)
    out = F.when(count == 1, "GENUS").when(count == 2, "SPECIES").when(count == 3, "SUBSPECIES").otherwise("")
    for c, rules in SUFFIX_RANKS.items():
        for suffix, rank in reversed(rules):
            out = F.when((code == c) & last.endswith(suffix), rank).otherwise(out)
    by_marker = F.create_map(*[F.lit(x) for pair in MARKER_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(by_marker, marker), out)


def backfill_years(own: Column, basionym: Column, parenthetical: Column) -> tuple[Column, Column]:
    """Basionym and combination year that fill empty fields: a recombination needs both years, in order."""
    both = (year_of(own) != "") & (year_of(basionym) != "") & (year_of(basionym) < year_of(own))
    return F.when(both, year_of(basionym)).otherwise(""), F.when(both | (~parenthetical & (year_of(basionym) == "")), year_of(own)).otherwise("")
