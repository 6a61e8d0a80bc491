"""Record parsers: names and JSON records as Column expressions, BibTeX as a small vectorised helper."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[\p{L}][\p{L}\-.]*"
_AUTHORS = r"\p{Lu}[^()\d,]*"
#: Canonical words, then (original author, year) and author, year; what is left is the tail.
NAME = (
    r"^\s*(\p{Lu}[\p{L}\-]+(?: \(\p{Lu}[\p{L}\-]+\))?(?: (?:subsp\.|ssp\.|var\.|subvar\.|f\.|subf\.|[\p{Ll}][\p{Ll}\-]+)){0,4})"
    rf"(?: \(({_AUTHORS})(?:, ?(\d{{4}}))?\))?(?: ({_AUTHORS}))?(?:,? ?(\d{{4}}))?(.*)$"
)
MARKERS = ["subsp.", "ssp.", "var.", "subvar.", "f.", "subf."]
#: Entry types of BibTeX and the reference types that they stand for.
BIBTEX_TYPES = {"article": "ARTICLE", "book": "BOOK", "inbook": "CHAPTER", "incollection": "CHAPTER", "inproceedings": "PAPER", "phdthesis": "THESIS", "mastersthesis": "THESIS", "techreport": "REPORT"}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def parse_name(name: Column) -> Column:
    """A struct of a scientific name's parts; quality 1 is clean, 2 has an unparsed tail, 0 isn't a name.

    A reduced grammar: one to three epithets with rank markers, a subgenus, and
    the authorship with years.  Other forms have a tail or aren't parsed.
    """
    part = lambda k: F.trim(F.regexp_extract(name, NAME, k))
    full = part(1)
    words = F.filter(F.split(F.regexp_replace(full, r" \([^)]*\)", ""), " "), lambda w: ~w.isin(MARKERS))
    simple = F.array_join(words, " ")
    marker = F.coalesce(F.get(F.filter(F.split(full, " "), lambda w: w.isin(MARKERS)), F.lit(0)), F.lit(""))
    tail = part(6)
    quality = F.when(full == "", 0).when(tail != "", 2).otherwise(1)
    return F.struct(
        simple.alias("canonical_simple"),
        full.alias("canonical_full"),
        F.when(full == "", 0).otherwise(F.size(words)).alias("cardinality"),
        marker.alias("marker"),
        part(2).alias("basionym_authorship"),
        part(3).alias("basionym_year"),
        part(4).alias("combination_authorship"),
        part(5).alias("combination_year"),
        tail.alias("tail"),
        quality.alias("quality"),
    )


WORK = "title string, doi string, publication_date string, publication_year int, type string, authorships array<struct<raw_author_name:string>>, primary_location struct<source:struct<display_name:string>>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>"


def reference_of_work(json: Column) -> Column:
    """A reference (struct) from the JSON record of a bibliographic work; a broken record has nulls only."""
    w = F.from_json(json, WORK)
    pages = F.concat_ws("–", w.biblio.first_page, F.when(w.biblio.last_page != w.biblio.first_page, w.biblio.last_page))
    return F.struct(
        F.array_join(F.transform(w.authorships, lambda a: a["raw_author_name"]), "; ").alias("author"),
        w.title.alias("title"),
        F.coalesce(w.publication_date, w.publication_year.cast("string")).alias("issued"),
        w.primary_location.source.display_name.alias("container"),
        w.biblio.volume.alias("volume"),
        w.biblio.issue.alias("issue"),
        pages.alias("page"),
        F.regexp_replace(w.doi, "^https?://(dx\\.)?doi\\.org/", "").alias("doi"),
        F.upper(F.regexp_replace(w.type, "-", "_")).alias("type"),
    )


HIT = "part struct<id:int,pages:string>, item struct<id:int,title:string>, year int, annotation string"


def hit_of_record(json: Column, part_url: str, item_url: str) -> Column:
    """A link (struct) from the JSON record of a digitised text: to the part if there is one, else to the item."""
    r = F.from_json(json, HIT)
    link = F.when(r.part.id > 0, F.concat(F.lit(part_url), r.part.id)).when(r["item"].id > 0, F.concat(F.lit(item_url), r["item"].id)).otherwise("")
    return F.struct(link.alias("link"), F.coalesce(r["item"].title, F.lit("")).alias("title"), r.year.alias("year"), F.coalesce(r.part.pages, F.lit("")).alias("pages"))


_FIELDS = "type string, key string, title string, author string, container string, issued string, volume string, page string, doi string"
_ENTRY = re.compile(r"@\s*(\w+)\s*\{\s*([^,\s]*)\s*,")
_NAME_OF = re.compile(r"\s*,?\s*([\w-]+)\s*=\s*")


def _value(text: str, at: int) -> tuple[str, int]:
    """One value in braces (with inner braces), in quotes, or bare, and where it ends."""
    opener = text[at : at + 1]
    if opener not in ("{", '"'):
        end = min([text.find(c, at) for c in ",}\n" if text.find(c, at) >= 0] or [len(text)])
        return text[at:end], end
    depth, start = 0, at + 1
    for at in range(start, len(text)):
        c = text[at]
        if depth == 0 and c == ("}" if opener == "{" else '"'):
            return text[start:at], at + 1
        depth += (c == "{") - (c == "}")
    return text[start:], len(text)


def bibtex_entry(text: str | None) -> dict:
    """The first entry of a BibTeX text as a reference; missing fields are empty."""
    out = dict.fromkeys(("type", "key", "title", "author", "container", "issued", "volume", "page", "doi"), "")
    found = _ENTRY.search(text or "")
    if not found:
        return out
    fields, at = {}, found.end()
    while name := _NAME_OF.match(text, at):
        raw, at = _value(text, name.end())
        fields[name[1].lower()] = " ".join(re.sub(r"\\[&%$#_]", lambda m: m[0][1], re.sub(r"[{}]", "", raw)).replace("~", " ").split())
    month = fields.get("month", "")[:3].lower()
    number = MONTHS.index(month) + 1 if month in MONTHS else int(month) if month.isdigit() else 0
    year = fields.get("year", "")
    return {
        "type": BIBTEX_TYPES.get(found[1].lower(), "OTHER"),
        "key": found[2],
        "title": fields.get("title", ""),
        "author": "; ".join(fields.get("author", "").split(" and ")),
        "container": fields.get("journal", fields.get("booktitle", "")),
        "issued": f"{year}-{number:02d}" if year and number else year,
        "volume": fields.get("volume", ""),
        "page": fields.get("pages", "").replace("--", "–"),
        "doi": re.sub(r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "", fields.get("doi", ""), flags=re.I),
    }


def parse_bibtex(text: Column) -> Column:
    """A reference (struct) from the first BibTeX entry of each text."""

    @F.pandas_udf(_FIELDS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bibtex_entry(t) for t in texts], columns=["type", "key", "title", "author", "container", "issued", "volume", "page", "doi"])

    return run(text)
