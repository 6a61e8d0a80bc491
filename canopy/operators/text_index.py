"""A stored inverted index: searches read the postings of their own terms, edits are added as small parts.

Below the index's folder are parts and a log.  The texts of a part are numbered in
segments, runs of texts that one task counts at once, so that no word is shuffled.  A
part has a row for each term of a segment (term, segment, places of the texts, tfs), in
one folder for each first character and sorted by term in each file, so that a search
opens the folders of its terms and skips row groups; and, in the folder without a
character, a row for each text (segment, place, id, length, alive).  A log entry is a
whole state: the parts in order, and how many texts of what length the index holds,
which every batch of edits changes by its difference.  A text counts as its last part
has it; ``merge`` makes one part of all, whose segments keep their texts' places.

An entry is published as a whole or not at all, readers of older entries go on, and of
two writers the second takes the first one's entry into account.  Rows of a failed
attempt are never read.  Texts are told by any type of id, structs too; null ids and
null texts aren't indexed, a null text in a batch deletes, and of several texts of one
id in a batch the least is taken.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from canopy.operators import search as S
from canopy.sources import shared

UNITS = {"words": S.tokens, "grams": S.all_trigrams}
#: Terms that are counted at once, unless a single text has more.
SEGMENT = 4_000_000
#: Of the parts: an index of another form is built anew beside it.
FORM = "segments"
#: Of a term, and of a text.
POSTING, TEXT = ["term", "segment", "places", "tfs"], ["segment", "place", "id", "length", "alive"]


class Superseded(RuntimeError):
    """Parts that were being merged are no longer the first ones of the index."""


def _schema(kind: str) -> str:
    return f"term string, segment bigint, places array<int>, tfs array<int>, place int, id {kind}, length bigint, alive boolean"


def _rows(n: int, columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _segment(ids: pa.Array, terms: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a run of texts, each a list of terms (null: deleted): of the texts, and of the terms."""
    n, number = len(ids), pa.scalar(uuid.uuid4().int >> 65, pa.int64())
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = {"place": pa.array(np.arange(n, dtype=np.int32)), "id": ids, "length": pa.array(sizes), "alive": terms.is_valid()}
    yield _rows(n, texts | {"segment": pa.repeat(number, n)}, schema)
    coded = terms.flatten().dictionary_encode()
    keys = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), sizes)
    keys, tfs = np.unique(keys, return_counts=True)
    words = len(coded.dictionary)
    ends = pa.array(np.searchsorted(keys, np.arange(words + 1, dtype=np.int64) * n).astype(np.int32))
    lists = {"places": pa.ListArray.from_arrays(ends, pa.array((keys % n).astype(np.int32))), "tfs": pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32)))}
    yield _rows(words, lists | {"term": coded.dictionary, "segment": pa.repeat(number, words)}, schema)


def _segments(schema: pa.Schema):
    """Counts the terms of texts (id, terms) as they come, ``SEGMENT`` of them at once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
            runs = np.cumsum(sizes, dtype=np.int64) // SEGMENT
            cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(ids)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    yield from _segment(ids.slice(low, high - low), terms.slice(low, high - low), schema)

    return count


def _kept(postings: pa.Table, live: pa.Table) -> pa.Table:
    """The postings of a segment, only of the texts at the live places."""
    if not postings.num_rows or not live.num_rows:
        return postings.slice(0, 0)
    postings = postings.combine_chunks()
    places, tfs = (postings.column(c).combine_chunks() for c in ("places", "tfs"))
    at = places.flatten().to_numpy()
    alive = np.zeros(at.max() + 1, dtype=bool)
    known = live.column("place").to_numpy()
    alive[known[known < len(alive)]] = True
    keep = alive[at]
    before = np.concatenate([[0], np.cumsum(keep)])
    ends = before[np.concatenate([[0], np.cumsum(pc.list_value_length(places).to_numpy())])].astype(np.int32)
    cut = lambda lists: pa.ListArray.from_arrays(pa.array(ends), lists.flatten().filter(pa.array(keep)))
    some = pa.table([postings.column("term"), postings.column("segment"), cut(places), cut(tfs)], schema=postings.schema)
    return some.filter(pa.array(np.diff(ends) > 0))


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ---- states -------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in shared.names(self.spark, f"{self.folder}/log") if n.endswith(".json")]

    def state(self, version: int | None = None) -> dict:
        """The entry of a version, of the newest one if none is named."""
        version = self.versions()[-1] if version is None else version
        return {"version": version} | json.loads(shared.read(self.spark, f"{self.folder}/log/{version:012d}.json"))

    def _publish(self, state: dict) -> bool:
        kept = {k: v for k, v in state.items() if k != "version"}
        return shared.create(self.spark, f"{self.folder}/log/{state['version']:012d}.json", json.dumps(kept))

    # ---- parts --------------------------------------------------------------

    def _write(self, texts: DataFrame, unit: str) -> str:
        """A part of rows (id, text), null texts as deleted."""
        name = uuid.uuid4().hex
        terms = texts.select("id", UNITS[unit](F.col("text")).alias("terms"))
        schema = StructType.fromDDL(_schema(terms.schema["id"].dataType.simpleString()))
        self._store(terms.mapInArrow(_segments(to_arrow_schema(schema)), schema), name)
        return name

    def _store(self, rows: DataFrame, name: str) -> None:
        placed = rows.withColumn("lead", F.substring("term", 1, 1)).sortWithinPartitions("lead", "term")
        placed.write.partitionBy("lead").parquet(f"{self.folder}/part-{name}")

    def _part(self, part: dict) -> DataFrame:
        return self.spark.read.schema(f"{_schema(part['id'])}, lead string").parquet(f"{self.folder}/part-{part['name']}")

    def _postings(self, parts: list[dict], wanted: Column, leads: list[str] | None = None) -> DataFrame:
        """Rows (term, segment, places, tfs), of texts that may have changed since too."""
        one = lambda p: self._part(p).where(F.col("lead").isNotNull() if leads is None else F.col("lead").isin(leads)).where(wanted).select(*POSTING)
        return reduce(DataFrame.unionByName, map(one, parts))

    def _texts(self, parts: list[dict]) -> DataFrame:
        one = lambda p: self._part(p).where("lead is null").select(*TEXT).withColumn("batch", F.lit(p["batch"]))
        return reduce(DataFrame.unionByName, map(one, parts))

    def _live(self, state: dict) -> DataFrame:
        """Texts (segment, place, id, length, alive) that count now."""
        rows = self._texts(state["parts"]).where("alive")
        if len(state["parts"]) > 1:
            last = self._texts(state["parts"][1:]).groupBy(F.col("id").alias("_id")).agg(F.max("batch").alias("_batch"))
            rows = rows.join(last, F.col("id") == F.col("_id"), "left").where("_batch is null or _batch = batch")
        return rows.select(*TEXT)

    # ---- writing ------------------------------------------------------------

    @classmethod
    def build(cls, spark: SparkSession, folder: str, docs: DataFrame, id_col: str, text: Column, unit: str = "words") -> TextIndex:
        """A new index of all rows with an id and a text; one that is there already is left as it is."""
        index = cls(spark, folder)
        rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).where("id is not null and text is not null")
        kind = rows.schema["id"].dataType.simpleString()
        name = index._write(rows, unit)
        part = {"name": name, "batch": 0, "id": kind}
        n, length = index._texts([part]).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        index._publish({"version": 0, "unit": unit, "parts": [part], "texts": n, "length": length, "streams": {}})
        return index

    @classmethod
    def stored(cls, spark: SparkSession, name: str, docs: DataFrame, id_col: str, text: Column, unit: str = "words") -> TextIndex:
        """The index of that name over these very files in the shared folder; it is built if there is none, or if a file has changed."""
        facts = [(f, *shared.stamp(spark, f)) for f in sorted(docs.inputFiles())]
        key = hashlib.sha256(json.dumps([name, facts, unit, FORM]).encode()).hexdigest()[:32]
        index = cls(spark, f"{shared.base(spark).rstrip('/')}/index-{name}-{key}")
        return index if index.versions() else cls.build(spark, index.folder, docs, id_col, text, unit)

    def apply(self, changes: DataFrame, stream: str | None = None, number: int = 0) -> bool:
        """Add a batch (id, text); a null text deletes.

        A batch of a ``stream`` counts once: False, and nothing is changed, if one of its number or a later one was added.
        """
        state = self.state()
        done = lambda s: stream is not None and s["streams"].get(stream, -1) >= number
        if done(state):
            return False
        rows = changes.where("id is not null").groupBy("id").agg(F.min("text").alias("text"))
        name = self._write(rows, state["unit"])
        while not done(state):
            part = {"name": name, "batch": state["parts"][-1]["batch"] + 1, "id": state["parts"][0]["id"]}
            new = self._texts([part]).select("id", F.col("length").alias("new_length"), F.col("alive").alias("new_alive"))
            old = self._texts(state["parts"]).join(new.select("id"), "id", "left_semi").groupBy("id").agg(F.max_by(F.struct("length", "alive"), "batch").alias("old"))
            both = new.join(old, "id", "left").agg(
                F.count_if("new_alive") - F.count_if("old.alive"),
                F.coalesce(F.sum("new_length"), F.lit(0)) - F.coalesce(F.sum("old.length"), F.lit(0)),
            )
            n, length = both.first()
            streams = state["streams"] | ({stream: number} if stream is not None else {})
            if self._publish(state | {"version": state["version"] + 1, "parts": [*state["parts"], part], "texts": state["texts"] + n, "length": state["length"] + length, "streams": streams}):
                return True
            state = self.state()  # another writer was first
        return False

    def merge(self) -> None:
        """One part instead of all that are there now; batches that are added meanwhile stay behind it."""
        state = self.state()
        merged = state["parts"]
        if len(merged) == 1:
            return
        name = uuid.uuid4().hex
        live, postings = self._live(state), self._postings(merged, F.lit(True))
        kept = postings.groupBy("segment").cogroup(live.select("segment", "place").groupBy("segment")).applyInArrow(_kept, postings.schema)
        self._store(kept.unionByName(live, allowMissingColumns=True), name)
        part = {"name": name, "batch": merged[-1]["batch"], "id": merged[0]["id"]}
        while state["parts"][: len(merged)] == merged:
            if self._publish(state | {"version": state["version"] + 1, "parts": [part, *state["parts"][len(merged) :]]}):
                return
            state = self.state()
        raise Superseded(self.folder)

    # ---- reading ------------------------------------------------------------

    def hits(self, terms: list[str], state: dict | None = None) -> DataFrame:
        """Rows (prefix, id, tf, length) of texts with a word that starts with one of the terms, or with one of the trigrams."""
        state = state or self.state()
        some = [t.lower() for t in dict.fromkeys(terms)]
        fits = (lambda t: F.col("term").startswith(t)) if state["unit"] == "words" else (lambda t: F.col("term") == t)
        wanted = reduce(lambda a, b: a | b, (fits(t) for t in some), F.lit(False))
        rows = self._postings(state["parts"], wanted, sorted({t[:1] for t in some}))
        found = F.filter(F.array(*map(F.lit, some)), lambda p: F.col("term").startswith(p))
        spread = rows.select(F.explode(found).alias("prefix"), "segment", "places", "tfs").select("prefix", "segment", F.explode(F.arrays_zip("places", "tfs")).alias("x"))
        spread = spread.select("prefix", "segment", F.col("x.places").alias("place"), F.col("x.tfs").cast("long").alias("tf")).join(self._live(state), ["segment", "place"])
        return spread.groupBy("prefix", "id").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))

    def bm25(self, terms: list[str], least: int | None = None) -> DataFrame:
        """(id, score) of texts with ``least`` of the terms or more (all, if None); numbers of the collection come from the log."""
        state = self.state()
        some = list(dict.fromkeys(t.lower() for t in terms))
        if not some:
            return self._texts(state["parts"][:1]).limit(0).select("id", F.lit(0.0).alias("score"))
        return S.bm25_score(self.hits(some, state), F.lit(state["texts"]), F.lit(state["length"] / max(1, state["texts"])), len(some) if least is None else least)

    def search_grams(self, query: str) -> DataFrame:
        """(id, score) of texts that share a trigram with the query, of an index of trigrams."""
        return self.bm25(S.grams_of(query), least=1)

