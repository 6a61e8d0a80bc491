"""Delta-maintained token counts by source, language and tokenizer version.

A batch of changes (inserts, deletes, revised counts) becomes signed sums per
key, written to a folder of its own attempt.  A manifest names the folders that
count; it is published as the next of a row of numbered files that are only ever
created, so readers see all of a batch or nothing of it, a failed attempt leaves
no trace in the totals, and of two writers the later one builds on the earlier.

A batch that is committed again replaces its sums.  ``compact`` merges all
batches to one folder and keeps their names: such a batch is sealed, and sent
again it is refused.

Null texts count no tokens; null sources and languages are keys of their own.
Keys whose documents and tokens all went are left out of the totals.  Columns
that aren't named here are ignored.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.bpe import encode_texts, memory
from canopy.llm.common import blank_null, chunks, cut, release, shared_dir, table
from canopy.sources import shared

KEYS = ["source", "lang", "tokenizer"]
_SUMS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
#: Version names of the query's counts: ordinary tokens of the ranks in the file of that name.
VERSION = "byte_bpe_50k"
#: Seconds that a manifest may take from its creation to its content.
PATIENCE = 10


class TokenRollup:
    """Signed sums of every committed batch below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @staticmethod
    def _signed(rows: DataFrame, docs: Column, tokens: Column) -> DataFrame:
        times = F.col("docs") if "docs" in rows.columns else F.lit(1)
        return rows.select(*KEYS, (docs * times).cast("long").alias("docs"), (tokens * times).cast("long").alias("tokens"))

    @classmethod
    def inserts(cls, rows: DataFrame) -> DataFrame:
        """Signed rows of new documents (keys, n_tokens; ``docs``, if there, tells how many such documents)."""
        return cls._signed(rows, F.lit(1), F.col("n_tokens"))

    @classmethod
    def deletes(cls, rows: DataFrame) -> DataFrame:
        return cls._signed(rows, F.lit(-1), -F.col("n_tokens"))

    @classmethod
    def revisions(cls, rows: DataFrame) -> DataFrame:
        """Signed rows of documents whose count changed (keys, old_tokens, n_tokens)."""
        return cls._signed(rows, F.lit(0), F.col("n_tokens") - F.col("old_tokens"))

    def _state(self) -> tuple[int, dict]:
        """Number and content of the newest manifest."""
        found = shared.names(self.spark, f"{self.folder}/manifest")
        numbers = [int(n.removesuffix(".json")) for n in found if n.endswith(".json")]
        if not numbers:
            return 0, {"base": None, "sealed": [], "batches": {}}
        until = time.monotonic() + PATIENCE
        while True:
            text = shared.read(self.spark, f"{self.folder}/manifest/{max(numbers):09d}.json")
            if text:
                return max(numbers), json.loads(text)
            if time.monotonic() > until:
                raise RuntimeError(f"manifest {max(numbers)} was begun and not written")
            time.sleep(0.2)

    def _publish(self, number: int, state: dict) -> bool:
        return shared.create(self.spark, f"{self.folder}/manifest/{number:09d}.json", json.dumps(state))

    def _write(self, signed: DataFrame) -> str:
        name = f"sums-{uuid.uuid4().hex}"
        sums = signed.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("n_docs"), F.sum("tokens").cast("long").alias("n_tokens"))
        sums.write.parquet(f"{self.folder}/{name}")
        return name

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Make the batch's sums count once; False, and nothing is changed, if the batch is sealed."""
        if batch in self._state()[1]["sealed"]:
            return False
        signed = changes[0]
        for more in changes[1:]:
            signed = signed.unionByName(more)
        name = self._write(signed)
        while True:
            number, state = self._state()
            if batch in state["sealed"]:
                return False
            state["batches"][batch] = name
            if self._publish(number + 1, state):
                return True

    def _sums(self, state: dict) -> DataFrame:
        folders = [f for f in [state["base"], *state["batches"].values()] if f]
        if not folders:
            return self.spark.createDataFrame([], _SUMS)
        return self.spark.read.schema(_SUMS).parquet(*[f"{self.folder}/{f}" for f in folders])

    def totals(self) -> DataFrame:
        added = self._sums(self._state()[1]).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return added.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """All batches as one folder of sums, and their names sealed."""
        while True:
            number, state = self._state()
            rows = self._sums(state).select(*KEYS, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens"))
            merged = {"base": self._write(rows), "sealed": sorted({*state["sealed"], *state["batches"]}), "batches": {}}
            if self._publish(number + 1, merged):
                return


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as a ledger: source, lang, digest of the text, its tokens, and those of the text without white space at its ends.

    ``path`` is a file of merge ranks; the plan is a scan and one Arrow map.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            count = np.diff(encode_texts(part.column("text"), memory(path))[1])
            bare = pc.utf8_trim_whitespace(part.column("text"))
            other = np.flatnonzero(pc.not_equal(bare, part.column("text")).to_numpy(zero_copy_only=False))
            stripped = count.copy()
            if len(other):
                stripped[other] = np.diff(encode_texts(bare.take(pa.array(other)), memory(path))[1])
            yield pa.record_batch([*(part.column(c) for c in ("source", "lang", "digest")), pa.array(count), pa.array(stripped)], names)
        release()

    names = ["source", "lang", "digest", "n_tokens", "n_stripped"]
    text = blank_null(text_col)
    rows = docs.select("source", "lang", F.sha2(text, 256).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, "source string, lang string, digest string, n_tokens bigint, n_stripped bigint")


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, counts are revised to texts without white space at their ends, exact copies go.

    All counts come from one ledger, written as the documents are tokenised.
    The revision is sent twice, and again after the batches were compacted.  Of
    equal texts one document stays, that of the least source and language (nulls
    first), whatever its id.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counted = count_tokens(docs, public_tokenizers.path(f"{VERSION}.tiktoken"))
    # documents of equal text, source and language are one line of the ledger
    ledger = cut(counted.groupBy("source", "lang", "digest", "n_tokens", "n_stripped").agg(F.count("*").alias("docs"))).withColumn("tokenizer", F.lit(VERSION))
    rollup = TokenRollup(spark, shared_dir(spark, "token-rollup"))
    rollup.commit("documents", rollup.inserts(ledger))
    changed = ledger.where("n_tokens <> n_stripped").withColumnsRenamed({"n_tokens": "old_tokens", "n_stripped": "n_tokens"})
    rollup.commit("stripped", rollup.revisions(changed))
    rollup.commit("stripped", rollup.revisions(changed))
    now = ledger.drop("n_tokens").withColumnRenamed("n_stripped", "n_tokens")
    kept = now.groupBy("digest").agg(F.min(F.struct("source", "lang")).alias("kept"))
    here = F.struct("source", "lang").eqNullSafe(F.col("kept"))
    gone = now.join(kept, "digest").withColumn("docs", F.col("docs") - here.cast("int")).where("docs > 0")
    rollup.commit("copies", rollup.deletes(gone))
    rollup.compact()
    rollup.commit("stripped", rollup.revisions(changed))
    return rollup.totals()
