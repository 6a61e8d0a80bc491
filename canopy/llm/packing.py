"""Cost-balanced packing of tokenised documents into training sequences.

A piece of ``n`` tokens costs ``LINEAR * n + QUADRATIC * n * n``.  Documents are
taken in descending length; each goes to the sequence of lowest cost so far that
has room for it.  What fits nowhere whole is cut over the emptiest sequences, so
that only the last sequence of a packing group is padded.

Packing happens where the documents are tokenised: one group is a bounded run of
a partition's documents, so nothing is shuffled and no group grows with the
input.  Sequence ids hold the partition, the group and the sequence; a task that
runs again gives the same rows.

Nulls and empty texts are a document of the end token alone.  The file's added
tokens are one id wherever a text spells them, as in the library.  Repeated rows are
packed once each.  Other columns, also of clashing names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm import library_tokens
from canopy.llm.bpe import packed
from canopy.llm.common import blank_null, chunks, release, table

CAPACITY = 2048
#: Cost per token, and per pair of tokens of one document.
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
END_ID = 1
#: Documents of a packing group, and the tokens that close a group earlier.
GROUP_DOCS, GROUP_TOKENS = 4096, 2_000_000


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group of document lengths.

    Every token lies in one piece, offsets have no gaps, and all sequences but
    one are full.  Ties go to the earlier document and the lower sequence.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    whole = sizes // capacity
    made = 0
    for doc in np.flatnonzero(whole):  # full sequences of long documents
        for k in range(int(whole[doc])):
            pieces.append((int(doc), k * capacity, capacity, made, 0))
            made += 1
    rest = sizes - whole * capacity
    total = int(rest.sum())
    if not total:
        return pieces
    n = -(-total // capacity)
    room = np.full(n, capacity, np.int64)
    room[-1] = total - (n - 1) * capacity  # the one that may end short
    used, cost = np.zeros(n, np.int64), np.zeros(n)
    late = []

    def put(doc: int, start: int, length: int, where: int) -> None:
        pieces.append((doc, start, length, made + where, int(used[where])))
        used[where] += length
        room[where] -= length
        cost[where] += LINEAR * length + QUADRATIC * length * length

    for doc in np.argsort(-rest, kind="stable"):
        length = int(rest[doc])
        if not length:
            break
        masked = np.where(room >= length, cost, np.inf)
        where = int(masked.argmin())
        if masked[where] == np.inf:
            late.append(int(doc))
        else:
            put(int(doc), int(whole[doc]) * capacity, length, where)
    for doc in late:
        start, left = int(whole[doc]) * capacity, int(rest[doc])
        while left:
            where = int(room.argmax())
            length = min(left, int(room[where]))
            put(doc, start, length, where)
            start, left = start + length, left - length
    return pieces


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset and ``ids`` (little-endian unsigned 32-bit)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def emit(group: list[tuple[object, np.ndarray]], first: int) -> tuple[pa.RecordBatch, int]:
        ids = [x[1] for x in group]
        pieces = pack(np.array([len(x) for x in ids], np.int64), capacity)
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces))
        parts = [ids[d][s : s + n] for d, s, n, _, _ in pieces]
        ends = np.concatenate([[0], np.cumsum(length)])
        tokens = np.array([len(x) for x in ids], np.int64)
        batch = pa.record_batch(
            [
                pa.array([group[d][0] for d in doc]),
                pa.array(start),
                pa.array(length),
                pa.array(tokens[doc]),
                pa.array(first + sequence),
                pa.array(offset),
                packed(np.concatenate(parts), ends),
            ],
            names,
        )
        return batch, first + int(sequence.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 32
        group: list[tuple[object, np.ndarray]] = []
        tokens = 0
        for part in chunks(batches, "text", 1 << 20):
            flat, ends = library_tokens.encode_texts(part.column("text"), path)
            for k, key in enumerate(part.column("id").to_pylist()):
                if group and (len(group) >= GROUP_DOCS or tokens >= GROUP_TOKENS):
                    batch, next_id = emit(group, next_id)
                    group, tokens = [], 0
                    yield batch
                group.append((key, np.append(flat[ends[k] : ends[k + 1]], np.int32(end_id))))
                tokens += len(group[-1][1])
        if group:
            yield emit(group, next_id)[0]
        group.clear()
        release()

    rows = docs.select(F.col(id_col).alias("id"), blank_null(text_col).alias("text"))
    schema = f"id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_crc32(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_cost_balanced_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return with_crc32(pieces)
