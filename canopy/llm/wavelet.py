"""Token-id files as one wavelet matrix per shard.

A shard file holds the ids of a run of documents as the bit-planes of a wavelet
matrix.  Every plane is cut into blocks that are compressed one by one; the
file's head tells where each block lies and how many ones come before it.  From
that one file any position can be read (``access``), a token counted up to any
position (``rank``, ``count``) and its occurrences listed (``occurrences``), and
each of them reads the head and the few blocks that it needs, nothing else.

Documents are dealt out by ranges of their id and sorted within them, so file
names in ascending order hold the ids in ascending document order.  A range is
cut into shards of bounded size.  A shard is written under a name of its task
attempt and then moved, so a task that runs again leaves one file.

Nulls and empty texts have the end token only; rows of equal id follow in order
of their text; rows without id come first.  An empty table has no files.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm import library_tokens
from canopy.llm.common import blank_null, chunks, cut, shared_dir, table

MAGIC = b"WAVELET2"
BITS = 16
#: Tokens that close a shard, checked after each block of texts.
SHARD_TOKENS = 8_000_000
#: Bits of a block, a multiple of 64.
BLOCK = 1 << 18
#: Positions that are looked up at a time.
AT_ONCE = 1 << 16
#: Planes are read whole where one of so many positions is asked for.
DENSE = 16
END_ID = 0


def _pack_bits(bits: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit words of a boolean array."""
    raw = np.packbits(bits, bitorder="little")
    return np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)]).view("<u8")


def build(ids: np.ndarray, keys: pa.Array, lengths: np.ndarray, bits: int = BITS) -> bytes:
    """A shard file: head, documents (id, length), then each plane's blocks.

    Planes go from the highest bit down; each sorts the next one stably by its bit.
    """
    import zstandard

    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"ids need more than {bits} bits")
    squeeze = zstandard.ZstdCompressor(level=1).compress
    sink = pa.BufferOutputStream()
    docs = pa.record_batch([keys, pa.array(lengths, pa.int64())], ["id", "length"])
    with pa.ipc.new_stream(sink, docs.schema) as writer:
        writer.write_batch(docs)
    sections, ones, zeros = [squeeze(sink.getvalue())], [], []
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for level in range(bits - 1, -1, -1):
        bit = (now & now.dtype.type(1 << level)) != 0
        words = _pack_bits(bit)
        blocks = [words[a : a + BLOCK // 64] for a in range(0, len(words), BLOCK // 64)]
        ones += [int(np.bitwise_count(b).sum()) for b in blocks]
        sections += [squeeze(np.ascontiguousarray(b)) for b in blocks]
        low, high = now[~bit], now[bit]
        zeros.append(len(low))
        now = np.concatenate([low, high])
    tables = np.array([*map(len, sections), *ones], "<u8").tobytes()
    head = json.dumps({"size": len(ids), "bits": bits, "block": BLOCK, "zeros": zeros, "tables": len(tables)}).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, tables, *sections])


class Shard:
    """A shard file that is read through ``fetch(offset, length)``, block by block."""

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self.fetch = fetch
        start = fetch(0, 16)
        if start[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (n,) = struct.unpack_from("<Q", start, 8)
        head = json.loads(fetch(16, n))
        self.size, self.block, self.zeros = head["size"], head["block"], head["zeros"]
        per = -(-self.size // self.block)  # blocks of a plane
        tables = np.frombuffer(fetch(16 + n, head["tables"]), "<u8").astype(np.int64)
        self.sizes, ones = tables[: 1 + per * head["bits"]], tables[1 + per * head["bits"] :].reshape(head["bits"], per)
        if len(ones) != len(self.zeros) or (ones.sum(axis=1) + self.zeros != self.size).any():
            raise ValueError("the planes' counts don't add up")
        self.places = 16 + n + head["tables"] + np.cumsum(self.sizes) - self.sizes
        #: Ones of each plane before each block, and in all.
        self.before = np.concatenate([np.zeros((head["bits"], 1), np.int64), np.cumsum(ones, axis=1)], axis=1)
        self.per = per
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, n: data[at : at + n])

    def documents(self) -> pa.RecordBatch:
        """The documents (id, length) in order."""
        return pa.ipc.open_stream(io.BytesIO(self._section(0))).read_next_batch()

    def _section(self, number: int) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self.fetch(int(self.places[number]), int(self.sizes[number])))

    def _load(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of a block, and the plane's ones before each of them."""
        found = self.held.get((plane, block))
        if found is None:
            words = np.frombuffer(self._section(1 + plane * self.per + block), "<u8")
            counts = np.bitwise_count(words).cumsum(dtype=np.int64)
            if counts[-1] != self.before[plane, block + 1] - self.before[plane, block]:
                raise ValueError("a block differs from its stored rank")
            found = self.held[plane, block] = (words, self.before[plane, block] + np.concatenate([[0], counts[:-1]]))
        return found

    def _look(self, plane: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A plane's bits at positions, and its ones before each of them."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        one = np.uint64(1)
        block = at // self.block
        first, last = (int(block.min()), int(block.max())) if len(at) else (0, -1)
        if first == last:  # most often: all in one block
            words, before = self._load(plane, first)
            word = word - first * (self.block // 64)
            held, base = words[word], before[word]
        else:
            held, base = np.empty(len(at), np.uint64), np.empty(len(at), np.int64)
            for b in np.unique(block):
                some = np.flatnonzero(block == b)
                words, before = self._load(plane, int(b))
                local = word[some] - int(b) * (self.block // 64)
                held[some], base[some] = words[local], before[local]
        return (held >> rest) & one, base + np.bitwise_count(held & ((one << rest) - one))

    def _ones(self, plane: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        if at == self.size:
            return int(self.before[plane, -1])
        return int(self._look(plane, np.array([at]))[1][0])

    def access(self, at) -> np.ndarray:
        """Tokens at the given positions; for many positions a whole plane is looked at after the other."""
        every = np.asarray(at, np.int64)
        if DENSE * len(every) > self.size:
            return self._access_many(every)
        out = np.zeros(every.shape, np.int64)
        for a in range(0, len(every), AT_ONCE):
            at = every[a : a + AT_ONCE]
            value = np.zeros(len(at), np.uint64)
            for plane, zeros in enumerate(self.zeros):
                bit, ones = self._look(plane, at)
                value = (value << np.uint64(1)) | bit
                at = np.where(bit != 0, zeros + ones, at - ones)
            out[a : a + AT_ONCE] = value
        return out

    def _plane(self, plane: int) -> np.ndarray:
        """All bits of a plane, checked against its stored ranks."""
        words = [np.frombuffer(self._section(1 + plane * self.per + b), "<u8") for b in range(self.per)]
        ones = np.array([np.bitwise_count(w).sum() for w in words], np.int64).cumsum()
        if not np.array_equal(ones, self.before[plane, 1:]):
            raise ValueError("a block differs from its stored rank")
        return np.unpackbits(np.concatenate(words or [np.zeros(0, "<u8")]).view(np.uint8), count=self.size, bitorder="little").view(bool)

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes' sorting undone from the last one up, in two bytes a token where ids fit."""
        now = np.zeros(self.size, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for plane in range(len(self.zeros) - 1, -1, -1):
            bits, zeros = self._plane(plane), self.zeros[plane]
            above = np.empty_like(now)
            above[~bits] = now[:zeros]
            above[bits] = now[zeros:] | now.dtype.type(1 << (len(self.zeros) - 1 - plane))
            now = above
        return now

    def _access_many(self, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.intp)
        value = np.zeros(len(at), np.uint32)
        goes = np.empty(self.size, np.uint32)  # where each position of a plane goes
        for plane, zeros in enumerate(self.zeros):
            bits = self._plane(plane)
            goes[~bits] = np.arange(zeros, dtype=np.uint32)
            goes[bits] = np.arange(zeros, self.size, dtype=np.uint32)
            for a in range(0, len(at), AT_ONCE):
                some = slice(a, a + AT_ONCE)
                new = goes[at[some]]
                at[some] = new
                value[some] = (value[some] << np.uint32(1)) | (new >= zeros)
        return value

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        """The token's place in the order below the last plane, for its occurrences before ``upto``."""
        low, high = 0, upto
        for plane, zeros in enumerate(self.zeros):
            a, b = self._ones(plane, low), self._ones(plane, high)
            one = (token >> (len(self.zeros) - 1 - plane)) & 1
            low, high = (zeros + a, zeros + b) if one else (low - a, high - b)
            if low == high:
                break
        return low, high

    def rank(self, token: int, upto: int) -> int:
        """How often the token occurs before position ``upto``."""
        low, high = self._range(token, upto)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def _select(self, plane: int, one: bool, which: np.ndarray) -> np.ndarray:
        """Positions of a plane's ascending ``which``-th ones or zeros."""
        bounds = self.before[plane] if one else np.minimum(np.arange(self.per + 1) * self.block, self.size) - self.before[plane]
        block = np.searchsorted(bounds, which, side="right") - 1
        out = np.empty(len(which), np.int64)
        for b in np.unique(block):
            some = np.flatnonzero(block == b)
            words, _ = self._load(plane, int(b))
            room = min(self.block, self.size - int(b) * self.block)
            bits = np.unpackbits(words.view(np.uint8), count=room, bitorder="little")
            out[some] = int(b) * self.block + np.flatnonzero(bits == one)[which[some] - bounds[b]]
        return out

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of the token, ascending: select by walking the planes upwards."""
        low, high = self._range(token, self.size)
        at = np.arange(low, high)
        if not len(at):
            return at
        for plane in range(len(self.zeros) - 1, -1, -1):
            one = bool((token >> (len(self.zeros) - 1 - plane)) & 1)
            at = self._select(plane, one, at - (self.zeros[plane] if one else 0))
        return at


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write every whole text's ids to shard files in ``folder``; returns shard, file, n_docs, n_tokens and n_bytes."""
    names = ["shard", "file", "n_docs", "n_tokens", "n_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        number = 0

        def flush(parts: list) -> pa.RecordBatch:
            shard = (task.partitionId() << 24) | number
            flat = np.concatenate([p[1] for p in parts])
            lengths = np.concatenate([p[2] for p in parts])
            keys = pa.concat_arrays([p[0] for p in parts])
            parts.clear()
            data = build(flat, keys, lengths)
            name = f"{shard:016d}.wvl"
            draft = f"{base}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                out.write(data)
            store.move(draft, f"{base}/{name}")
            return pa.record_batch([[shard], [name], [len(lengths)], [len(flat)], [len(data)]], names)

        parts, tokens = [], 0
        for part in chunks(batches, "text"):
            ids, ends = library_tokens.encode_texts(part.column("text"), path)
            if max(int(ids.max(initial=0)), end_id) >> BITS:
                raise ValueError(f"the vocabulary has ids of more than {BITS} bits")
            parts.append((part.column("id"), np.insert(ids, ends[1:], end_id).astype(np.uint16), np.diff(ends) + 1))
            tokens += len(parts[-1][1])
            if tokens >= SHARD_TOKENS:
                yield flush(parts)
                number, tokens = number + 1, 0
        if parts:
            yield flush(parts)

    rows = docs.select(F.col(id_col).alias("id"), blank_null(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return cut(ordered.mapInArrow(run, "shard bigint, file string, n_docs bigint, n_tokens bigint, n_bytes bigint"))


def read_shards(shards: DataFrame, folder: str, id_col: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """Rows id, start (tokens of all documents before it), n_tokens and ids_crc32, decoded from the shard files."""
    names = ["id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with store.open_input_file(f"{base}/{file}") as source:
                    shard = Shard(lambda at, n, source=source: source.read_at(n, at))
                    docs = shard.documents()
                    lengths = docs.column("length").to_numpy()
                    ends = np.cumsum(lengths)
                    ids = shard.tokens().astype("<u4")
                crc = [zlib.crc32(memoryview(ids[b - n : b])) for b, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.record_batch([docs.column("id"), pa.array(before + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names)

    # one row per shard: the running total sees no document
    total = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("before", F.coalesce(F.sum("n_tokens").over(total), F.lit(0)))
    dealt = placed.select("file", "before").repartition(max(1, min(shards.count(), 10_000)))
    return dealt.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def op8_wavelet_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "wavelet-shards")
    shards = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_shards(shards, folder)
