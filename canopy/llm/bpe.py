"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a pre-token exactly one token can be the last one of
that prefix's encoding.  A token ``t`` that ends at ``i`` is the one if ``t``
follows the last token of the prefix before it as the merges would leave them.
The table of last tokens is the whole encoder state: walking back through it
gives the ids of any prefix, an append only adds entries, and after an edit the
entries before the edit stay as they are.

Nulls and empty texts have no ids.  Rows repeat if they repeat in the input,
texts of any length are encoded whole, columns besides id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm import pretokens
from canopy.llm.common import blank_null, chunks

#: Distinct pre-tokens that a worker remembers; beyond it the memory is emptied, which costs time only.
WORDS_KEPT = 250_000
#: Pre-tokens longer than this are encoded one by one.
LOCKSTEP_BYTES = 48
_NONE = np.int32(-1)


def _mix(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class PairMap:
    """Pairs of token ids to their merged id; open addressing in two arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(left) * 4 + 1))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, np.iinfo(np.int32).max, np.int32)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot, todo = _mix(keys, self.bits), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == np.uint64(2**64 - 1)]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = merged[free]
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, the largest int32 where the pair doesn't merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = _mix(keys, self.bits)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.iinfo(np.int32).max).astype(np.int32)
        open_ = np.flatnonzero((there != keys) & (there != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != np.uint64(2**64 - 1))]
        return out


class Vocabulary:
    """The tokens of a file of merge ranks, for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the end of each id's bytes."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.at[ids] - (ends - sizes), sizes) + np.arange(total)
        return self.bytes[place], ends


class PrefixEncoder(Vocabulary):
    """Tables for encoding with one vocabulary whose ids are merge ranks."""

    def __init__(self, path: str):
        super().__init__(path)
        self._splits()
        self._trie()

    def _splits(self) -> None:
        """The two tokens that each token was merged from; single bytes stay whole."""
        n = len(self.tokens)
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        merged = []
        for rank in sorted(self.ranks.values()):
            token = self.tokens[rank]
            if len(token) == 1:
                continue
            parts = self._merge(token, rank)
            self.left[rank], self.right[rank] = parts
            merged.append(rank)
        ids = np.array(merged, np.int64)
        self.pairs = PairMap(self.left[ids], self.right[ids], ids.astype(np.int32))

    def _merge(self, token: bytes, below: int) -> tuple[int, int]:
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best, where = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, where = rank, i
            if where < 0:
                raise ValueError(f"token {token!r} can't be built from merges")
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _trie(self) -> None:
        """Rows of children for the nodes that have any: node 0 is the root."""
        nodes: dict[bytes, int] = {b"": 0}
        edges = []
        for token in self.ranks:
            for k in range(1, len(token) + 1):
                if token[:k] not in nodes:
                    nodes[token[:k]] = len(nodes)
                    edges.append((nodes[token[: k - 1]], token[k - 1], nodes[token[:k]]))
        inner = sorted({a for a, _, _ in edges})
        row = np.full(len(nodes), len(inner), np.int32)  # one empty row for the leaves
        row[inner] = np.arange(len(inner))
        child = np.full((len(inner) + 1, 256), _NONE, np.int32)
        a, b, c = np.array(edges, np.int64).T
        child[row[a], b] = c
        self.child, self.row = child, row
        self.token_of = np.full(len(nodes), _NONE, np.int32)
        for token, rank in self.ranks.items():
            self.token_of[nodes[token]] = rank

    def follows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of both tokens would end with just these two tokens.

        Undo the later of the two tokens' merges step by step.  The pair fails
        as soon as the pieces that then touch at the boundary would have merged
        before the merge undone last.
        """
        top = np.iinfo(np.int32).max
        ok = np.ones(len(first), bool)
        live = np.arange(len(first))
        a, b = first.astype(np.int32), second.astype(np.int32)
        limit = np.full(len(first), top, np.int32)
        while len(live):
            bad = self.pairs.get(a, b) < limit
            ok[live[bad]] = False
            keep = ~bad
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
            na, nb = self.right[a], self.left[b]
            open_a, open_b = na != a, nb != b
            # the token with the higher rank was merged last; an equal right one first
            undo_a = open_a & ((a > b) | ~open_b)
            undo_b = open_b & ~undo_a
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, na, a), np.where(undo_b, nb, b)
            keep = undo_a | undo_b
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return ok

    def last_tokens(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``last[w, i]``: the last token of the first ``i + 1`` bytes of each padded word."""
        n, width = words.shape
        last = np.full((n, width), _NONE, np.int32)
        for j in range(width):
            who = np.flatnonzero(lengths > j)
            if not len(who):
                break
            before = last[who, j - 1] if j else None
            node = np.zeros(len(who), np.int32)
            depth = j
            while len(who):
                node = self.child[self.row[node], words[who, depth]]
                keep = node >= 0
                who, node = who[keep], node[keep]
                before = before[keep] if before is not None else None
                token = self.token_of[node]
                hit = np.flatnonzero((token >= 0) & (last[who, depth] < 0))
                if len(hit):
                    if before is not None:
                        hit = hit[self.follows(before[hit], token[hit])]
                    last[who[hit], depth] = token[hit]
                depth += 1
                if depth >= width:
                    break
                keep = lengths[who] > depth
                who, node = who[keep], node[keep]
                before = before[keep] if before is not None else None
        return last

    def extend(self, last: list[int], word: bytes, start: int) -> list[int]:
        """Entries of ``last`` from byte ``start`` on, given those before it."""
        del last[start:]
        longest = int(self.sizes.max())
        for i in range(start, len(word)):
            found = []
            for size in range(1, min(longest, i + 1) + 1):
                token = self.ranks.get(word[i + 1 - size : i + 1])
                if token is not None:
                    found.append((token, last[i - size] if size <= i else -1))
            token, before = np.array(found, np.int32).T
            ok = before < 0
            rest = np.flatnonzero(~ok)
            ok[rest] = self.follows(before[rest], token[rest])
            last.append(int(token[np.flatnonzero(ok)[0]]))
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= len(self.tokens[last[i - 1]])
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words in order, and each word's number of ids."""
        sizes = np.array([len(w) for w in words], np.int64)
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, place in the word, ids
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= LOCKSTEP_BYTES]
        for some in np.array_split(order, max(1, len(order) // 20_000)):
            if not len(some):
                continue
            width = int(sizes[some].max())
            flat = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in some), np.uint8)
            length = sizes[some]
            last = self.last_tokens(flat.reshape(len(some), width), length)
            at, live, step = length.copy(), np.arange(len(some)), 0
            while len(live):
                token = last[live, at[live] - 1]
                parts.append((some[live], np.full(len(live), step), token))
                at[live] -= self.sizes[token]
                counts[some[live]] += 1
                live = live[at[live] > 0]
                step += 1
        for i in np.flatnonzero(sizes > LOCKSTEP_BYTES):
            ids = self.walk_back(self.extend([], words[i], 0))
            counts[i] = len(ids)
            parts.append((np.full(len(ids), i), np.arange(len(ids))[::-1], np.array(ids, np.int32)))
        start = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(int(start[-1]), np.int32)
        for word, step, token in parts:  # step counts from the word's end
            out[start[word + 1] - 1 - step] = token
        return out, counts


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


class EditableText:
    """A text with its encoder state: exact appends, and edits that re-encode nearby pre-tokens only."""

    def __init__(self, path: str, text: str = ""):
        self.coder = encoder(path)
        self.words: list[bytes] = []
        self.states: list[list[int]] = []
        self.reused = 0
        self.replace(0, 0, text)

    @property
    def text(self) -> str:
        return b"".join(self.words).decode()

    @property
    def ids(self) -> list[int]:
        return [i for state in self.states for i in self.coder.walk_back(state)]

    def append(self, more: str) -> None:
        n = len(self.text)
        self.replace(n, n, more)

    def replace(self, start: int, stop: int, by: str) -> None:
        """Replace the characters from ``start`` to ``stop``; unchanged pre-tokens and prefixes keep their state."""
        text = self.text
        text = text[:start] + by + text[stop:]
        data, ends = pretokens.text_buffers(pa.array([text]))
        raw = data.tobytes()
        cuts = [*pretokens.split(data, ends).tolist(), len(raw)]
        words = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        head = 0
        while head < min(len(words), len(self.words)) and words[head] == self.words[head]:
            head += 1
        tail = 0
        while tail < min(len(words), len(self.words)) - head and words[-1 - tail] == self.words[-1 - tail]:
            tail += 1
        states = self.states[:head]
        for k in range(head, len(words) - tail):
            old, state = (self.words[k], self.states[k]) if k < len(self.words) - tail else (b"", [])
            same = 0
            while same < min(len(old), len(words[k])) and old[same] == words[k][same]:
                same += 1
            self.reused += same
            states.append(self.coder.extend(list(state[:same]), words[k], same))
        self.states = states + (self.states[len(self.states) - tail :] if tail else [])
        self.words = words


class WordIds:
    """Ids of distinct pre-tokens, remembered across the batches of a worker."""

    def __init__(self, encode_words):
        self.encode_words = encode_words
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def rows(self, words: pa.Array) -> np.ndarray:
        """Row of each word in ``start``; new words are encoded first."""
        keys = words.to_pylist()
        if len(self.place) + len(keys) > WORDS_KEPT and self.place:
            self.clear()
        place = self.place
        new = [k for k in keys if k not in place]
        if new:
            flat, counts = self.encode_words(new)
            first = len(place)
            place.update(zip(new, range(first, first + len(new))))
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
        return np.fromiter(map(place.__getitem__, keys), np.int64, len(keys))


def encode_texts(texts: pa.Array, memory: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the ``n + 1`` ends of the texts in them."""
    data, ends = pretokens.text_buffers(texts)
    starts = pretokens.split(data, ends)
    words, index = pretokens.words_of(data, starts)
    if len(words) == 0:
        return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
    row = memory.rows(words)
    begin, count = memory.start[row], memory.start[row + 1] - memory.start[row]
    n = count[index]
    upto = np.concatenate([[0], np.cumsum(n)])
    place = np.repeat(begin[index] - upto[:-1], n) + np.arange(int(upto[-1]))
    return memory.flat[place], upto[np.searchsorted(starts, ends)]


@functools.cache
def memory(path: str) -> WordIds:
    return WordIds(encoder(path).encode_words)


def packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each text's ids as little-endian unsigned 32-bit integers in one binary value."""
    raw = np.ascontiguousarray(ids.astype("<u4"))
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every whole text.

    ``path`` is a file of merge ranks that every worker can read.  The plan is a
    scan and one Arrow map: no shuffle, memory bounded by a batch of texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = memory(path)
        for part in chunks(batches, "text"):
            ids, ends = encode_texts(part.column("text"), words)
            yield pa.record_batch([part.column("id"), pa.array(np.diff(ends)), packed(ids, ends)], ["id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), blank_null(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The encoded rows with ``decoded``, the bytes of their ids; null ids decode to no bytes."""
    names = encoded.columns
    schema = encoded.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for part in chunks(batches, ids_col):
            column = part.column(ids_col).fill_null(b"").cast(pa.large_binary())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            data, stop = coder.decode(raw.view("<u4").astype(np.int64))
            stop = np.concatenate([[0], stop])[(ends - ends[0]) // 4]
            made = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(stop.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.record_batch([*part.columns, made.cast(pa.binary())], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def op2_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from canopy.llm.common import table

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
