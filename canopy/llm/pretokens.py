"""Byte-level BPE pre-tokenisation of whole Arrow columns with numpy.

The pre-token pattern is ``public_tokenizers.PATTERN``: contractions, runs of
letters, numbers or other characters with an optional leading space, and white
space.  Its matches depend only on the class of each character and a few fixed
neighbours, so all texts of an Arrow batch are split at once on their UTF-8
buffer, without a regular expression call per document.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Contraction suffixes of the pattern, longest first where they share a start.
_ONE = b"stmd"
_TWO = (b"re", b"ve", b"ll")


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point, as the pattern's engine sees it."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        one = regex.compile(pattern)
        for low in range(0, 0x110000, 0x1000):
            if low == 0xD000:
                text = "".join(map(chr, range(low, 0xD800)))
            elif 0xD800 <= low < 0xE000:
                continue
            else:
                text = "".join(map(chr, range(low, low + 0x1000)))
            hits = [ord(m) for m in one.findall(text)]
            table[hits] = kind
    return table


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and ``n + 1`` document offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def _byte_classes(data: np.ndarray) -> np.ndarray:
    classes = _classes()
    kind = np.empty(256, np.uint8)
    kind[:128] = classes[:128]
    kind[128:] = 255
    out = kind[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.uint32)
        width = 2 + (b >= 0xE0) + (b >= 0xF0)
        point = np.where(width == 2, b & 0x1F, np.where(width == 3, b & 0x0F, b & 0x07))
        for k in (1, 2, 3):
            more = width > k
            follow = data[np.minimum(lead + k, len(data) - 1)].astype(np.uint32) & 0x3F
            point = np.where(more, (point << 6) | follow, point)
        cls = classes[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            sel = width > k
            out[lead[sel] + k] = cls[sel]
    return out


def split(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte position where each pre-token of the documents starts, ascending."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    cls = _byte_classes(data)
    first = np.zeros(n + 1, bool)
    first[ends] = True
    first = first[:n]
    # a run starts where the class changes or a document begins
    run = first.copy()
    run[1:] |= cls[1:] != cls[:-1]
    blank = data == 32
    # token starts: runs; the run after a blank starts at the blank instead
    start = run.copy()
    at = np.flatnonzero(run & ~first)
    at = at[(cls[at - 1] == SPACE)]  # a run of another class after white space
    with_blank = at[blank[at - 1]]
    start[with_blank] = False
    start[with_blank - 1] = True
    other = at[~blank[at - 1]]
    if len(other):  # the last white-space character stands alone; it may take several bytes
        back = other - 1
        while True:
            more = (data[back] & 0xC0) == 0x80
            if not more.any():
                break
            back = np.where(more, back - 1, back)
        start[back] = True
    # contractions: an apostrophe that begins a token, then the letters of the pattern
    mark = np.flatnonzero((data == 39) & run & start)
    if len(mark):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        doc_end = np.searchsorted(ends, mark, side="right")
        room = ends[np.minimum(doc_end, len(ends) - 1)] - mark
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, np.frombuffer(_ONE, np.uint8)) & (room > 1)
        long = np.zeros(len(mark), bool)
        for pair in _TWO:
            long |= (one == pair[0]) & (two == pair[1])
        long &= room > 2
        for hit, size in ((short, 2), (long & ~short, 3)):
            m = mark[hit]
            start[m + 1] = False
            cut = m + size
            cut = cut[cut < n]
            start[cut[cls[cut] == LETTER]] = True
    return np.flatnonzero(start)


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct pre-tokens as a binary array, and for each pre-token its index there."""
    if len(starts) == 0:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int32)
    offsets = np.append(starts, len(data)).astype(np.int64)
    array = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )
    encoded = array.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
