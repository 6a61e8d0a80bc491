"""Media columns from ISO base media containers.

``mux`` stores a payload losslessly as an uncompressed RGB track: every sample
is one 8 x 8 frame of 192 8-bit values.  ``describe`` reads any container of
this family: it walks the nested boxes, decodes the sample tables (sizes,
chunks, times, sync samples) and gives codec, duration and the byte ranges of
the key frames; the media data itself is never read for that.

Nulls and empty texts are one frame of blanks.  Equal payloads give equal bytes.
Bytes that hold no readable track give a null codec and no ranges instead of an
error: broken boxes, boxes nested deeper than ``DEEPEST``, and sample tables that
count more samples than the file has bytes (or a million, in a file without its
media data).  A duration that a file calls unknown is null.  Repeated rows
repeat; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import blank_null, chunks, table

WIDTH = HEIGHT = 8
FRAME = WIDTH * HEIGHT * 3
#: Frames per second, and frames from one sync sample to the next.
RATE, KEY_EVERY = 25, 12
#: Samples of a chunk in the media data.
PER_CHUNK = 64
PAD = b" "
#: Last bytes of a payload that have a checksum of their own.
TAIL = 16

#: Levels of nested boxes (the format's own tables need six), and samples that any file may have.
DEEPEST, FEW_SAMPLES = 64, 1 << 20

#: Boxes that hold other boxes; fixed by the format.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"})


def padded(payload: bytes) -> bytes:
    """The payload with blanks up to a positive multiple of the frame size."""
    return payload.ljust(max(FRAME, -(-len(payload) // FRAME) * FRAME), PAD)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """A container whose one video track holds the payload, a multiple of 192 bytes, frame by frame."""
    n = len(payload) // FRAME
    chunk_count = -(-n // PER_CHUNK)
    last = n - (chunk_count - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK)] if chunk_count > 1 or last == PER_CHUNK else []
    if last != PER_CHUNK:
        runs.append((chunk_count, last))
    entry = struct.pack(">6xH16xHHIIIH32sHh", 1, WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1, b"\0" * 32, 24, -1)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    head = _box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  isom")
    wide = n * FRAME + (1 << 20) >= 1 << 32

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunk_count, dtype=np.int64) * (PER_CHUNK * FRAME)
        table_ = _full(b"co64", struct.pack(">I", chunk_count), offsets.astype(">u8").tobytes()) if wide else _full(b"stco", struct.pack(">I", chunk_count), offsets.astype(">u4").tobytes())
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            table_,
        )
        minf = _box(b"minf", _full(b"vmhd", b"\0" * 8, flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 13), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), _MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    prefix = 16 if n * FRAME + 8 >= 1 << 32 else 8
    size = len(head) + len(moov(0)) + prefix
    return head + moov(size) + _box(b"mdat", payload)


def boxes(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, body start and end of every box, parents first; sizes that leave their parent end its walk."""
    open_: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]  # path, place and end of the parents at hand
    while open_:
        path, start, stop = open_.pop()
        if start + 8 > stop:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > stop:
                continue
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = stop - start
        if size < body - start or start + size > stop:
            continue
        yield (*path, kind), body, start + size
        open_.append((path, start + size, stop))
        if kind in CONTAINERS:
            if len(path) >= DEEPEST:
                raise ValueError("boxes are nested too deep")
            open_.append(((*path, kind), body, start + size))


@dataclass
class Track:
    """What the sample tables of one track say."""

    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int | None = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _numbers(data: bytes, at: int, stop: int, columns: int, kind: str = ">u4") -> np.ndarray:
    """Rows of a counted table that lie within its box."""
    (n,) = struct.unpack_from(">I", data, at)
    width = np.dtype(kind).itemsize * columns
    n = max(0, min(n, (stop - at - 4) // width))
    found = np.frombuffer(data, kind, n * columns, at + 4).reshape(n, columns)
    if len(found) and found.max() > np.iinfo(np.int64).max:
        raise ValueError("a number that no file reaches")
    return found.astype(np.int64)


def _spread(values: np.ndarray, times: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of the values repeated so many times each, without making the others."""
    upto = np.minimum(np.cumsum(np.minimum(times.clip(0), most)), most)
    return np.repeat(values, np.diff(upto, prepend=0))


def tracks(data: bytes) -> Iterator[Track]:
    """The tracks of a container one by one, with their samples' byte offsets, sizes and times; 0-based key frames.

    All tracks together have no more samples than the file has bytes (or ``FEW_SAMPLES``),
    so a file with many tracks costs no more memory than one with one.  Sample tables
    in compact form and those of movie fragments aren't read: such tracks have no samples.
    """
    found: list[dict] = []
    for path, at, stop in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({})
        elif found and path[:2] == (b"moov", b"trak"):
            found[-1][kind] = (at, stop)
    left = max(len(data), FEW_SAMPLES)
    for parts in found:
        track = Track()
        if b"mdhd" in parts:
            at = parts[b"mdhd"][0]
            wide = data[at] == 1
            track.timescale, track.duration = struct.unpack_from(">IQ", data, at + 20) if wide else struct.unpack_from(">II", data, at + 12)
            if track.duration >= (1 << 63 if wide else 0xFFFFFFFF):
                track.duration = None
        if b"stsd" in parts and parts[b"stsd"][1] >= parts[b"stsd"][0] + 16:
            at, stop = parts[b"stsd"]
            track.codec = data[at + 12 : at + 16].decode("latin-1")
            if stop >= at + 44:
                track.width, track.height = struct.unpack_from(">HH", data, at + 40)
        if not all(k in parts for k in (b"stsz", b"stsc", b"stts")) or not (b"stco" in parts or b"co64" in parts):
            yield track
            continue
        at, stop = parts[b"stsz"]
        one, n = struct.unpack_from(">II", data, at + 4)
        if n > left:
            raise ValueError("more samples than bytes")
        left -= n
        sizes = np.full(n, one, np.int64) if one else _numbers(data, at + 8, stop, 1)[:, 0]
        at, stop = parts[b"stsc"]
        runs = _numbers(data, at + 4, stop, 3)
        where, stop = parts.get(b"co64") or parts[b"stco"]
        chunk = _numbers(data, where + 4, stop, 1, ">u8" if b"co64" in parts else ">u4")[:, 0]
        begins = np.append(runs[:, 0].clip(1, len(chunk) + 1), len(chunk) + 1)
        per = _spread(runs[:, 1], np.diff(begins), len(chunk))
        owner = _spread(np.arange(len(per)), per, len(sizes))
        sizes = sizes[: len(owner)]
        before = np.cumsum(sizes) - sizes
        first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        base = np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(owner))))
        track.sizes, track.offsets = sizes, chunk[owner] + before - base
        at, stop = parts[b"stts"]
        steps = _numbers(data, at + 4, stop, 2)
        delta = _spread(steps[:, 1], steps[:, 0], len(sizes))
        delta = np.append(delta, np.zeros(len(sizes) - len(delta), np.int64))  # a short table's last samples take no time
        track.times = np.cumsum(delta) - delta
        if b"stss" in parts:
            at, stop = parts[b"stss"]
            keys = _numbers(data, at + 4, stop, 1)[:, 0] - 1
            track.keys = keys[(keys >= 0) & (keys < len(sizes))]
        else:
            track.keys = np.arange(len(sizes))
        yield track


def read_back(data: bytes) -> bytes:
    """The samples of the first track, in order."""
    track = next(tracks(data))
    joins = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    first = np.concatenate([[0], joins]).astype(int)
    last = np.concatenate([joins, [len(track.sizes)]]).astype(int) - 1
    return b"".join(data[track.offsets[a] : track.offsets[b] + track.sizes[b]] for a, b in zip(first, last))


_RANGE = pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("time", pa.int64())])


def describe(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The rows with codec, width, height, timescale, duration, n_samples and keyframes (offset, size, time)."""
    names = media.columns
    made = ["codec", "width", "height", "timescale", "duration", "n_samples", "keyframes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, media_col):
            rows, ends, found = [], [0], []
            for value in part.column(media_col):
                got = None
                if value.is_valid:
                    try:
                        got = next(tracks(value.as_buffer().to_pybytes()), None)
                    except (struct.error, ValueError, IndexError, OverflowError):
                        got = None
                rows.append((got.codec, got.width, got.height, got.timescale, got.duration, len(got.sizes)) if got else (None,) * 6)
                keys = got.keys if got else np.zeros(0, np.int64)
                found.append(np.stack([got.offsets[keys], got.sizes[keys], got.times[keys]]) if got else np.zeros((3, 0), np.int64))
                ends.append(ends[-1] + len(keys))
            flat = np.concatenate(found, axis=1)
            ranges = pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(_RANGE))
            columns = list(zip(*rows))
            yield pa.record_batch(
                [*part.columns, pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ranges)],
                [*names, *made],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    schema = f"{fields}, codec string, width bigint, height bigint, timescale bigint, duration bigint, n_samples bigint, keyframes array<struct<offset:bigint,size:bigint,time:bigint>>"
    return media.mapInArrow(run, schema)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (the container of the padded text), payload (its samples as read back)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            raw = part.column("text").to_pylist()
            media = [mux(padded(x)) for x in raw]
            yield pa.record_batch(
                [part.column("id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary()), pa.array([read_back(m) for m in media], pa.binary())],
                ["id", "n_bytes", "media", "payload"],
            )

    # as bytes: a text is stored as it is, whether or not it is valid UTF-8
    rows = docs.select(F.col(id_col).alias("id"), blank_null(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, media binary, payload binary").withColumnRenamed("id", id_col)


def op3_iso_media(spark, sf_dir: str) -> DataFrame:
    rows = describe(store(table(spark, sf_dir, "documents")))
    key = F.concat_ws(",", F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"], k["size"])))
    feature = F.concat_ws(":", F.trim("codec"), "width", "height", "timescale", "duration", "n_samples", F.size("keyframes"), F.lower(F.hex(F.crc32(key))))
    tail = F.expr(f"substring(payload, -{TAIL}, {TAIL})")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
