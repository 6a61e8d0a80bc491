"""Container columns: exact round trip, and the box walk on hand-made containers."""

import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.llm import media


def test_query(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in media.op3_iso_media(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for i, text in documents:
        raw = text.encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (192 if not raw else 0))
        row = got[i]
        assert (row["n_bytes"], row["payload_bytes"]) == (len(raw), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-192:])
        stored = media.mux(payload)
        assert (row["media_bytes"], row["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert row["feature"].split(":")[:6] == ["raw", "8", "8", "25", str(len(payload) // 192), str(len(payload) // 192)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=192 * 150))
def test_round_trip(raw):
    payload = media.padded(raw)
    stored = media.mux(payload)
    assert media.read_back(stored) == payload
    track = next(media.tracks(stored))
    assert (track.duration, track.timescale, len(track.sizes)) == (len(payload) // 192, 25, len(payload) // 192)
    assert track.keys.tolist() == list(range(0, len(payload) // 192, 12))
    for k in track.keys:
        assert stored[track.offsets[k] : track.offsets[k] + track.sizes[k]] == payload[192 * k : 192 * k + 192]


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, body):
    return box(kind, b"\0\0\0\0" + body)


def test_uneven_samples_chunks_and_times():
    """Sizes, chunk runs, 64-bit offsets, durations and sync samples of a hand-made track."""
    sizes = [5, 7, 11, 2, 9]
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1) + box(b"avc1", b"\0" * 24 + struct.pack(">HH", 640, 360) + b"\0" * 50))
        + full(b"stts", struct.pack(">IIIII", 2, 3, 10, 2, 20))
        + full(b"stss", struct.pack(">III", 2, 1, 4))
        + full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 3, 1, 1))
        + full(b"stsz", struct.pack(">II", 0, 5) + struct.pack(">5I", *sizes))
        + full(b"co64", struct.pack(">IQQQ", 3, 1000, 2000, 3000)),
    )
    data = box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 600, 70, 0, 0)) + box(b"minf", stbl)))) + box(b"mdat", b"")
    (track,) = media.tracks(data)
    assert (track.codec, track.width, track.height, track.timescale, track.duration) == ("avc1", 640, 360, 600, 70)
    assert track.offsets.tolist() == [1000, 1005, 2000, 2011, 3000]
    assert track.times.tolist() == [0, 10, 20, 30, 50]
    assert track.keys.tolist() == [0, 3]


@pytest.mark.parametrize("value", [None, b"", b"not a container", struct.pack(">I4s", 2**31, b"moov"), box(b"moov", box(b"trak", box(b"mdia", full(b"stsz", b""))))])
def test_unreadable_media(spark, value):
    df = spark.createDataFrame([(1, bytearray(value) if value is not None else None, "x")], "id int, media binary, codec2 string")
    row = media.describe(df).first()
    assert row["keyframes"] == [] and not row["codec"]


def nested(depth):
    inner = b""
    for _ in range(depth):
        inner = box(b"moov", inner)
    return inner


def hostile(**tables):
    """A track whose sample tables promise far more than the file holds."""
    parts = {"stsd": struct.pack(">I", 1) + box(b"raw ", b"\0" * 78), "stts": struct.pack(">III", 1, 1, 1), "stsc": struct.pack(">IIII", 1, 1, 1, 1), "stsz": struct.pack(">II", 10, 1), "stco": struct.pack(">II", 1, 8)}
    stbl = box(b"stbl", b"".join(full(k.encode(), v) for k, v in (parts | tables).items()))
    return box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 25, 1, 0, 0)) + box(b"minf", stbl))))


BIG = 2**32 - 1


def many_tracks(n):
    """Tracks of some 250 bytes that promise a million samples each."""
    one = hostile(stsz=struct.pack(">II", 1, 1_000_000), stsc=struct.pack(">IIII", 1, 1, 1_000_000, 1), stts=struct.pack(">III", 1, 1_000_000, 1))
    return box(b"moov", one[8:] * n)


@pytest.mark.parametrize(
    "value",
    [
        nested(3000),
        nested(70),
        hostile(stsz=struct.pack(">II", 1, BIG)),
        hostile(stsz=struct.pack(">II", 1, 1 << 20), stsc=struct.pack(">IIII", 1, 1, BIG, 1)),
        hostile(stsc=struct.pack(">IIIIIII", 2, 1, 1, 1, BIG, BIG, 1)),
        hostile(stts=struct.pack(">IIIII", 2, BIG, BIG, BIG, BIG)),
        hostile(stsz=struct.pack(">II", 0, BIG)),
        hostile(stsz=b"", stco=b""),
        hostile(stsc=struct.pack(">I", BIG)),
        hostile(co64=struct.pack(">IQ", 1, 2**64 - 1)),
        many_tracks(150),
    ],
)
def test_hostile_media_costs_little_memory(value):
    """Counts and depths that the bytes don't bear out neither crash nor take memory."""
    import tracemalloc

    tracemalloc.start()
    try:
        list(media.tracks(value))
    except (struct.error, ValueError, IndexError, OverflowError):  # what ``describe`` makes a null codec of
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 700), st.integers(0, 255))
def test_damaged_media_never_crash(noise, at, byte):
    whole = bytearray(media.mux(media.padded(b"some text")))
    whole[at : at + len(noise)] = noise
    whole[-at - 1] = byte
    try:
        list(media.tracks(bytes(whole)))
    except (struct.error, ValueError, IndexError, OverflowError):
        pass


def test_hostile_rows_are_described(spark):
    unknown = bytearray(media.mux(media.padded(b"x")))
    place = bytes(unknown).index(b"mdhd") + 4 + 16
    unknown[place : place + 4] = b"\xff" * 4
    df = spark.createDataFrame([(1, bytearray(nested(3000))), (2, bytearray(hostile(stsz=struct.pack(">II", 1, BIG)))), (3, unknown)], "id int, media binary")
    df = df.union(spark.createDataFrame([(4, bytearray(many_tracks(150)))], "id int, media binary"))
    rows = {r["id"]: r for r in media.describe(df).collect()}
    assert rows[4]["n_samples"] == 1_000_000  # the first track alone is read
    assert rows[1]["codec"] is None and rows[2]["codec"] is None and rows[2]["keyframes"] == []
    assert rows[3]["codec"] == "raw " and rows[3]["duration"] is None


def test_odd_rows(odd, nothing):
    rows = media.store(odd).collect()
    assert sorted(bytes(r["payload"]) for r in rows) == sorted(media.padded((r["text"] or "").encode()) for r in odd.collect())
    assert media.describe(media.store(nothing)).collect() == []


def test_contract_columns_of_odd_rows(spark, tmp_path):
    """Exact columns by the contract: the tail is the last 16 bytes that are read back; bytes that are no UTF-8 stay as they are."""
    raw = [b"", b"short", b"a" * 191, b"b" * 192, b"c" * 193, bytes(range(65, 91)) * 50, "\u00fcn\u00efc\u00f6de \U0001f600".encode(), b"bad \xff\xc3 bytes", b"nul \0 end"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)] + [(len(raw), None)], "doc_id bigint, text binary")
    df.selectExpr("doc_id", "cast(text as string) as text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in media.op3_iso_media(spark, str(tmp_path)).collect()}
    assert len(got) == len(raw) + 1
    for i, text in enumerate([*raw, b""]):
        payload = text + b" " * (-len(text) % 192 or (0 if text else 192))
        row = got[i]
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
