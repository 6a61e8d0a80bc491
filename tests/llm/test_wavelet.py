"""Wavelet shards against plain arrays and the public tokenizer."""

import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from canopy.llm import library_tokens, wavelet

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60_000) | st.integers(0, 5), max_size=400), st.integers(0, 60_000), st.sampled_from([64, 128, 1 << 18]))
def test_shard(tokens, other, block):
    ids = np.array(tokens, np.int64)
    before, wavelet.BLOCK = wavelet.BLOCK, block
    try:
        shard = wavelet.Shard.of(wavelet.build(ids, pa.array([1]), np.array([len(ids)])))
    finally:
        wavelet.BLOCK = before
    assert shard.documents().column("length").to_pylist() == [len(ids)]
    assert shard.access(np.arange(len(ids))).tolist() == shard.tokens().tolist() == tokens
    assert shard.access(np.arange(len(ids))[::-3]).tolist() == tokens[::-3]
    for token in {*tokens[:5], other}:
        assert shard.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert shard.count(token) == int((ids == token).sum())
        for upto in (0, len(ids) // 2, len(ids)):
            assert shard.rank(token, upto) == int((ids[:upto] == token).sum())


def test_lookups_read_few_bytes():
    """One position, a rank and a rare token's occurrences each read the head and a few blocks of a large file."""
    ids = np.random.default_rng(3).integers(0, 50_000, 4_000_000)
    ids[1_234_567] = 50_001
    data = wavelet.build(ids, pa.array([1]), np.array([len(ids)]))
    for look, want in (
        (lambda s: s.access([777_777])[0], ids[777_777]),
        (lambda s: s.rank(17, 2_000_000), (ids[:2_000_000] == 17).sum()),
        (lambda s: s.occurrences(50_001).tolist(), [1_234_567]),
    ):
        read = []
        shard = wavelet.Shard(lambda at, n: read.append(n) or data[at : at + n])
        assert look(shard) == want
        assert sum(read) < len(data) / 6, (sum(read), len(data))


def test_broken_files_are_refused():
    data = bytearray(wavelet.build(np.arange(1000), pa.array([1]), np.array([1000])))
    with pytest.raises(ValueError):
        wavelet.Shard.of(b"x" + bytes(data[1:]))
    with pytest.raises(ValueError):
        wavelet.build(np.array([1 << 16]), pa.array([1]), np.array([1]))


def test_added_tokens_of_the_file(spark, tmp_path):
    """Texts that spell the file's mark have its one id, as the library gives it."""
    mark = "<|endoftext|>"
    texts = [mark, f"a{mark}", f"{mark}b", f"a {mark} b", f"{mark}{mark}", f" {mark}\n{mark}  x", "<|endoftext|", f"don't{mark}'s 12 {mark}34", "", "plain"]
    tokenizer = Tokenizer.from_file(PATH)
    ids, ends = library_tokens.encode_texts(pa.array([*texts, None]), PATH)
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folder = f"file://{tmp_path}/marks"
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read_shards(wavelet.write_shards(docs, PATH, folder), folder).collect()}
    assert got == expected(list(enumerate(texts)))


def expected(documents):
    tokenizer = Tokenizer.from_file(PATH)
    want, start = {}, 0
    for i, text in documents:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return want


def test_query(spark, sf_dir, documents):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.op8_wavelet_shards(spark, sf_dir).collect()}
    assert got == expected(documents)


def test_many_shards(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 1)
    monkeypatch.setattr(wavelet, "chunks", functools.partial(wavelet.chunks, limit=20_000))
    folder = f"file://{tmp_path}/shards"
    docs = spark.createDataFrame(documents[::-1], "doc_id bigint, text string").repartition(5)
    shards = wavelet.write_shards(docs, PATH, folder)
    assert shards.count() == len(list((tmp_path / "shards").glob("*.wvl"))) > 1
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read_shards(shards, folder).collect()}
    assert got == expected(documents)


def test_odd_rows(odd, nothing, tmp_path):
    folder = f"file://{tmp_path}/odd"
    rows = wavelet.read_shards(wavelet.write_shards(odd, PATH, folder), folder).collect()
    ordered = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    want = expected(list(enumerate(t for _, _, t in ordered)))
    assert sorted(tuple(r)[1:] for r in rows) == sorted(want.values())
    empty = f"file://{tmp_path}/empty"
    assert wavelet.read_shards(wavelet.write_shards(nothing, PATH, empty), empty).collect() == []


def test_wide_ids_are_refused(spark, tmp_path):
    """An id that doesn't fit the planes is an error and never another id."""
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    with pytest.raises(Exception, match="more than"):
        wavelet.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/wide", end_id=70_000).collect()
