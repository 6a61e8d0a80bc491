"""Packing: every id in one piece, gapless sequences, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from canopy.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(pieces, tokens_of):
    """``pieces``: (doc, start, length, sequence, offset); ``tokens_of``: tokens of each document."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in pieces:
        assert length > 0
        docs[doc].append((start, length))
        sequences[sequence].append((offset, length))
    for parts, whole in ((docs, tokens_of), (sequences, None)):
        for key, spans in parts.items():
            at = 0
            for begin, length in sorted(spans):
                assert begin == at
                at += length
            assert at == whole[key] if whole is not None else at <= packing.CAPACITY
    assert set(docs) == set(tokens_of)
    return {k: sum(n for _, n in v) for k, v in sequences.items()}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 7000), max_size=60))
def test_pack(sizes):
    filled = check(packing.pack(np.array(sizes, np.int64)), dict(enumerate(sizes)))
    assert sum(n < packing.CAPACITY for n in filled.values()) <= 1


def test_costs_are_balanced():
    """Long and short documents mix: no sequence costs much more than the mean."""
    random = np.random.default_rng(2)
    sizes = np.concatenate([random.integers(900, 1500, 100), random.integers(5, 120, 2000)])
    cost = defaultdict(float)
    for _, _, length, sequence, _ in packing.pack(sizes):
        cost[sequence] += packing.LINEAR * length + packing.QUADRATIC * length * length
    values = np.array(list(cost.values())[:-1])
    assert values.max() < 1.5 * values.mean()


def test_query(spark, sf_dir, documents, tokenizer):
    rows = packing.op6_cost_balanced_packing(spark, sf_dir).collect()
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in documents}
    filled = check([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in rows], {i: len(v) for i, v in ids.items()})
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(part.tobytes()), len(ids[r["doc_id"]]))
    assert sum(filled.values()) > 0.97 * packing.CAPACITY * len(filled)


def test_odd_rows(odd, nothing, tokenizer):
    rows = packing.pack_documents(odd, PATH).collect()
    want = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sum(r["length"] for r in rows) == want == sum(len(r["ids"]) // 4 for r in rows)
    assert packing.pack_documents(nothing, PATH).collect() == []


def test_added_tokens_of_the_file(spark, tokenizer):
    mark = "<|endoftext|>"
    texts = [mark, f"z{mark}", f"{mark} z", f"a {mark} b{mark}{mark}c", "plain"]
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), PATH).collect()}
    assert got == {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
