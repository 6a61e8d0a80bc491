"""BPE ids against the public library; exact appends and edits."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from canopy.llm import bpe, pretokens

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session")
def library():
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(PATH), special_tokens={})


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_query_equals_library(spark, sf_dir, documents, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.op2_bpe_roundtrip(spark, sf_dir).collect()}
    want = {}
    for i, text in documents:
        ids = library.encode(text, disallowed_special=())
        want[i] = (len(ids), digest(ids), hashlib.sha256(text.encode()).hexdigest())
    assert got == want


def test_pretokens_equal_the_pattern():
    random = np.random.default_rng(3)
    letters = list("abc'stmdrevl  \n\t\r  é漢字1२ⅷ.,!?-_\U0001f600́")
    texts = ["".join(random.choice(letters, int(random.integers(0, 40)))) for _ in range(3000)] + ["", "'", "''s", "a's 're'll"]
    data, ends = pretokens.text_buffers(pa.array(texts))
    starts = pretokens.split(data, ends).tolist() + [len(data)]
    raw = data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(starts, starts[1:])]
    assert got == [m for t in texts for m in regex.findall(public_tokenizers.PATTERN, t)]


def test_edits_reuse_the_state(library):
    text = bpe.EditableText(PATH, "The quick brown fox")
    text.append("es jumped over the lazy dogs' bowl  ")
    text.replace(4, 9, "slow, unhurried")
    assert text.text == "The slow, unhurried brown foxes jumped over the lazy dogs' bowl  "
    assert text.ids == library.encode(text.text)
    random = np.random.default_rng(4)
    for _ in range(60):
        n = len(text.text)
        a, b = sorted(random.integers(0, n + 1, 2).tolist())
        text.replace(a, min(b, a + 5), "".join(random.choice(list("ab c's\n é1"), 4)))
        assert text.ids == library.encode(text.text)
    assert text.reused


def test_odd_rows(odd, nothing, library):
    rows = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    want = sorted((len(library.encode(r["text"] or "")), (r["text"] or "").encode()) for r in odd.collect())
    assert sorted((r["n_tokens"], bytes(r["decoded"])) for r in rows) == want
    assert bpe.encode(nothing, PATH).collect() == []
