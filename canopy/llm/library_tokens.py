"""Token ids of whole texts with the tokenizers library, one call per distinct pre-token.

The library encodes each pre-token on its own, so a pre-token's ids don't depend
on its neighbours.  Texts are split with ``pretokens``; what a worker hasn't seen
yet goes to the library in a few long strings.

A file's added tokens (marks such as the end of a text) are found before that,
wherever a text spells them, and have one id each; the parts between them are
encoded as texts of their own.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from canopy.llm import bpe
from canopy.llm.bpe import WordIds

#: Pre-tokens joined to one string for the library.
JOINED = 40


@functools.cache
def _library(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        sizes[i] = len(token)  # a byte-level vocabulary spells each byte as one character
    return tokenizer, sizes


def encode_words(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the words in order, and each word's number of ids.

    Words of a blank and letters only can be joined: the pattern splits them at
    the blanks again.  All others are encoded alone.
    """
    tokenizer, sizes = _library(path)
    texts = [w.decode() for w in words]
    joined = np.fromiter((t[0] == " " and t[1:].isalpha() for t in texts), bool, len(texts))
    length = np.fromiter(map(len, words), np.int64, len(words))
    counts = np.zeros(len(words), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for index, together in ((np.flatnonzero(joined), JOINED), (np.flatnonzero(~joined), 1)):
        for a in range(0, len(index), 2000 * together):
            some = index[a : a + 2000 * together]
            spelled = [texts[i] for i in some.tolist()]
            encoded = tokenizer.encode_batch_fast(["".join(spelled[k : k + together]) for k in range(0, len(spelled), together)], add_special_tokens=False)
            ids = np.fromiter(itertools.chain.from_iterable([e.ids for e in encoded]), np.int32)
            # a token belongs to the word in which its last byte lies
            owner = np.searchsorted(np.cumsum(length[some]), np.cumsum(sizes[ids]), side="left")
            counts[some] = np.bincount(owner, minlength=len(some))
            parts.append((some, ids))
    start = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(start[-1]), np.int32)
    for index, ids in parts:
        n = counts[index]
        before = np.cumsum(n) - n
        out[np.repeat(start[index] - before, n) + np.arange(len(ids))] = ids
    return out, counts


@functools.cache
def memory(path: str) -> WordIds:
    return WordIds(functools.partial(encode_words, path))


@functools.cache
def added_tokens(path: str) -> dict[str, int]:
    """Spelling and id of the file's added tokens, the longest first; those that depend on their neighbours are refused."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError("added tokens that look at their neighbours aren't supported")
    return {t["content"]: t["id"] for t in sorted(found, key=lambda t: -len(t["content"]))}


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the ``n + 1`` ends of the texts in them; null is empty."""
    marks = added_tokens(path)
    if not any(pc.any(pc.match_substring(texts, m)).as_py() for m in marks):
        return bpe.encode_texts(texts, memory(path))
    pattern = re.compile("(" + "|".join(map(re.escape, marks)) + ")")
    parts: list[str] = []
    owner: list[int] = []
    after: list[int] = []  # id of the mark that follows a part, -1 at a text's end
    for k, text in enumerate(texts.to_pylist()):
        split = pattern.split(text or "")
        parts += split[::2]
        owner += [k] * len(split[::2])
        after += [*(marks[m] for m in split[1::2]), -1]
    flat, ends = bpe.encode_texts(pa.array(parts, pa.large_string()), memory(path))
    mark = np.array(after, np.int64)
    marked = mark >= 0
    ids = np.insert(flat, ends[1:][marked], mark[marked])
    counts = np.bincount(np.array(owner), np.diff(ends) + marked, minlength=len(texts)).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(counts)])
