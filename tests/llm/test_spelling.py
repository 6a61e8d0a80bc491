"""Automata against plain sets, and the query against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.llm import spelling as S

ALL = "abcdefghijklmnopqrstuvwxyzàéüÿß"


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def near_of(words):
    letters = sorted({c for w in words for c in w})
    return {w: {v for v in edits(w, letters) if v in words and v != w} for w in words}


def forms_of(counts):
    out = {}
    near = near_of(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def counts_of(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), max_size=40))
def test_automaton_numbers_and_finds(words):
    order = sorted(words)
    automaton = S.Automaton(order)
    assert [automaton.place(w) for w in order] == list(range(len(order))) and automaton.place("none") == -1
    near = near_of(words)
    for w in order:
        for exact in range(len(w) + 1):
            places = automaton.one_error(w, exact)
            assert len(places) == len(set(places))
            want = {v for v in near[w] if v[:exact] == w[:exact] and w[exact:] != v[exact:]}
            assert {order[p] for p in places} == want


def test_automaton_is_minimal():
    automaton = S.Automaton(sorted(a + b for a in ("ab", "cd", "ef") for b in ("ing", "ings", "ed")))
    behaviours = {(e, tuple(sorted((c, t) for c, (t, _) in x.items()))) for e, x in zip(automaton.ends, automaton.edges, strict=True)}
    assert len(behaviours) == len(automaton.edges) < 12


@pytest.mark.parametrize("shard", [7, 60, 100_000])
def test_forms_equal_brute_force(spark, shard):
    dice = random.Random(5)
    base = ["".join(dice.choices("abcdé", k=dice.randint(6, 9))) for _ in range(150)] + ["w" * 300, "w" * 301, "pre" * 3, "prepreprx"]
    words = {*base, *(dice.choice(list(edits(w, "abcdé"))) for w in base for _ in range(2))}
    counts = {w: dice.choice([5, 6, 25, 30, 125, 625, 700, 3500]) for w in words if len(w) >= 6}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
    assert got(S.forms(df, shard)) == forms_of(counts)
    pairs = S.near_words(df, shard).collect()
    assert len(pairs) == len({(r["word"], r["near"]) for r in pairs})


def test_query_equals_brute_force(spark, sf_dir, documents):
    want = forms_of(counts_of(documents))
    assert want and got(S.op11_spelling_variants(spark, sf_dir)) == want
    assert any(f for f, *_ in want.values())


def test_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    more = [(i, "Spelling spéllingß x×x naïveté " * 6) for i in (None, 1, 2, 3)]
    extra = spark.createDataFrame(more, "doc_id bigint, text string")
    df = odd.select("doc_id", "text").union(extra)
    assert got(S.forms(S.words_of(df))) == forms_of(counts_of(rows + more))
    assert got(S.forms(S.words_of(odd))) == forms_of(counts_of(rows))
    assert S.forms(S.words_of(nothing)).collect() == []
