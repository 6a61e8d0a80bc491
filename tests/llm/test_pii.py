"""Rules against plain patterns, the network's gradients, and what it adds on rows that it hasn't seen."""

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else sum(map(int, str(2 * x))) for i, x in enumerate(d)) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            s = m.group()
            d = re.sub("[^0-9]", "", s)
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 13 <= len(d) <= 19 and plain_luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def digest(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


@pytest.fixture(scope="module")
def network(documents):
    texts = [t for _, t in documents]
    around = [t[max(0, m.start() - 100) : m.start() + 140] for t in texts if (m := re.search("[0-9@]", t))]
    return P.train(sorted({t[:240] for t in texts} | set(around)), steps=250)


@settings(max_examples=400, deadline=None)
@given(st.text("0159 .-+@()aZ_%é\U0001f600\n", max_size=60))
def test_rules_are_the_patterns(text):
    assert P.base_spans(text) == plain_spans(text)


def test_rules_on_numbers():
    good = "4539578763621486"
    for text in [f"{good} {good}", f"x{good}y", "+1 (023) 555-0100 4", "1.2.3.4.5.6.7.8", "300.1.1.1 001.02.3.4", "a@b.c@d.e a.b@c-d.e-f.g-", "4539-5787 6362-1486", "+1234567890123456", "0" * 16]:
        assert P.base_spans(text) == plain_spans(text)


def test_long_runs_take_no_time():
    began = time.monotonic()
    for text in ["w" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" * 150_000, "a" * 300_000 + "@", "@a." * 100_000, "a@" * 150_000]:
        P.base_spans(text)
    assert time.monotonic() - began < 10


def test_gradients():
    dice = np.random.default_rng(0)
    network = P.Network.fresh(dice)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    x, y = P.lesson(dice, ["some words and 127.0.0.1 then more of them " * 4], 3)
    _, grads = network.loss(x, y)
    for k, w in network.weights.items():
        at = np.unravel_index(np.abs(grads[k]).argmax(), w.shape)
        w[at] += 1e-4
        high = network.loss(x, y)[0]
        w[at] -= 2e-4
        low = network.loss(x, y)[0]
        w[at] += 1e-4
        assert abs((high - low) / 2e-4 - grads[k][at]) < 1e-3 * max(1, abs(grads[k][at])), k


def test_decoding_finds_the_best_path():
    dice = np.random.default_rng(1)
    network = P.Network.fresh(dice)
    network.weights["from"] = dice.standard_normal((P.TAGS, P.TAGS)).astype(np.float32)
    x = dice.integers(1, P.CLASSES, (5, 3)).astype(np.uint8)
    s = network.scores(network.states(x))
    move, first = network.weights["from"], network.weights["first"]
    for w in range(5):
        paths = {(a, b, c): first[a] + s[0, w, a] + move[a, b] + s[1, w, b] + move[b, c] + s[2, w, c] for a in range(P.TAGS) for b in range(P.TAGS) for c in range(P.TAGS)}
        assert tuple(network.decode(x)[w]) == max(paths, key=paths.get)


def test_windows_cover_every_sign():
    for n in (1, 95, 96, 97, 144, 145, 1000):
        for at in {0, n // 2, n - 1, min(n - 1, 96), max(0, n - 49)}:
            text = "x" * at + "7" + "x" * (n - at - 1)
            starts = P.windows(text)
            assert starts and all(s <= at < s + P.WINDOW for s in starts)
            # a span of up to the overlap is whole in one window
            low, high = max(0, at - P.OVERLAP // 2), min(n, at + P.OVERLAP // 2)
            assert any(s <= low and high <= s + P.WINDOW for s in starts)
    assert P.windows("") == P.windows("words " * 99) == []


def test_cut_proposals_are_joined_or_give_way():
    text = "x" * 240
    tags = np.zeros((3, P.WINDOW), np.uint8)
    tags[0, 90:96] = [1, 2, 2, 2, 2, 2]  # cut by the edge; the next window shows it whole
    tags[1, 42:60] = [1] + [2] * 17
    tags[1, 80:96] = [5] + [6] * 15  # a card that no window shows whole
    tags[2, 0:50] = 6
    tags[2, 32] = 6
    assert P.proposals(text, [0, 48, 96], tags) == [("email", 90, 108), ("card", 96, 146)]


def test_network_adds_what_the_rules_lose(network):
    """Cards, telephone numbers and addresses side by side in unseen texts; numbers that fail their check stay out."""
    dice, hit, total, wrong = np.random.default_rng(77), 0, 0, 0
    for _ in range(200):
        items = []
        while len(items) < 2:
            value, kind = P._item(dice)
            if kind in ("card", "phone", "ip"):
                if kind == "card":
                    value = next(v for c in "0123456789" if P.luhn(P.digits(v := value[:-1] + c)))
                items.append((value, kind))
        text = "Entre nous les onze " + " ".join(v for v, _ in items) + " et puis rien de plus."
        got = {s[:3] for s in P.spans_of([text], network)[0]}
        at = 20
        for value, kind in items:
            total, hit = total + 1, hit + ((kind, at, at + len(value)) in got)
            at += len(value) + 1
        wrong += sum(not any(e <= 20 + len(items[0][0]) or s >= 21 + len(items[0][0]) for _, s, e in [g]) for g in got if g[1:] not in {(s, e) for _, s, e in P.base_spans(text)})
    assert hit >= 0.9 * total and wrong <= 0.02 * total
    for clean in ["Version 2.0 of 2024-05-11 at 12:30, 1,234.50 paid", "token = " + "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e", "order 4929348385146307 is no card", "8" * 40, "no numbers here"]:
        assert P.spans_of([clean], network)[0] == []


def test_masking():
    assert P.masked("mail a@b.cc or +1 1.2.3.4!", [("email", 5, 11, True), ("ip", 18, 25, False)]) == "mail [email] or +1 [ip]!"
    assert P.masked("0123456789", [("ip", 2, 5, True), ("phone", 1, 8, True), ("card", 7, 9, True)]) == "0[phone]9"


def test_odd_rows(spark, odd, nothing, network):
    extra = spark.createDataFrame([(None, "4539578763621486 " * 3000), (77, "x@y.zz \U0001f600 +1 (023) 555-0100"), (78, "1" * 70_000)], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text", "id", "score").unionByName(extra, allowMissingColumns=True).withColumnsRenamed({"score": "pii"})
    rows = P.find(docs, network, mask=True).collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) == {"doc_id", "text", "id", "pii", "pii_", "masked"}
    for r in rows:
        text = r["text"] or ""
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii_"] if s["base"]] == plain_spans(text) if len(text) < 60_000 else True
        assert ("@" not in r["masked"]) and (r["masked"] == text or r["pii_"])
    assert P.find(nothing, network).collect() == []
    assert P.sample(nothing) == []


def test_query_equals_the_rules(spark, sf_dir, documents):
    rows = P.op13_pii_spans(spark, sf_dir).collect()
    texts = dict(documents)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(b[0] == k for b in base) for k in P.KINDS]
        assert r["base_sha256"] == hashlib.sha256(digest(base).encode()).hexdigest()
        found = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert set(base) <= set(found) and len(found) == len(base) + r["n_added"]
        assert found == sorted(found, key=lambda s: (P.KINDS.index(s[0]), s[1]))
