"""SimHash groups against brute force over all pairs."""

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from canopy.llm import simhash


def fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps: dict) -> dict:
    up = {k: k for k in fps}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {k: top(k) for k in fps}


def test_query_equals_brute_force(spark, sf_dir, documents):
    fps = {i: fingerprint(t) for i, t in documents}
    want = groups(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op1_simhash_groups(spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert max(Counter(want.values()).values()) > 1


def test_index_misses_no_link(spark):
    """Chains of fingerprints four bits apart, dense clusters, and noise, against all pairs."""
    random = np.random.default_rng(1)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        one = int(random.integers(0, 2**63))
        for _ in range(int(random.integers(1, 12))):
            fps.add(one)
            for bit in random.choice(64, int(random.integers(1, 6)), replace=False):
                one ^= 1 << int(bit)
    fps |= {0xABCDEF << 20 | int(x) for x in random.integers(0, 1 << 16, 100)}
    by_id = dict(enumerate(sorted(fps)))
    want = groups(by_id)
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in by_id.values()], "fp bigint")
    from canopy.llm.components import connected_components

    parts = {r["node"]: r["component"] for r in connected_components(simhash.links(nodes)).collect()}
    signed = {i: f - 2**64 if f >= 2**63 else f for i, f in by_id.items()}
    got = Counter(frozenset(i for i in signed if parts.get(signed[i], ("alone", i)) == c) for c in {parts.get(signed[i], ("alone", i)) for i in signed})
    assert got == Counter(frozenset(i for i in want if want[i] == c) for c in set(want.values()))


def test_odd_rows(odd, nothing):
    rows = simhash.near_duplicate_components(odd).collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == 0
    assert {by[k]["component_id"] for k in (1, 2, 3)} == {1}
    assert {by[k]["component_id"] for k in (4, 5, 9)} == {4}
    assert simhash.near_duplicate_components(nothing).collect() == []


def test_kept_rows_are_rows(spark):
    """Which row stays is told by id and text together, and repeated rows stay once."""
    text = " ".join(f"w{i}" for i in range(20))
    other = " ".join(f"v{i}" for i in range(20))
    rows = [(0, text, "x"), (1, text, "x"), (1, other, "y"), (7, "c d", "b"), (7, "c d", "a"), (7, "c d", "a")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, _keep string").withColumn("_of", F.lit(1))
    kept = simhash.drop_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(0, text), (1, other), (7, "c d")]


def test_tally_needs_the_guaranteed_minimum(spark):
    """Three shared bytes give a pair one list, four give four of them; only the latter is a candidate, in lists of any length."""
    base = 0x0102030405060708
    far = [base ^ (0xFF << 8 * k) ^ (0xFF << 8 * j) ^ (0xFF << 8 * i) ^ (0xFF << 8 * m) ^ (0xFF << 8 * n) for k, j, i, m, n in ((0, 1, 2, 3, 4), (3, 4, 5, 6, 7))]
    near_ = [base ^ 1 ^ (1 << 8) ^ (1 << 16) ^ (1 << 24)]
    crowd = [base ^ (x << 32) for x in range(1, 40)]  # they share six bytes: long lists
    for some in (far + near_, far + near_ + crowd):
        nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in [base, *some]], "fp bigint")
        found = {frozenset(r) for r in simhash.links(nodes).collect()}
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in found)
        assert any(base in pair for pair in found)
        assert not any(f - 2**64 in pair or f in pair for f in far for pair in found)


def similarity(a: str, b: str) -> float:
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_near_copies_go_and_others_stay(spark):
    """Near copies of at least 0.8 over five-word shingles go; texts below 0.5 stay."""
    random = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(60):
        words = [vocabulary[k] for k in random.integers(0, 3000, int(random.integers(80, 400)))]
        rows.append((10 * g, " ".join(words)))
        copy = list(words)
        copy[len(copy) // 2] = "changed"
        if similarity(" ".join(words), " ".join(copy)) >= 0.8:
            rows.append((10 * g + 1, " ".join(copy)))
        half = words[: len(words) // 2] + [vocabulary[k] for k in random.integers(0, 3000, len(words) // 2)]
        rows.append((10 * g + 2, " ".join(half)))
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {i for i, _ in rows if i % 10 != 1}


def test_near_copies_odd_rows(odd, nothing):
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert simhash.drop_near_copies(nothing).collect() == []


def edited(words: list[str], other: list[str], shape: str, least: float) -> str:
    """The most edited copy of the given shape that is still ``least`` alike."""
    text, best = " ".join(words), None
    for n in range(1, len(words) // 3):
        at = len(words) // 3
        copy = {
            "appended": words + other[:n],
            "cut": words[: len(words) - n],
            "replaced": words[:at] + other[:n] + words[at + n :],
            "scattered": [other[k] if k % (len(words) // n + 1) == 5 else w for k, w in enumerate(words)],
        }[shape]
        if similarity(text, " ".join(copy)) < least:
            break
        best = " ".join(copy)
    return best


def test_near_copies_of_any_edit_go(spark):
    """Passages appended, cut and replaced, and scattered words, from 0.80 to 0.90: no copy is missed."""
    random = np.random.default_rng(6)
    draw = lambda n: [f"w{k}" for k in np.minimum(random.zipf(1.3, n), 20_000)]
    rows = []
    for g in range(96):
        words, other = draw(int(random.integers(100, 700))), draw(700)
        shape = ("appended", "cut", "replaced", "scattered")[g % 4]
        copy = edited(words, other, shape, (0.8, 0.83, 0.87, 0.9)[g // 4 % 4])
        if copy is None:
            continue
        rows += [(10 * g, " ".join(words)), (10 * g + 1, copy)]
    assert len(rows) > 150
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {i for i, _ in rows if i % 10 == 0}


def test_long_lists_of_near_copies(spark):
    """Texts of one template, chains of near copies and unlike ones, against all pairs."""
    random = np.random.default_rng(7)
    base = [f"b{k}" for k in range(60)]
    texts = {}
    for i in range(150):
        words = list(base)
        at = int(random.integers(0, 50))
        words[at : at + int(random.integers(0, 9))] = [f"x{i}_{k}" for k in range(int(random.integers(0, 9)))]
        texts[i] = " ".join(words)
    up = {i: i for i in texts}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in texts:
        for b in range(a):
            if similarity(texts[a], texts[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert kept == {top(i) for i in texts} and 1 < len(kept) < 150


def test_index_covers_every_near_copy():
    """Two sets of 4/5 always share an indexed shingle that their sizes and places let through, whichever are frequent."""
    random = np.random.default_rng(8)
    for _ in range(300):
        common = int(random.integers(1, 300))
        extra = common // 4  # as many as 4/5 allows
        left = int(random.integers(0, extra + 1))
        pool = np.unique(random.integers(0, 2**63, common + extra, dtype=np.uint64))
        random.shuffle(pool)
        one, other = pool[: common + left], np.concatenate([pool[:common], pool[common + left :]])
        frequent = np.sort(random.choice(pool, int(random.integers(0, len(pool) + 1)), replace=False))
        sets = [np.sort(one), np.sort(other)]
        key, doc, size, place = simhash.prefixes(np.concatenate(sets), np.repeat([0, 1], [len(one), len(other)]), 2, frequent)
        shared, i, j = np.intersect1d(np.where(doc == 0, key, 0), np.where(doc == 1, key, 0), return_indices=True)
        real = shared > 0
        assert real.any() and simhash._possible(size, place, i[real], j[real]).any()


def test_long_lists_are_listed_once_by_four_bytes(spark, monkeypatch):
    """However many of a fingerprint's lists are long, it has one row for each four of its bytes, and no link is lost."""
    base = 0x0102030405060708
    crowd = [base ^ (x % 20 << 8 * (x // 20)) for x in range(160) if x % 20 or not x]
    held = []
    monkeypatch.setattr(simhash, "_forests", lambda postings, apart, real=simhash._forests: held.append(postings) or real(postings, apart))
    nodes = spark.createDataFrame([(x,) for x in crowd], "fp bigint")
    linked = {frozenset(r) for r in simhash.links(nodes).collect()}
    rows = [tuple(r) for r in held[0].select("key", "fp").collect()]
    assert len(rows) == len(set(rows)) <= 70 * len(crowd)
    group = {base}
    while more := {x for pair in linked if pair & group for x in pair} - group:
        group |= more
    assert group == set(crowd)


def test_stage_goes_through_the_byte_index(spark, monkeypatch):
    """Copies within four bits go by the byte-position index alone, and pairs that are near by bits only stay."""
    random = np.random.default_rng(9)
    rows = []
    for g in range(40):
        words = [f"w{k}" for k in random.integers(0, 3000, 400)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join([*words[:-1], "changed"]))]
    fps = {i: fingerprint(t) for i, t in rows}
    within = {i for i in fps if i % 10 and (fps[i] ^ fps[i - 1]).bit_count() <= 4}
    assert len(within) > 20
    monkeypatch.setattr(simhash, "first_pairs", lambda postings: spark.createDataFrame([], "key bigint, a bigint, b bigint, place bigint"))
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == set(fps) - within


def test_lists_of_one_component_give_nothing(spark):
    """Lists whose nodes are joined already give neither pairs nor members; others give all that isn't joined."""
    rows = [(1, n, 50, 0, 1) for n in (1, 2, 3)]
    rows += [(2, n, 50, 0, 10) for n in range(10, 30)]
    rows += [(3, 40, 50, 0, 40), (3, 41, 50, 0, 40), (3, 42, 50, 0, None)]
    rows += [(4, n, 50, 0, 50) for n in range(50, 62)] + [(4, 62, 50, 0, None)]
    postings = spark.createDataFrame(rows, "key bigint, node bigint, size bigint, place bigint, component bigint")
    got = [tuple(r)[:3] for r in simhash.first_pairs(postings).collect()]
    assert sorted(got, key=str) == sorted([(None, 40, 42), (None, 41, 42), *((4, n, None) for n in range(50, 63))], key=str)


def test_groups_of_near_copies_give_no_rows_of_their_lists(spark, monkeypatch):
    """Texts that the byte-position index joins aren't listed again by all their shingles, and one of each group stays."""
    random = np.random.default_rng(11)
    rows = []
    for g in range(12):
        words = [f"g{g}w{k}" for k in random.integers(0, 3000, 600)]
        rows += [(100 * g + k, " ".join([*words, f"copy{k}"])) for k in range(5 if g % 2 else 15)]
    held = []
    monkeypatch.setattr(simhash, "first_pairs", lambda postings, real=simhash.first_pairs: held.append(real(postings)) or held[-1])
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {100 * g for g in range(12)}
    assert held[0].count() < len(rows)
