"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits share at least four of
their eight positional bytes, hence at least four of the 56 triples of
positional bytes.  The inverted index lists fingerprints by such triples (single
bytes have 256 lists a position, which grow with the corpus).  A pair's lists are
tallied over the whole index: pairs with fewer than four in common, the
guaranteed minimum, are dropped, the rest is verified bit by bit.

A list that is longer than a few entries doesn't give its pairs.  Its entries are
listed again by a fourth positional byte; who still meets there has reached the
guaranteed minimum, and the list gives a spanning forest of its verified links.
A linked pair is found either way: if one of the lists that it shares is long, it
meets again by a fourth byte, and if none is, the tally reaches the minimum.

Equal fingerprints are one entry of the index.  Components follow from the union
of all links.

Words are runs without ASCII white space of the ASCII-lower-cased text; texts
shorter than a shingle are one shingle; texts without words and nulls have
fingerprint zero and are linked like any other.  Rows without id keep their
component, whose id is the least id in it (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import blank_null, chunks, cut, table, unused
from canopy.llm.components import connected_components

SHINGLE, BITS_APART = 4, 4
SEED = 42
POSITIONS = 8
#: Lists up to this size give their pairs to the tally.
SHORT_LIST = 8
#: Bytes of an index key at most.
KEY_BYTES = 3
#: Rows of one fingerprint that are looked up apart from the others, and the share of all rows from which they are:
#: at most this many fingerprints are that frequent.
HOT_ROWS, HOT_SHARE = 100, 10_000
_LANES = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list[str], size: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        n = len(words)
        if not n:
            continue
        joined = b" ".join(words)
        if n <= size:
            hashes.append(digest(joined, SEED))
            counts[k] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[: n - size]])
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist())]
        counts[k] = n - size + 1
    return majority(np.array(hashes, np.uint64), counts)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of hashes, the bits that more than half of the group set."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    begin = np.cumsum(n) - n
    blocks = -(-n // 255)  # eight counters share one word as long as none passes 255
    first = np.cumsum(blocks) - blocks
    at = np.repeat(begin - 255 * first, blocks) + 255 * np.arange(int(blocks.sum()))
    result = np.zeros(len(some), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, at)
        votes = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (votes * 2 > n[:, None]).astype(np.uint64)
        result |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    out[some] = result
    return out


def add_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """id and ``fp``, the SimHash as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            fp = fingerprints_of(part.column("text").to_pylist(), size)
            yield pa.record_batch([part.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), blank_null(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def near(one: np.ndarray, other: np.ndarray, apart: int = BITS_APART) -> np.ndarray:
    """Verification: few enough different bits."""
    return np.bitwise_count(np.atleast_1d(one ^ other)) <= apart


def forest(members: np.ndarray, apart: int = BITS_APART) -> np.ndarray:
    """Spanning forest (pairs of indices) of the links among distinct fingerprints."""
    open_ = np.arange(len(members))
    edges = []
    while len(open_):
        front, open_ = [int(open_[0])], open_[1:]
        while front and len(open_):
            node = front.pop()
            hit = near(members[open_], members[node], apart)
            reached = open_[hit]
            if len(reached):
                edges.append(np.stack([np.full(len(reached), node), reached], axis=1))
                front += reached.tolist()
                open_ = open_[~hit]
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def _byte(position: int):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _pairs_within(keys: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
    """All pairs of the runs of equal keys that have at most so many entries."""
    starts, sizes = _runs(keys)
    size_at = np.repeat(sizes, sizes)
    within = np.arange(len(keys)) - np.repeat(starts, sizes)
    found = []
    for step in range(1, most):
        i = np.flatnonzero((size_at <= most) & (within + step < size_at))
        found.append(np.stack([values[i], values[i + step]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), values.dtype)


def tallied(postings: DataFrame) -> DataFrame:
    """Rows (key, a, b) of ``postings`` (key, fp): the pairs of short lists (b set), and the entries ``a`` of long ones (b null).

    A task streams its lists in key order; of a long list it holds no more than the batch at hand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        long: int | None = None  # key of the list that is known to be long

        def out(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts, sizes = _runs(keys)
            size_at = np.repeat(sizes, sizes)
            whole = (size_at > SHORT_LIST) | (keys == long if long is not None else False)
            pairs = _pairs_within(keys[~whole], fps[~whole], SHORT_LIST)
            if len(pairs):
                yield pa.record_batch([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["key", "a", "b"])
            if whole.any():
                yield pa.record_batch([pa.array(keys[whole]), pa.array(fps[whole]), pa.nulls(int(whole.sum()), pa.int64())], ["key", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([held_k, batch.column("key").to_numpy()])
            fps = np.concatenate([held_f, batch.column("fp").to_numpy()])
            last = int(np.searchsorted(keys, keys[-1]))  # the last list may go on
            if len(keys) - last > SHORT_LIST or keys[-1] == long:
                yield from out(keys, fps)
                long, last = int(keys[-1]), len(keys)
            else:
                yield from out(keys[:last], fps[:last])
            held_k, held_f = keys[last:], fps[last:]
        yield from out(held_k, held_f)

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, a bigint, b bigint")


def _forests(postings: DataFrame, apart: int) -> DataFrame:
    """Links (a, b) that span each list of ``postings`` (key, fp); a task holds one list, of 16 bytes an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _lists(batches):
            keys, fps = rows.column("key").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
            pairs = _pairs_within(keys, fps, SHORT_LIST)
            found = [pairs[near(pairs[:, 0], pairs[:, 1], apart)]] if len(pairs) else []
            for start, many in zip(*_runs(keys)):
                if many > SHORT_LIST:
                    members = np.unique(fps[start : start + many])
                    found.append(members[forest(members, apart)])
            if found:
                links_ = np.concatenate(found).view(np.int64)
                yield pa.record_batch([pa.array(links_[:, 0].copy()), pa.array(links_[:, 1].copy())], ["a", "b"])

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def links(nodes: DataFrame, apart: int = BITS_APART) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join all that are ``apart`` bits or fewer apart.

    ``apart`` is at most six.
    """
    share = POSITIONS - apart  # equal positional bytes of a linked pair at least
    width = min(KEY_BYTES, share - 1)
    least = comb(share, width)  # lists that such a pair has in common at least
    lists = list(combinations(range(POSITIONS), width))

    def key(number: int, places: tuple[int, ...]) -> Column:
        made = F.lit(number).cast("long")
        for k in places:
            made = F.shiftleft(made, 8).bitwiseOR(_byte(k))
        return made

    found = cut(tallied(nodes.select(F.explode(F.array(*[key(n, p) for n, p in enumerate(lists)])).alias("key"), "fp")))
    pairs = found.where("key is null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    counted = pairs.where((F.col("n") >= least) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= apart)).select("a", "b")
    # entries of long lists by one more byte: one row for each set of places that a long list of the entry is part of
    long = found.where("key is not null").groupBy(F.col("a").alias("fp")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftright(key, {8 * width}) as int)))").alias("long"))
    finer = []
    for number, places in enumerate(combinations(range(POSITIONS), width + 1)):
        parts = sum(1 << lists.index(p) for p in combinations(places, width))
        finer.append(F.when(F.col("long").bitwiseAND(F.lit(parts).cast("long")) != 0, key(number, places)))
    return counted.union(_forests(long.select(F.explode(F.array_compact(F.array(*finer))).alias("key"), "fp"), apart))


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, apart: int = BITS_APART) -> DataFrame:
    """id, fp and component_id of every row.

    Fingerprints of very many rows, of which there are at most ``HOT_SHARE``, are
    looked up by a broadcast and not by a shuffle of their rows.
    """
    fps = cut(add_fingerprint(docs, id_col, text_col, size))
    nodes = cut(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("rows")))
    parts = connected_components(links(nodes.select("fp"), apart)).withColumnRenamed("node", "fp")
    named = parts.join(nodes, "fp")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = parts.join(ids, "component").select("fp", "component_id")
    every = cut(nodes.join(linked, "fp", "left").select("fp", "rows", F.coalesce("component_id", "least").alias("component_id")))
    hot_from = max(HOT_ROWS, -(-fps.count() // HOT_SHARE))
    hot = every.where(F.col("rows") > hot_from).select("fp", "component_id")
    often = fps.join(F.broadcast(hot), "fp").select(id_col, "fp", "component_id")
    rest = fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(every.where(F.col("rows") <= hot_from), "fp").select(id_col, "fp", "component_id")
    return often.union(rest)


WIDE_SHINGLE = 5
#: Near copies have at least NEAR / WHOLE of the shingles of both in common: 4 / 5.
NEAR, WHOLE = 4, 5
#: Texts that tell which shingles are frequent, the texts of these that have such a one, and the shingles known as such.
#: They only order the shingles, so that no result depends on them.
SAMPLE, FREQUENT, KNOWN = 20_000, 4, 200_000
#: Words of the wide SimHash of longer sets, and how many of its bits may differ: two sets that have just 4/5 in common
#: differ in 155 of 1024 on the mean, with a deviation of 11.  Shorter sets are compared exactly.
WIDE, WIDE_APART, WIDE_FROM = 16, 195, 32
#: A long list joins its closest members first.
LEVELS = (WIDE_APART - 60, WIDE_APART - 30, WIDE_APART)
#: So few nodes are sent to all executors to look up their texts.
SENT_NODES = 100_000


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct five-word shingles as ascending hashes, and the text of each; a shorter text is one shingle."""
    import xxhash

    seen: dict[bytes, int] = {}
    index: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() or [b""]
        index += [seen.setdefault(w, len(seen)) for w in words]
        counts[k] = len(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))[np.array(index, np.int64)]
    doc = np.repeat(np.arange(len(texts)), counts)
    # a shingle's hash, at its first word; a shorter text is one shingle from its first word on
    size = np.minimum(counts, WIDE_SHINGLE)
    first = np.cumsum(counts) - counts
    at = np.arange(len(doc))
    begins = at - first[doc] <= (counts - size)[doc]
    rolled = np.zeros(len(doc), np.uint64)
    for k in range(WIDE_SHINGLE):
        there = np.minimum(at + k, len(doc) - 1) if len(doc) else at
        value = np.where(k < size[doc], hashes[there], np.uint64(0))
        rolled = (rolled ^ value) * np.uint64(0x9FB21C651E98DF25)
        rolled ^= rolled >> np.uint64(32)
    doc, rolled = doc[begins], rolled[begins]
    order = np.lexsort((rolled, doc))
    doc, rolled = doc[order], rolled[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])
    return rolled[new], doc[new]


def prefixes(hashes: np.ndarray, doc: np.ndarray, texts: int, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each set the shingles that are indexed: key, text, size of the set and place, in one order for all sets.

    Of two sets in the same order that have 4/5 of their union in common, the
    first n // 5 + 1 shingles have one in common.  Frequent shingles come last.
    """
    late = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes if len(frequent) else np.zeros(len(hashes), bool)
    order = np.lexsort((hashes, late, doc))
    hashes, doc = hashes[order], doc[order]
    counts = np.bincount(doc, minlength=texts)
    place = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
    size = counts[doc]
    some = place < size * (WHOLE - NEAR) // WHOLE + 1
    return hashes[some], doc[some], size[some], place[some]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole posting lists of batches in key order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))  # the last list may go on
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif held and held[-1].column("key")[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))


def _possible(size: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets whose first common shingle is at these places can have 4/5 of their union in common."""
    most = np.minimum(size[i] - place[i], size[j] - place[j])
    return (NEAR + WHOLE) * most >= NEAR * (size[i] + size[j])


def first_pairs(postings: DataFrame) -> DataFrame:
    """Rows (key, a, b, place) of ``postings`` (key, node, size, place, component).

    They are all pairs of nodes of different components within short lists (key null), and the
    members ``a`` of long lists of several components.  A null component is that of the node alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _lists(batches):
            key, node, size, place = (rows.column(n).to_numpy() for n in ("key", "node", "size", "place"))
            component = pc.coalesce(rows.column("component"), rows.column("node")).to_numpy()
            new = np.ones(len(key), bool)  # equal texts of several tasks
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, size, place, component = key[new], node[new], size[new], place[new], component[new]
            starts, sizes = _runs(key)
            pairs = _pairs_within(key, np.arange(len(key)), SHORT_LIST)
            pairs = pairs[component[pairs[:, 0]] != component[pairs[:, 1]]]
            pairs = pairs[_possible(size, place, pairs[:, 0], pairs[:, 1])]
            made = np.unique(node[pairs], axis=0) if len(pairs) else pairs
            if len(made):
                none = pa.nulls(len(made), pa.int64())
                yield pa.record_batch([none, pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy()), none], names)
            several = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
            long = np.repeat((sizes > SHORT_LIST) & several, sizes)
            if long.any():
                yield pa.record_batch([pa.array(key[long]), pa.array(node[long]), pa.nulls(int(long.sum()), pa.int64()), pa.array(place[long])], names)

    names = ["key", "a", "b", "place"]
    tasks = 4 * int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # an index is larger than its rows
    return postings.repartition(tasks, "key").sortWithinPartitions("key", "node").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


class _Members:
    """The members of one long list: sizes, wide SimHashes and short sets."""

    def __init__(self, size: np.ndarray, place: np.ndarray, words: np.ndarray, sets: pa.ListArray):
        self.size, self.left, self.words = size, size - place, words
        held = [np.array(x.values) if x.is_valid else None for x in sets]
        length = np.array([0 if x is None else len(x) for x in held])
        flat = np.concatenate([x for x in held if x is not None]) if length.any() else np.zeros(0, np.int64)
        self.shingle = np.unique(flat, return_inverse=True)[1]
        self.owner, self.ends = np.repeat(np.arange(len(held)), length), np.concatenate([[0], np.cumsum(length)])
        self.mark = np.zeros(len(self.shingle), bool)

    def central(self) -> np.ndarray:
        """All members, those next to the bits that most members set first."""
        bits = np.unpackbits(np.ascontiguousarray(self.words).view(np.uint8).reshape(len(self.size), -1), axis=1)
        middle = np.packbits(bits.mean(axis=0) > 0.5).view(np.uint64)
        return np.argsort(np.bitwise_count(self.words ^ middle).sum(axis=1), kind="stable")

    def alike(self, at: int, others: np.ndarray, apart: int) -> np.ndarray:
        """Which of the ``others`` may be near copies of ``at``: told exactly if one set is short, by the wide SimHash otherwise."""
        low, high = np.minimum(self.size[others], self.size[at]), np.maximum(self.size[others], self.size[at])
        # the list of their first common shingle lets a near copy through
        ok = (WHOLE * low >= NEAR * high) & ((NEAR + WHOLE) * np.minimum(self.left[others], self.left[at]) >= NEAR * (low + high))
        short = ok & (low < WIDE_FROM)
        if short.any():
            own = self.shingle[self.ends[at] : self.ends[at + 1]]
            self.mark[own] = True
            common = np.bincount(self.owner, self.mark[self.shingle], len(self.size))[others]
            self.mark[own] = False
            ok &= ~short | ((NEAR + WHOLE) * common >= NEAR * (low + high))
        wide = np.flatnonzero(ok & ~short)
        ok[wide] = np.bitwise_count(self.words[others[wide]] ^ self.words[at]).sum(axis=1) <= apart
        return ok

    def forest(self, component: np.ndarray) -> tuple[list[int], list[int]]:
        """Pairs of alike members that span what isn't in one component yet, the closest joined first."""
        left, right = [], []
        label = np.unique(component, return_inverse=True)[1]
        order = self.central()
        for apart in LEVELS:
            open_ = order
            while len(open_):
                front, open_ = [int(open_[0])], open_[1:]
                while front and len(open_):
                    at = front.pop()
                    hit = self.alike(at, open_, apart)
                    reached = open_[hit]
                    front += reached.tolist()
                    open_ = open_[~hit]
                    others, first = np.unique(label[reached], return_index=True)
                    new = others != label[at]
                    if new.any():
                        left += [at] * int(new.sum())
                        right += reached[first[new]].tolist()
                        label[np.isin(label, others[new])] = label[at]
        return left, right

    def between(self, component: np.ndarray) -> tuple[list[int], list[int]]:
        """All alike pairs of different components."""
        left, right = [], []
        for at in range(len(self.size)):
            others = at + 1 + np.flatnonzero(component[at + 1 :] != component[at])
            hit = others[self.alike(at, others, WIDE_APART)]
            left += [at] * len(hit)
            right += hit.tolist()
        return left, right


def long_list_pairs(members: DataFrame, spanning: bool) -> DataFrame:
    """Pairs (a, b) of nodes that may be near copies, from long lists of ``members`` (key, node, place, component, size, w0.., shingles).

    A list gives a spanning forest of its alike members over the components that are
    known (``spanning``), or all alike pairs that are in no component together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _lists(batches):
            key, node, place, component, size = (rows.column(n).to_numpy() for n in ("key", "node", "place", "component", "size"))
            words = np.stack([rows.column(f"w{k}").to_numpy() for k in range(WIDE)], axis=1).view(np.uint64)
            column = rows.column("shingles").combine_chunks()
            for start, many in zip(*_runs(key)):
                part = slice(start, start + many)
                if (component[part] == component[start]).all():
                    continue
                some = _Members(size[part], place[part], words[part], column.slice(start, many))
                left, right = some.forest(component[part]) if spanning else some.between(component[part])
                if left:
                    a, b = node[part][left], node[part][right]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return members.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ``texts`` (node, text) have 4/5 of their shingles in common, counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text_a"):
            (of_a, row_a), (of_b, row_b) = (shingle_sets(part.column(n).to_pylist()) for n in ("text_a", "text_b"))
            shingle, row = np.concatenate([of_a, of_b]), np.concatenate([row_a, row_b])
            order = np.lexsort((shingle, row))
            shingle, row = shingle[order], row[order]
            twice = (row[1:] == row[:-1]) & (shingle[1:] == shingle[:-1])
            common = np.bincount(row[1:][twice], minlength=part.num_rows)
            near = (NEAR + WHOLE) * common >= NEAR * np.bincount(row, minlength=part.num_rows)
            yield part.select(["a", "b"]).filter(pa.array(near))

    def side(end: str) -> DataFrame:
        ends = cut(pairs.select(F.col(end).alias("node")).distinct())
        wanted = F.broadcast(ends) if ends.count() <= SENT_NODES else ends
        found = texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
        return found.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))

    # texts take less room in a shuffle than their shingles
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def wide_fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The SimHash words of consecutive sets of shingle hashes, one row a set."""
    words = []
    for k in range(WIDE):
        mixed = (hashes + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        words.append(majority(mixed ^ (mixed >> np.uint64(29)), counts))
    return np.stack(words, axis=1)


_MARK = ["size", *(f"w{k}" for k in range(WIDE))]


def marks(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, size, w0.., shingles) of the ``nodes`` (node): size and wide SimHash of the shingle set, and a short set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            hashes, doc = shingle_sets(part.column("text").to_pylist())
            counts = np.bincount(doc, minlength=part.num_rows)
            words = np.ascontiguousarray(wide_fingerprints(hashes, counts).view(np.int64).T)
            ends = np.concatenate([[0], np.cumsum(counts)])
            short = counts < WIDE_FROM * WHOLE // NEAR + 1  # whatever a set below ``WIDE_FROM`` can be a near copy of
            sets = pa.array([hashes[a:b].view(np.int64) if s else None for a, b, s in zip(ends, ends[1:], short)], pa.list_(pa.int64()))
            yield pa.record_batch([part.column("node"), pa.array(counts), *map(pa.array, words), sets], ["node", *_MARK, "shingles"])

    made = texts.join(nodes, "node", "left_semi").mapInArrow(run, ", ".join(f"{n} bigint" for n in ("node", *_MARK)) + ", shingles array<bigint>")
    return cut(made.groupBy("node").agg(*[F.first(c).alias(c) for c in (*_MARK, "shingles")]))


def likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of short sets that have 4/5 in common, and of longer ones whose wide SimHashes differ in few bits."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = marks(texts, ends)
    side = lambda end: found.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in (*_MARK, "shingles")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.lit(0)
    for n in _MARK[1:]:
        apart = apart + F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}")))
    low, sizes = F.least("a_size", "b_size"), F.col("a_size") + F.col("b_size")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    fits = F.when(low < WIDE_FROM, (NEAR + WHOLE) * common >= NEAR * sizes).otherwise(apart <= WIDE_APART)
    return both.where((WHOLE * low >= NEAR * (sizes - low)) & fits).select("a", "b")


def frequent_shingles(texts: DataFrame, count: int) -> np.ndarray:
    """Shingles that several texts of a sample have, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield pa.record_batch([pa.array(shingle_sets(part.column("text").to_pylist())[0].view(np.int64))], ["shingle"])

    share = max(1, count // SAMPLE)
    counted = texts.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).select("text").mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n"))
    often = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n")).limit(KNOWN).select("shingle")
    return np.sort(np.array([r["shingle"] for r in often.collect()], np.int64).view(np.uint64))


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``texts`` (node, text) by the inverted index of their SimHashes' positional bytes and its count filter.

    Texts of one fingerprint are paired with the least of them, and linked fingerprints by their least texts.
    """
    prints = cut(add_fingerprint(texts, "node").groupBy("node").agg(F.first("fp").alias("fp")))
    entries = cut(prints.groupBy("fp").agg(F.min("node").alias("least")))
    same = prints.join(entries, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    end = lambda name: entries.select(F.col("fp").alias(name), F.col("least").alias(f"_{name}"))
    linked = links(entries.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return same.union(linked).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copy_links(texts: DataFrame, count: int) -> DataFrame:
    """Edges (a, b) that join the ``texts`` (node, text; ``count`` nodes) with a shingle similarity of 0.8 or more.

    First come the pairs of the byte-position index, compared by their shingles.  The
    index of shingles then joins what these links leave apart: near copies whose
    SimHashes differ in more bits than that index reaches.
    """
    close = cut(verified(cut(fingerprint_pairs(texts)), texts))
    joined = cut(connected_components(close))
    frequent = frequent_shingles(texts, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in chunks(batches, "text"):
            nodes, component = part.column("node").to_numpy(), part.column("component")
            new = [k for k, n in enumerate(nodes.tolist()) if not (n in seen or seen.add(n))]  # equal texts once a task
            some, nodes = part.column("text").take(pa.array(new, pa.int64())), nodes[new]
            hashes, doc = shingle_sets(some.to_pylist())
            key, doc, size, place = prefixes(hashes, doc, len(new), frequent)
            known = component.take(pa.array(new, pa.int64())).take(pa.array(doc))
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(nodes[doc]), pa.array(size), pa.array(place), known], ["key", "node", "size", "place", "component"])

    def placed(rows: DataFrame, parts: DataFrame, node: str, name: str) -> DataFrame:
        known = parts.select(F.col("node").alias(node), F.col("component").alias(name))
        return rows.join(known, node, "left").withColumn(name, F.coalesce(name, node))

    # lists of one component give nothing, so that a group of near copies costs no more than its postings
    of = texts.join(F.broadcast(joined) if joined.count() <= SENT_NODES else joined, "node", "left").select("node", "text", "component")
    made = cut(first_pairs(of.mapInArrow(run, "key bigint, node bigint, size bigint, place bigint, component bigint")))
    long = made.where("key is not null").select("key", F.col("a").alias("node"), "place")
    marked = cut(placed(long.join(marks(texts, long.select("node").distinct()), "node"), joined, "node", "component"))
    pairs = likely(cut(made.where("key is null").select("a", "b").distinct()), texts)
    first = cut(pairs.union(long_list_pairs(marked, True)).distinct())
    edges = cut(close.union(verified(first, texts)))
    if marked.isEmpty():
        return edges
    named = placed(marked.drop("component"), connected_components(edges), "node", "component")
    more = cut(long_list_pairs(named, False).distinct().join(first, ["a", "b"], "left_anti"))
    return edges if more.isEmpty() else edges.union(verified(more, texts))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row of the least id stays.

    Near copies have five-word shingles of a Jaccard similarity of 0.8 or more,
    whatever the edit was.  Candidates come from the byte-position index of op1 first
    (``fingerprint_pairs``).  But two such texts share 27 % of the bytes of a SimHash
    on the mean, too few for that index to reach all, so others come from the shingles:
    those of every text are put into one order, frequent ones last, and the first
    n // 5 + 1 of n are indexed, of which two near copies always have one in
    common.  Candidates of which neither is short go on if their wide SimHashes
    differ in at most ``WIDE_APART`` of 1024 bits, and what is left is compared by
    the shingles themselves.  A long
    posting list gives a spanning forest of its candidates, and then those that no
    chain of near copies joins yet.  Of rows of equal id and text one stays, of
    equal ids with other texts that of the group's kept text; rows without id are
    kept.  Texts without words are copies of each other.
    """
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), blank_null(text_col).alias("text"))
    texts = named.select(F.xxhash64("text").alias("node"), "text")
    rows = named.groupBy(F.xxhash64("text").alias("node"), "id").agg(F.count("*").alias("times"))
    nodes = cut(rows.groupBy("node").agg(F.min(F.struct("id", "times")).alias("least")))
    parts = connected_components(near_copy_links(texts, nodes.count()))
    # the least id of every group, and of every text that has no links; of several texts of that id the least
    groups = nodes.join(parts, "node", "left").select("least", "node", F.coalesce("component", "node").alias("component"))
    of, by, node, times = (unused(docs, n) for n in ("_of", "_keep", "_node", "_times"))
    first = groups.groupBy("component").agg(F.min(F.struct("least.id", "node", "least.times")).alias("k"))
    keep = cut(first.select(F.col("k.id").alias(by), F.col("k.node").alias(node), F.col("k.times").alias(times)))
    kept = docs.withColumn(of, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(keep, (F.col(id_col) == F.col(by)) & (F.col(of) == F.col(node)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # of rows of equal id and text that whose columns have the least hash
    several = kept.where(F.col(times) > 1).groupBy(by, node).agg(F.min_by(row, F.xxhash64(row)).alias(of))
    once = kept.where(F.col(times) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return once.unionByName(several.select(f"{of}.*")).unionByName(docs.where(F.col(id_col).isNull()))


def op1_simhash_groups(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicate_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
