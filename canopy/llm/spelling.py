"""Spelling variants: words that are one edit apart, by a forward and a backward automaton.

One edit leaves one half of a word as it is.  Words are sorted and cut into shards;
a task builds the minimal acyclic automaton of each shard from its ascending words,
and numbers its words by perfect hashing (a state knows how many words it accepts, so
the edges of a path add up to the word's place).  A word is looked up in all shards
that hold its first half as a prefix: the half is followed exactly, the rest with one
error.  The same is done with reversed words for the second half.  A pair whose first
halves are equal belongs to the forward search alone, so no pair comes twice.

A shard is a slice of the sorted words, hence a prefix that very many words share is
spread over many shards; none is gathered in one task.

Null texts have no words, a null id is written as nothing before the colon, equal rows
count as often as they occur, a table without words gives no rows, and columns other
than ``doc_id`` and ``text`` are left alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import cut, release, table

#: A run of letters; words shorter than the least length can't come from shorter runs, so only runs of that length are taken.
LETTERS, SHORTEST, OFTEN = "[A-Za-z\\u00C0-\\u00FF]", 6, 5
#: Every so many hashes a run loses a code point.
DAMAGE = 199
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: Words of a shard on the mean: what a task holds as one automaton.  Their first words (one of so many) are known to all tasks.
SHARD = 10_000


class Automaton:
    """The minimal acyclic automaton of ascending distinct words, each with its place in that order."""

    def __init__(self, words: Iterable[str]):
        #: By state: label to (next state, accepted words before those of this edge); whether a word ends; words accepted.
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.ends: list[bool] = []
        self.accepts: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # the states of the last word, which may still get edges
        last = ""

        def fold(depth: int) -> None:
            while len(path) > depth + 1:
                end, out = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(known, end, out)))

        for word in words:
            same, most = 0, min(len(last), len(word))
            while same < most and last[same] == word[same]:
                same += 1
            fold(same)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        fold(0)
        self.root = self._state(known, *path[0])

    def _state(self, known: dict[tuple, int], end: bool, out: list[tuple[str, int]]) -> int:
        """The one state of this behaviour."""
        key = (end, tuple(out))
        if key not in known:
            known[key] = len(self.edges)
            before, edges = int(end), {}
            for label, to in out:
                edges[label] = (to, before)
                before += self.accepts[to]
            self.edges.append(edges)
            self.ends.append(end)
            self.accepts.append(before)
        return known[key]

    def _rest(self, word: str, at: int, state: int, place: int) -> int:
        """Place of the word that continues exactly with ``word[at:]``, or -1."""
        edges = self.edges
        for i in range(at, len(word)):
            step = edges[state].get(word[i])
            if step is None:
                return -1
            state, place = step[0], place + step[1]
        return place if self.ends[state] else -1

    def place(self, word: str) -> int:
        return self._rest(word, 0, self.root, 0)

    def one_error(self, word: str, exact: int) -> list[int]:
        """Places of the words one edit from ``word`` whose first ``exact`` code points are its own, each once."""
        edges, state, place, n, found = self.edges, self.root, 0, len(word), []
        for c in word[:exact]:
            step = edges[state].get(c)
            if step is None:
                return found
            state, place = step[0], place + step[1]
        for i in range(exact, n + 1):
            c = word[i] if i < n else None
            for label, (to, more) in edges[state].items():
                if label != c:  # the same letter can as well be put in behind it
                    found.append(self._rest(word, i, to, place + more))
                    if c is not None:
                        found.append(self._rest(word, i + 1, to, place + more))
            if c is None:
                break
            if i + 1 == n or word[i + 1] != c:  # of a run of letters the last is taken out
                found.append(self._rest(word, i + 1, state, place))
            step = edges[state].get(c)
            if step is None:
                break
            state, place = step[0], place + step[1]
        return [x for x in found if x >= 0]


def words_of(docs: DataFrame) -> DataFrame:
    """Rows (word, n): the damaged runs of letters of all texts with at least ``SHORTEST`` code points and ``OFTEN`` occurrences."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{SHORTEST},}})"), F.lit(1)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    low = runs.select("id", F.translate("run", upper, upper.lower()).alias("low"))
    hashed = low.select("low", F.crc32(F.concat_ws(":", "id", "low")).alias("h"))
    at = (F.col("h") % F.char_length("low")).cast("int")
    short = F.concat(F.substr("low", F.lit(1), at), F.substr("low", at + 2))
    word = F.when(F.col("h") % DAMAGE == 0, short).otherwise(F.col("low"))
    return hashed.select(word.alias("word")).where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


def _bounds(words: DataFrame, key, shards: int) -> list[str]:
    """First words of all shards but the first, ascending."""
    if shards < 2:
        return []
    dealt = words.select(key.alias("key")).repartitionByRange(shards, "key")
    firsts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    return sorted(r["key"] for r in firsts.collect())[1:]


def _route(bounds: tuple[list[str], list[str]]):
    """Each word once as part of its own shard, and as a question to every shard that may hold its half."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways, shards, asks, keys, ns = [], [], [], [], []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for way, (firsts, key) in enumerate(zip(bounds, (word, word[::-1]), strict=True)):
                    half = key[: _exact(way, len(key))]
                    low, high = bisect_right(firsts, half), bisect_left(firsts, half + "\U0010ffff")
                    own = bisect_right(firsts, key)
                    for shard, ask in [(own, False), *((s, True) for s in range(low, high + 1))]:
                        ways.append(way)
                        shards.append(shard)
                        asks.append(ask)
                        keys.append(key)
                        ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ways, pa.int32()), pa.array(shards, pa.int32()), pa.array(asks, pa.bool_()), pa.array(keys, pa.string()), pa.array(ns, pa.int64())], ["way", "shard", "ask", "key", "n"])

    return rows


def _exact(way: int, length: int) -> int:
    """Code points of the half that is matched exactly: the first one forwards, the second one backwards."""
    return length - length // 2 if way else length // 2


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, its words first and then the questions to it."""
    here, words, ns, automaton = None, [], [], None
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for way, shard, ask, key, n in zip(*(batch.column(c).to_pylist() for c in ("way", "shard", "ask", "key", "n")), strict=True):
            if (way, shard) != here:
                here, words, ns, automaton = (way, shard), [], [], None
            if not ask:
                words.append(key)
                ns.append(n)
                continue
            if automaton is None:
                automaton = Automaton(words)
            for place in automaton.one_error(key, _exact(way, len(key))):
                near = words[place]
                if way:
                    word, near = key[::-1], near[::-1]
                    if near.startswith(word[: len(word) // 2]):  # found forwards
                        continue
                else:
                    word = key
                out[0].append(word)
                out[1].append(near)
                out[2].append(ns[place])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])
    release()


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """Rows (word, near, near_n) of all ordered pairs of distinct words (word, n) one edit apart, each once."""
    shards = -(-words.count() // shard)
    bounds = (_bounds(words, F.col("word"), shards), _bounds(words, F.reverse("word"), shards))
    routed = words.select("word", "n").mapInArrow(_route(bounds), "way int, shard int, ask boolean, key string, n long")
    dealt = routed.repartition("way", "shard").sortWithinPartitions("way", "shard", "ask", "key")
    return dealt.mapInArrow(_answer, "word string, near string, near_n long")


def forms(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of all words (word, n).

    A form is the near word of largest count, in ties the least, if it occurs often enough
    (``RATIO``); counts grow along a chain of forms, so it ends.  Roots are found by
    doubling the step.
    """
    near = near_words(words, shard).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))
    enough = F.col("near_n") >= RATIO * F.col("n")
    found = cut(known.select("word", F.when(enough, F.col("near")).alias("form"), "n", "n_near", F.when(enough, F.col("near_n")).alias("form_n")))
    ways = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        ways = cut(ways.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        if ways.where("moved").isEmpty():
            break
        ways = ways.drop("moved")
    return found.join(ways.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, form and root."""
    return forms(cut(words_of(table(spark, sf_dir, "documents"))))
