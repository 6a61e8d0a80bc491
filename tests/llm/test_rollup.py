"""Token rollups: replays change nothing, and totals equal a recount."""

import base64
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from canopy.llm import rollup

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, f"source string, lang string, tokenizer string, n_tokens bigint{more}")


def rows_of(store):
    return {tuple(r) for r in store.totals().collect()}


def test_batches_are_idempotent(spark, tmp_path):
    store = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert store.totals().collect() == []
    first = frame(spark, [("a", "en", "t1", 5), ("a", "en", "t1", 7), (None, "de", "t1", 3), ("b", None, "t1", 0)])
    assert store.commit("1", store.inserts(first)) and store.commit("1", store.inserts(first))
    changed = frame(spark, [("a", "en", "t1", 9, 5)], ", old_tokens bigint")
    gone = frame(spark, [(None, "de", "t1", 3)])
    store.commit("2", store.revisions(changed), store.deletes(gone))
    store.commit("2", store.revisions(changed), store.deletes(gone))
    want = {("a", "en", "t1", 2, 16), ("b", None, "t1", 1, 0)}
    assert rows_of(store) == want
    store.compact()
    assert rows_of(store) == want
    assert not store.commit("1", store.inserts(first)) and rows_of(store) == want  # sent again after the compaction
    assert store.commit("3", store.inserts(gone)) and rows_of(store) == want | {(None, "de", "t1", 1, 3)}
    store.compact()
    assert not store.commit("3", store.inserts(gone)) and not store.commit("2", store.deletes(gone))
    assert rows_of(store) == want | {(None, "de", "t1", 1, 3)}


def test_a_failed_attempt_and_a_rival_change_nothing(spark, tmp_path):
    """Sums without a manifest don't count, and a writer whose manifest number is taken builds on the other's."""
    one, two = (rollup.TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    row = frame(spark, [("a", "en", "t", 5)])
    one._write(one.inserts(row))
    assert rows_of(one) == set()
    stale = one._state()
    assert two.commit("theirs", two.inserts(row))
    assert not one._publish(stale[0] + 1, stale[1])
    assert one.commit("mine", one.inserts(row)) and rows_of(two) == {("a", "en", "t", 2, 10)}


def recount(rows):
    """Totals of (source, lang, text) rows from the library's counts, each text once."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kept = {}
    for source, lang, text in rows:
        key = ((source is not None, source or ""), (lang is not None, lang or ""))
        kept[text or ""] = min(kept.get(text or "", (key, None))[0], key), (source, lang)
    docs, tokens = Counter(), Counter()
    for text, ((s, g), _) in kept.items():
        key = (s[1] if s[0] else None, g[1] if g[0] else None)
        docs[key] += 1
        tokens[key] += len(coder.encode_ordinary(text.strip()))
    return {(*k, rollup.VERSION, docs[k], tokens[k]) for k in docs}


def test_query_equals_a_recount(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text").collect()
    assert {tuple(r) for r in rollup.op7_token_rollup(spark, sf_dir).collect()} == recount([tuple(r) for r in rows])


def test_odd_tables(spark, odd, nothing, tmp_path):
    """Nulls in all columns, ties, repeated rows, clashing columns, and no rows at all."""
    mixed = odd.withColumn("source", F.when(F.col("doc_id") > 4, "s")).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    for c in ("batch", "n_docs", "docs", "tokenizer", "digest", "n_tokens"):
        mixed = mixed.withColumn(c, F.lit("x"))
    mixed.write.parquet(f"{tmp_path}/odd/documents.parquet")
    rows = mixed.select("source", "lang", "text").collect()
    assert {tuple(r) for r in rollup.op7_token_rollup(spark, f"{tmp_path}/odd").collect()} == recount([tuple(r) for r in rows])
    nothing.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert rollup.op7_token_rollup(spark, f"{tmp_path}/none").collect() == []
