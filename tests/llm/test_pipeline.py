"""Each pipeline stage against a plain version on what the stage before kept."""

import corpus_pipeline
from canopy.llm import quality, toxicity
from canopy.llm.common import table

BIG = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = table(spark, BIG, "documents")
    labels = table(spark, BIG, "labels")
    columns = docs.columns
    kept = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, out = kept, stage(spark, docs, BIG)
        if name == "toxicity":
            score = toxicity.score(docs, toxicity.train(table(spark, BIG, "documents"), labels)).collect()
            want = {r["doc_id"] for r in score if r["score"] < corpus_pipeline.TOXIC_FROM}
        elif name == "quality":
            score = quality.score(docs, quality.train(table(spark, BIG, "documents"), labels)).collect()
            want = {r["doc_id"] for r in score if r["score"] >= corpus_pipeline.GOOD_FROM}
        elif name == "near_duplicates":
            want = None
        else:
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(before)
            assert sum(r["length"] for r in rows if r["start"] == 0) > 0
            continue
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        assert set(kept) < set(before)
        if want is not None:
            assert set(kept) == want
        else:
            texts = {}
            for i, text in sorted(before.items()):
                texts.setdefault(text, i)
            assert set(kept) <= set(texts.values())  # of equal texts the least id stays
            assert near_copies_left(before, kept)
    assert len(kept) > 200


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def near_copies_left(before, kept):
    """Every document that went has a near copy, and no two that stayed are such."""
    sets = {i: shingles(t) for i, t in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    gone = set(before) - set(kept)
    lonely = [i for i in gone if max((alike(i, j) for j in before if j != i), default=0) < 0.8]
    left = [(a, b) for a in kept for b in kept if a < b and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and alike(a, b) >= 0.8]
    assert not lonely, lonely[:10]
    assert not left, left[:10]
    return True


def test_odd_rows_and_no_rows(spark, odd, nothing, tmp_path, documents):
    """The whole pipeline over nulls, ties, repeated rows, very long texts and clashing columns, and over an empty table."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    learned = spark.createDataFrame([(i + 100, t) for i, t in documents], "doc_id bigint, text string")
    labels = labels.withColumn("doc_id", labels["doc_id"] + 100)
    mixed = odd.withColumn("_toxic", odd["id"]).withColumn("_good", odd["id"]).withColumn("_keep", odd["id"])
    for name, docs, rows in (("odd", mixed, learned), ("none", nothing, None)):
        folder = f"{tmp_path}/{name}"
        both = docs if rows is None else docs.unionByName(rows, allowMissingColumns=True)
        both.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        ids = [r["doc_id"] for r in got if r["start"] == 0]
        assert len(ids) - ids.count(None) == len(set(ids) - {None})  # one row at most of each id that is kept
        assert set(ids) <= {None, *range(1, 10), *(i + 100 for i, _ in documents)}
        assert (len(ids) > 50) == (name == "odd")
