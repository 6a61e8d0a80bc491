import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """Documents as rows in plain Python, by ascending id."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r["doc_id"], r["text"] or "") for r in rows)


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and very long texts, ties, repeated rows, and extra columns of clashing names."""
    rows = [
        (None, "a row without id", 1),
        (1, None, 1),
        (2, "", 2),
        (3, "   \n\t ", 3),
        (4, "one two three four five six seven", 4),
        (4, "one two three four five six seven", 4),
        (5, "one two three four five six seven", 5),
        (6, "w" * 70_000, 6),
        (7, "it's 1234's «ünïcode» \U0001f600   end  ", 7),
        (8, "word " * 40_000, 8),
        (9, "one two three four five six seven", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id int")
    extra = {c: F.lit(c) for c in ("score", "start", "ids", "fp", "label", "lang", "sequence_id", "_text")}
    return df.repartition(3).withColumns(extra)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
