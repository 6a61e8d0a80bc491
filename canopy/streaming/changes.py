"""Streams of changes: validation of what changed, and an inverted index kept up to date, batch by batch.

Every batch writes its own folder (``batch=N``) and overwrites it when it is
replayed, so that a restart from the stream's checkpoint changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopy.operators.search import tokens
from canopy.operators.text_index import TextIndex


def changes(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive at ``path``; a batch has so many files at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _run(stream: DataFrame, folder: str, each: Callable[[DataFrame], DataFrame], checkpoint: str, trigger: dict) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def validate_changes(stream: DataFrame, validate: Callable[[DataFrame], DataFrame], keys: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Violations of the changed rows of each batch, as ``validate`` finds them (it may join the neighbours of the changes).

    ``keys`` gives the records (table_name, record_id) that a batch validates; they
    are written with the violations, so that a record without any is known as clean.
    """

    def each(batch: DataFrame) -> DataFrame:
        records = keys(batch).select("table_name", F.col("record_id").cast("string").alias("record_id")).distinct()
        return records.withColumn("validated", F.lit(True)).unionByName(validate(batch).withColumn("validated", F.lit(False)), allowMissingColumns=True)

    return _run(stream, folder, each, checkpoint, trigger or {"availableNow": True})


def index_changes(stream: DataFrame, id_col: str, text_col: str, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Signed postings (term, id, tf) of each batch of changes (id, old text or null, new text or null)."""

    def postings(batch: DataFrame) -> DataFrame:
        def side(text: str, sign: int) -> DataFrame:
            words = batch.select(F.col(id_col).alias("id"), F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("term"))
            return words.groupBy("term", "id").agg((F.count("*") * sign).alias("tf"))

        both = side(text_col, 1).unionByName(side(f"old_{text_col}", -1))
        return both.groupBy("term", "id").agg(F.sum("tf").alias("tf")).where("tf <> 0")

    return _run(stream, folder, postings, checkpoint, trigger or {"availableNow": True})


def index_texts(stream: DataFrame, index: TextIndex, id_col: str, text_col: str, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Add each batch of new texts (null: deleted) to a stored index; a batch that is replayed counts once."""

    def add(batch: DataFrame, number: int) -> None:
        index.apply(batch.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), name, number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The postings after all batches."""
    rows = spark.read.schema("term string, id bigint, tf bigint, batch bigint").parquet(folder)
    return rows.groupBy("term", "id").agg(F.sum("tf").alias("tf")).where("tf <> 0")


def latest_violations(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The violations of each record's last validation; a record that was found clean since has none."""
    rows = spark.read.schema(f"{schema}, validated boolean, batch bigint").parquet(folder)
    last = rows.groupBy("table_name", "record_id").agg(F.max("batch").alias("batch"))
    return rows.where("not validated").join(last, ["table_name", "record_id", "batch"]).drop("validated")
