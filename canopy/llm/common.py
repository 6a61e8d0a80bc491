"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.sources import shared

#: Text bytes that a Python worker handles at once.  A longer single text is handled alone.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return shared.folder(spark, purpose)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that a lost executor costs no recomputation of the plan above."""
    shared.base(df.sparkSession)
    return df.checkpoint(eager=True)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of at most ``limit`` text bytes (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(size.searchsorted(before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def blank_null(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give memory that a worker no longer uses back to the system; Spark uses the same workers for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only where the C library has it
        pass
