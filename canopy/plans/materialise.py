"""Cutting the plan of iterative operators at reliable storage, and folders that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from canopy.sources.shared import base, folder

__all__ = ["folder", "materialise"]


def materialise(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint; a lost executor costs no recomputation of the plan above."""
    base(df.sparkSession)
    return df.checkpoint(eager=True)
