"""Edits as batches of changes against an immutable snapshot, with optimistic concurrency.

A change row names its operation (create, update, delete), its key, the new
values and the ``expected`` modification stamp of the row that it was made
from.  A batch is checked set-wise; each change is applied or gets a reason:
exists, missing, conflict, in_use or repeated (a key that occurs twice in the
batch; none of its changes is applied).  The new snapshot is another version
folder; a reader of an older version isn't disturbed.  A version is published by
a log entry that is only ever created: of two writers that start from the same
version the second checks its batch again, on what the first has written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.scalars import empty, text
from canopy.sources import shared

APPLIED = "applied"


def check(current: DataFrame, changes: DataFrame, key: str = "id", in_use: DataFrame | None = None) -> DataFrame:
    """The changes with ``outcome``.  ``in_use`` (key) are rows that other tables name: they can't be deleted."""
    known = current.select(F.col(key).alias("_key"), F.col("modified").alias("_modified"))
    rows = changes.join(known, F.col(key) == F.col("_key"), "left")
    times = changes.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(times, F.col(key) == F.col("_again"), "left")
    if in_use is None:
        rows = rows.withColumn("_used", F.lit(None))
    else:
        rows = rows.join(in_use.select(F.col(key).alias("_used")).distinct(), F.col(key) == F.col("_used"), "left")
    there = F.col("_key").isNotNull()
    outcome = (
        F.when(F.col("_again").isNotNull(), "repeated")
        .when((F.col("op") == "create") & there, "exists")
        .when((F.col("op") != "create") & ~there, "missing")
        .when((F.col("op") != "create") & ~empty(F.col("expected")) & (text(F.col("expected")) != text(F.col("_modified"))), "conflict")
        .when((F.col("op") == "delete") & F.col("_used").isNotNull(), "in_use")
        .otherwise(APPLIED)
    )
    return rows.withColumn("outcome", outcome).drop("_key", "_modified", "_again", "_n", "_used")


def apply(current: DataFrame, checked: DataFrame, actor: str, now: str, key: str = "id") -> DataFrame:
    """The snapshot after the applied changes.

    A change may name the fields that it sets in ``fields`` (an array): these take
    its values, also null, and all others stay.  Without ``fields`` null values of an
    update keep the old ones.
    """
    values = [c for c in current.columns if c not in (key, "modified", "modified_by")]
    good = checked.where(F.col("outcome") == APPLIED)
    fields = F.col("fields") if "fields" in checked.columns else F.lit(None).cast("array<string>")
    changed = good.select(F.col(key).alias("_key"), F.col("op").alias("_op"), fields.alias("_fields"), *[F.col(c).alias(f"_{c}_new") for c in values])
    joined = current.join(changed, F.col(key) == F.col("_key"), "full_outer").where("_op is null or _op <> 'delete'")
    touched = F.col("_op").isNotNull()
    return joined.select(
        F.coalesce(key, "_key").alias(key),
        *[F.when(F.array_contains("_fields", c), F.col(f"_{c}_new")).when((F.col("_op") == "update") & F.col("_fields").isNotNull(), F.col(c)).otherwise(F.coalesce(f"_{c}_new", c)).alias(c) for c in values],
        F.when(touched, now).otherwise(F.col("modified")).alias("modified"),
        F.when(touched, actor).otherwise(F.col("modified_by")).alias("modified_by"),
    ).select(*current.columns)


def dirty(before: DataFrame, checked: DataFrame, key: str = "id") -> DataFrame:
    """Applied changes with the old row: what incremental validation starts from."""
    old = before.select(F.col(key).alias("_k"), F.struct(*before.columns).alias("old_row"))
    return checked.where(F.col("outcome") == APPLIED).join(old, F.col(key) == F.col("_k"), "left").select(key, "op", "old_row")


class VersionConflict(RuntimeError):
    """The version was published by another writer."""


class VersionedTable:
    """Snapshots of one table below a folder, and a log of small files that make versions visible.

    Every attempt writes its rows to a folder of its own; what has no log entry is
    never read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _entry(self, version: int) -> str:
        return f"{self.folder}/log/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in shared.names(self.spark, f"{self.folder}/log") if n.endswith(".json")]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the newest one if none is named."""
        last = self.versions()[-1] if version is None else version
        entry = json.loads(shared.read(self.spark, self._entry(last)))
        return self.spark.read.parquet(f"{self.folder}/{entry['rows']}")

    def write(self, rows: DataFrame, version: int) -> None:
        """Publish the rows as a version; refused if there is such a version."""
        name = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        if not shared.create(self.spark, self._entry(version), json.dumps({"rows": name})):
            raise VersionConflict(f"version {version} is there already")

    def commit(self, changes: DataFrame, actor: str, now: str, key: str = "id", in_use: DataFrame | None = None) -> DataFrame:
        """Apply a batch as the next version; returns the changes with their outcomes."""
        while True:
            last = self.versions()[-1]
            current = self.read(last)
            checked = check(current, changes, key, in_use)
            try:
                self.write(apply(current, checked, actor, now, key), last + 1)
                return checked
            except VersionConflict:  # another writer was first: check again on what it wrote
                continue
