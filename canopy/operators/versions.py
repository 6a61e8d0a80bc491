"""Versions of a whole collection: edits of several tables that become visible at once or not at all.

A change belongs to an ``edit``.  All changes of a batch are checked against one
version, each by its own record's stamp; an edit with a change that fails is refused as
a whole (its other changes are ``incomplete``), and so is one that would leave a key
that leads nowhere (``dangling``) or takes away a row that is still named (``in_use``).

A version is one log entry that names, for each table, a base and the deltas on top of
it.  A batch writes only the rows that it changes; an entry is published whole and
never replaced.  A writer that finds the next version taken checks its batch again on
what the other has written, so writers of different records both succeed.  Rows of a
writer that died before its entry are never read.  ``compact`` makes a new base.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators import edits
from canopy.plans.materialise import materialise
from canopy.sources import shared

#: (table, column, table that the column's key leads to).
Link = tuple[str, str, str]


def check(current: dict[str, DataFrame], changes: dict[str, DataFrame], links: list[Link], key: str = "id") -> dict[str, DataFrame]:
    """The changes (edit, op, key, values, expected) of each table with ``outcome``."""
    checked = {t: materialise(edits.check(current[t], rows, key)) for t, rows in changes.items()}
    refused = _edits(checked, F.col("outcome") != edits.APPLIED)
    while True:
        checked = {t: _refuse(rows, refused, "incomplete") for t, rows in checked.items()}
        bad = [found for link in links for found in _broken(current, checked, link, key)]
        if not bad:
            return checked
        # an edit that is refused can leave others without the rows that they lean on
        found = materialise(reduce(DataFrame.unionByName, bad).groupBy("table_name", key).agg(F.min("why").alias("why")))
        if found.isEmpty():
            return checked
        for t in checked:
            mine = found.where(F.col("table_name") == t).select(F.col(key).alias("_key"), "why")
            marked = checked[t].join(mine, F.col(key) == F.col("_key"), "left")
            applied = (F.col("outcome") == edits.APPLIED) & F.col("why").isNotNull()
            checked[t] = materialise(marked.withColumn("outcome", F.when(applied, F.col("why")).otherwise(F.col("outcome"))).drop("_key", "why"))
        refused = _edits(checked, F.col("outcome") != edits.APPLIED)


def _edits(checked: dict[str, DataFrame], wanted) -> DataFrame:
    return materialise(reduce(DataFrame.union, (rows.where(wanted).select("edit") for rows in checked.values())).where("edit is not null").distinct())


def _refuse(rows: DataFrame, refused: DataFrame, why: str) -> DataFrame:
    marked = rows.join(refused.select(F.col("edit").alias("_edit")), F.col("edit") == F.col("_edit"), "left")
    hit = (F.col("outcome") == edits.APPLIED) & F.col("_edit").isNotNull()
    return marked.withColumn("outcome", F.when(hit, why).otherwise(F.col("outcome"))).drop("_edit")


def _broken(current: dict[str, DataFrame], checked: dict[str, DataFrame], link: Link, key: str) -> list[DataFrame]:
    """Applied changes (table_name, key, why) after which a key of the link leads nowhere."""
    table, column, target = link
    after = {t: edits.apply(current[t], checked[t], "", "", key) if t in checked else current[t] for t in {table, target}}
    keys = after[target].select(F.col(key).alias("_target"))
    lost = after[table].where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(key).alias("_row"), F.col(column).alias("_to")).join(keys, F.col("_to") == F.col("_target"), "left_anti")
    done = lambda t, *ops: checked[t].where((F.col("outcome") == edits.APPLIED) & F.col("op").isin(*ops)).select(key)
    out = []
    if table in checked:
        out.append(lost.join(done(table, "create", "update"), F.col("_row") == F.col(key)).select(F.lit(table).alias("table_name"), key, F.lit("dangling").alias("why")))
    if target in checked:
        out.append(lost.join(done(target, "delete"), F.col("_to") == F.col(key)).select(F.lit(target).alias("table_name"), key, F.lit("in_use").alias("why")))
    return out


class Versions:
    def __init__(self, spark: SparkSession, folder: str, links: list[Link] = (), key: str = "id"):
        self.spark, self.folder, self.links, self.key = spark, folder.rstrip("/"), list(links), key

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in shared.names(self.spark, f"{self.folder}/log") if n.endswith(".json")]

    def entry(self, version: int | None = None) -> tuple[int, dict]:
        version = self.versions()[-1] if version is None else version
        return version, json.loads(shared.read(self.spark, f"{self.folder}/log/{version:012d}.json"))

    def _publish(self, version: int, entry: dict) -> bool:
        return shared.create(self.spark, f"{self.folder}/log/{version:012d}.json", json.dumps(entry))

    def _write(self, rows: DataFrame) -> str:
        name = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def create(self, tables: dict[str, DataFrame]) -> None:
        """Version 0."""
        entry = {t: {"base": self._write(rows), "deltas": []} for t, rows in tables.items()}
        if not self._publish(0, entry):
            raise edits.VersionConflict("there is a version 0 already")

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables as one version has them, the newest one if none is named."""
        return {t: self._table(parts) for t, parts in self.entry(version)[1].items()}

    def _table(self, parts: dict) -> DataFrame:
        base = self.spark.read.parquet(f"{self.folder}/{parts['base']}")
        if not parts["deltas"]:
            return base
        one = lambda n, name: self.spark.read.parquet(f"{self.folder}/{name}").withColumn("_at", F.lit(n))
        rows = reduce(DataFrame.unionByName, (one(n, name) for n, name in enumerate(parts["deltas"])))
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("_at", self.key)]), "_at").alias("_row"))
        kept = base.join(last.select(self.key), self.key, "left_anti").select(*base.columns)
        put = last.where("not _row._gone").select(self.key, *[F.col(f"_row.{c}").alias(c) for c in base.columns if c != self.key])
        return kept.unionByName(put)

    def commit(self, changes: dict[str, DataFrame], actor: str, now: str) -> dict[str, DataFrame]:
        """Publish the edits that pass as the next version; returns all changes with their outcomes."""
        while True:
            version, entry = self.entry()
            current = {t: self._table(parts) for t, parts in entry.items()}
            checked = check(current, changes, self.links, self.key)
            new = {t: dict(parts) for t, parts in entry.items()}
            for t, rows in checked.items():
                good = rows.where(F.col("outcome") == edits.APPLIED)
                # only the rows that are named by the batch are made anew
                before = current[t].join(good.select(self.key), self.key, "left_semi").select(*current[t].columns)
                put = edits.apply(before, rows, actor, now, self.key).withColumn("_gone", F.lit(False))
                gone = good.where("op = 'delete'").select(self.key).join(before, self.key).select(*current[t].columns).withColumn("_gone", F.lit(True))
                new[t]["deltas"] = [*new[t]["deltas"], self._write(put.unionByName(gone))]
            if self._publish(version + 1, new):
                return checked

    def compact(self) -> bool:
        """The newest version's rows as bases; False, and nothing is changed, if another version came meanwhile."""
        version, entry = self.entry()
        new = {t: {"base": self._write(self._table(parts)), "deltas": []} if parts["deltas"] else parts for t, parts in entry.items()}
        return self._publish(version + 1, new)
