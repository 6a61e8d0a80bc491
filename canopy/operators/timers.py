"""Rules that run again after some days, and the issues that they found.

A log entry names, for each time-based rule, when it last ran and the folder of its
issues, so a rule's time moves exactly when its issues do.  A sweep writes folders for
the rules that are due only; an entry is published whole and never replaced.  A writer
that finds the next entry taken leaves out the rules that the other has run meanwhile,
so that a due rule counts once.  A rule that fails keeps its time and its issues and is
due again at the next sweep; it stops no other rule.
"""

from __future__ import annotations

import datetime
import json
import uuid
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators import bundles as B
from canopy.operators import validation as V
from canopy.sources import shared

ISSUE = "table_name string, record_id string, rule_id string, field_name string, severity string, actual_value string, created_at string, acknowledged_at string"
TIMED = "time_based"
#: What a sweep says of a rule.
RAN, FAILED, EARLY, RIVAL = "ran", "failed", "not_due", "ran_by_other"


def _time(text: str) -> datetime.datetime:
    """A time as it is written; one without an offset is UTC."""
    made = datetime.datetime.fromisoformat(text)
    return made if made.tzinfo else made.replace(tzinfo=datetime.UTC)


def due(last: str | None, days: int, now: str) -> bool:
    """Whether a rule is due that last ran at ``last``; one that never ran, or at no time that can be read, is."""
    try:
        return last is None or _time(now) - _time(last) >= datetime.timedelta(days=days)
    except ValueError:
        _time(now)
        return True


class TimedRules:
    """The state of the time-based rules in one folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _entry(self) -> tuple[int, dict]:
        numbers = [int(n.removesuffix(".json")) for n in shared.names(self.spark, f"{self.folder}/log") if n.endswith(".json")]
        if not numbers:
            return -1, {}
        return numbers[-1], json.loads(shared.read(self.spark, f"{self.folder}/log/{numbers[-1]:012d}.json"))

    def state(self) -> dict[str, str]:
        """When each rule last ran."""
        return {rule: told["last_run_at"] for rule, told in self._entry()[1].items()}

    def issues(self) -> DataFrame:
        """All issues of the last run of each rule."""
        return self._issues(self._entry()[1].values())

    def _issues(self, told) -> DataFrame:
        parts = [self.spark.read.schema(ISSUE).parquet(f"{self.folder}/{t['rows']}") for t in told]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ISSUE)

    def sweep(self, catalogue: B.Catalogue, tables: dict[str, DataFrame], now: str, keys: dict[str, str] | None = None) -> dict[str, str]:
        """Run the time-based rules that are due; gives what became of each of them.

        Issues that are found again keep their first time and their acknowledgement,
        those that aren't go.  Rules of tables that aren't given don't count as run.
        """
        _, entry = self._entry()
        outcomes, made = {}, {}
        for rule in catalogue.rules:
            if rule.trigger != TIMED or rule.table not in tables:
                continue
            before = entry.get(rule.rule_id)
            if not due(before and before["last_run_at"], rule.recheck_days, now):
                outcomes[rule.rule_id] = EARLY
                continue
            name = f"rows-{uuid.uuid4().hex}"
            try:
                found = B.validate(B.Catalogue(catalogue.relations, [rule]), tables, keys)
                known = self._issues([before] if before else [])
                V.merge_issues(known, found, now).select(*[c.split(" ")[0] for c in ISSUE.split(", ")]).write.parquet(f"{self.folder}/{name}")
            except (PySparkException, Py4JError, B.BadBundle):  # told by the outcome; the next sweep tries again
                outcomes[rule.rule_id] = FAILED
                continue
            outcomes[rule.rule_id] = RAN
            made[rule.rule_id] = {"last_run_at": now, "rows": name, "since": before and before["rows"]}
        while made:
            version, entry = self._entry()
            for rule_id in [r for r, told in made.items() if (entry.get(r) or {}).get("rows") != told["since"]]:
                outcomes[rule_id] = RIVAL
                del made[rule_id]
            if not made:
                break
            new = entry | {r: {"last_run_at": told["last_run_at"], "rows": told["rows"]} for r, told in made.items()}
            if shared.create(self.spark, f"{self.folder}/log/{version + 1:012d}.json", json.dumps(new)):
                break
        return outcomes

    def acknowledge(self, records: DataFrame, now: str) -> bool:
        """Mark issues (rule_id, table_name, record_id) as seen; False, and nothing is changed, if a sweep came meanwhile."""
        version, entry = self._entry()
        seen = records.select("rule_id", "table_name", "record_id").distinct().withColumn("_seen", F.lit(now))
        rules = {r["rule_id"] for r in records.select("rule_id").distinct().where(F.col("rule_id").isin(list(entry))).collect()}
        new = dict(entry)
        for rule_id in rules:  # at most as many as there are rules
            name = f"rows-{uuid.uuid4().hex}"
            rows = self._issues([entry[rule_id]]).join(seen, ["rule_id", "table_name", "record_id"], "left")
            rows.withColumn("acknowledged_at", F.coalesce("acknowledged_at", "_seen")).select(*[c.split(" ")[0] for c in ISSUE.split(", ")]).write.parquet(f"{self.folder}/{name}")
            new[rule_id] = entry[rule_id] | {"rows": name}
        return shared.create(self.spark, f"{self.folder}/log/{version + 1:012d}.json", json.dumps(new))
