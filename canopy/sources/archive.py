"""An archive: the relations of a hierarchical reference collection as DataFrames.

``Archive.load`` reads a folder of Parquet tables, ``Archive.derive`` builds the
relations from the star-schema tables of the test data.  Nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopy.sources import shared

#: Columns of the relations that operators rely on; more columns may be there.
SCHEMAS = {
    "taxon": "id string, parent_id string, ordinal int, name_id string, status_id string, extinct int",
    "name": "id string, scientific_name string, canonical_simple string, canonical_full string, authorship string, rank_id string, code_id string",
    "synonym": "id string, taxon_id string, name_id string, status_id string",
    "name_relation": "name_id string, related_name_id string, type_id string",
    "reference": "id string, author string, issued string, title string, citation string, type_id string",
}
#: Tables that an archive may lack; they are empty until something is written.
SIDE_TABLES = {
    "issue": "table_name string, record_id string, rule_id string, field_name string, severity string, actual_value string, created_at string, acknowledged_at string",
    "rule_config": "rule_id string, enabled boolean, severity string",
    "ruleset_config": "ruleset string, enabled boolean",
    "rule_state": "rule_id string, last_run_at string",
}
VERSION = "1"
#: What stored columns are called, before their logical names.
PREFIX = "col__"


class ArchiveExists(Exception):
    """A new archive would replace one that is there."""


class UnknownVersion(Exception):
    """An archive was written by a later version of the library."""


def logical(df: DataFrame, names: dict[str, str] | None = None, prefix: str = PREFIX) -> DataFrame:
    """The columns under their logical names: by ``names`` (stored to logical), all others without the prefix.

    Two columns of one logical name are refused; names differ by more than case.
    """
    made = [(names or {}).get(c, c.removeprefix(prefix)) for c in df.columns]
    twice = {c for c in made if [m.lower() for m in made].count(c.lower()) > 1}
    if twice:
        raise ValueError(f"columns of one name: {sorted(twice)}")
    return df.toDF(*made)


def evolve(df: DataFrame, schema: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """The rows under the columns and types of ``schema``; what is so already stays as it is.

    ``renamed`` (old to new) counts where only the old name is there.  Missing columns
    are null, values that don't fit a type too, and columns that the schema doesn't
    name come last.  It is one projection, so a scan reads what is asked for only.
    """
    there = {c.lower(): c for c in df.columns}
    for old, new in (renamed or {}).items():
        if old.lower() in there and new.lower() not in there:
            df = df.withColumnRenamed(there.pop(old.lower()), new)
            there[new.lower()] = new
    wanted = StructType.fromDDL(schema)
    known = {f.name.lower() for f in wanted}

    def column(f):
        kind = f.dataType.simpleString()
        if f.name.lower() not in there:
            return F.lit(None).cast(kind).alias(f.name)
        held = F.col(f"`{there[f.name.lower()]}`")
        return (held if df.schema[there[f.name.lower()]].dataType == f.dataType else held.try_cast(kind)).alias(f.name)

    return df.select(*map(column, wanted), *[F.col(f"`{c}`") for k, c in there.items() if k not in known])


@dataclass
class Archive:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @classmethod
    def load(cls, spark: SparkSession, folder: str, names: list[str] | None = None, renamed: dict[str, dict[str, str]] | None = None) -> Archive:
        """A snapshot of the relations below ``folder``; reading alone never changes it.

        Columns get their logical names and the schema of today (``renamed``: old to
        new column names by table); side tables that aren't there are empty.
        """
        stored = shared.names(spark, folder)
        if "metadata" in stored:
            found = evolve(logical(spark.read.parquet(f"{folder}/metadata")), "version string").first()
            if found and (found["version"] or VERSION).zfill(9) > VERSION.zfill(9):
                raise UnknownVersion(f"{folder}: {found['version']}")
        schemas = SCHEMAS | SIDE_TABLES
        made = {}
        for n in [*(names or SCHEMAS), *SIDE_TABLES]:
            if n in SIDE_TABLES and n not in stored:
                made[n] = spark.createDataFrame([], schemas[n])
                continue
            df = logical(spark.read.parquet(f"{folder}/{n}"))
            made[n] = evolve(df, schemas[n], (renamed or {}).get(n)) if n in schemas else df
        return cls(spark, made)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, title: str = "") -> Archive:
        """Empty relations and one metadata row in a new folder."""
        made = {n: spark.createDataFrame([], s) for n, s in (SCHEMAS | SIDE_TABLES).items()}
        made["metadata"] = spark.createDataFrame([(1, title, VERSION)], "id int, title string, version string")
        archive = cls(spark, made)
        archive.save(folder)
        return archive

    def save(self, folder: str) -> None:
        from pyspark.errors import AnalysisException

        for name, df in self.tables.items():
            try:
                df.write.mode("errorifexists").parquet(f"{folder}/{name}")
            except AnalysisException as error:
                raise ArchiveExists(f"{folder}/{name}") from error

    @classmethod
    def derive(cls, spark: SparkSession, sf_dir: str) -> Archive:
        """Relations from the star schema: places and trading partners as a tree, parts as names."""
        t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "supplier", "customer", "part", "lineitem", "orders")}
        return cls(spark, {"tree": tree(t), "part_name": part_names(t["part"]), "part_synonym": part_synonyms(t["lineitem"]), **t})


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def tree(t: dict[str, DataFrame]) -> DataFrame:
    """Regions, their nations, and the nations' suppliers and customers as (id, parent_id, ordinal, name, rank)."""

    def level(df: DataFrame, prefix: str, key: str, up: str | None, up_key: str, name: str, rank: str, ordered: bool) -> DataFrame:
        return df.select(
            _id(prefix, key).alias("id"),
            (_id(up, up_key) if up else F.lit(None).cast("string")).alias("parent_id"),
            (F.col(key).cast("int") if ordered else F.lit(None).cast("int")).alias("ordinal"),
            F.col(name).alias("name"),
            F.lit(rank).alias("rank"),
        )

    return (
        level(t["region"], "R", "r_regionkey", None, "", "r_name", "REGION", True)
        .unionByName(level(t["nation"], "N", "n_nationkey", "R", "n_regionkey", "n_name", "NATION", True))
        .unionByName(level(t["supplier"], "S", "s_suppkey", "N", "s_nationkey", "s_name", "SUPPLIER", False))
        .unionByName(level(t["customer"], "C", "c_custkey", "N", "c_nationkey", "c_name", "CUSTOMER", False))
    )


def part_names(part: DataFrame) -> DataFrame:
    """Parts as names: two-word canonical, brand as authorship."""
    return part.select(_id("P", "p_partkey").alias("id"), F.col("p_name").alias("canonical"), F.col("p_brand").alias("authorship"), F.col("p_type").alias("code"), F.col("p_size").alias("size"), F.col("p_partkey").alias("key"))


def part_synonyms(lineitem: DataFrame) -> DataFrame:
    """Distinct part-supplier pairs: a part's name resolves to each of its suppliers (pro parte).

    Nearly all pairs are distinct, so a task of the scan would hold all of its own.  The keys are
    dealt first, and to a fixed number of tasks: they are small in a shuffle, where Spark would
    put many partitions together, and large as the text that they become.
    """
    tasks = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = lineitem.select("l_partkey", "l_suppkey").repartition(tasks, "l_partkey", "l_suppkey").distinct()
    return pairs.select(_id("P", "l_partkey").alias("id"), _id("S", "l_suppkey").alias("taxon_id"))
