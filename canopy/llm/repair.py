"""Conversation repair: the cheapest edits that make the roles alternate, by a min-plus scan of matrices.

The roles that are left have to read ``(s?(ua)+)?``, by initials.  A state is what has
been written so far: nothing, a system turn, a user turn or an assistant turn.  Each
row is a 4x4 matrix of elements (cost, audit), from the state before it to the state
after it and any number of insertions (the closure of the insertion matrix).  The sum
of two elements is the lesser, costs first and then the audits' letters; the product
adds costs and joins audits.  Audits of one cost over the same rows are never one the
beginning of the other, as all further letters would be insertions that cost
something, hence the product keeps the order and is associative.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length lies
in many tasks.  Each makes one product of every ``BLOCK`` letters, and conversations of
several products are multiplied pairwise by ``FAN`` in a tree.  The repaired text is a
hash of the whole in order, so its last step streams each conversation through one
task, row by row; nothing but its audit is held there.

Null ids and turns are written as one space where they are hashed, null roles and texts
are one space, an empty role has no initial and can't be kept; null turns come first, rows of one turn go by role and then by a digest
of the text, rows that are equal are counted and not repeated until the last step.  An
empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.common import cut, release, table

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: Rows of one product, and products that one task of the tree multiplies.
BLOCK, FAN = 2048, 16
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (NOTHING, ASSISTANT)
#: State before to state after a turn by the initial of its role.
STEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
GOOD_PAIRS = {"su", "ua", "au"}

Element = tuple[int, str]
#: By state before: state after to its element.  What isn't there can't be reached.
Matrix = dict[int, dict[int, Element]]


def plus(matrix: Matrix, i: int, j: int, element: Element) -> None:
    row = matrix.setdefault(i, {})
    if j not in row or element < row[j]:
        row[j] = element


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for i, row in a.items():
        made: dict[int, Element] = {}
        for k, (cost, audit) in row.items():
            for j, (more, letters) in b.get(k, {}).items():
                old = made.get(j)
                if old is None or cost + more < old[0] or (cost + more == old[0] and audit + letters < old[1]):
                    made[j] = (cost + more, audit + letters)
        out[i] = made
    return out


UNIT: Matrix = {i: {i: (0, "")} for i in range(4)}


def _closure() -> Matrix:
    """Any number of insertions; three reach every state that can be reached."""
    one: Matrix = {}
    for role in "ua":
        for i, j in STEPS[role].items():
            plus(one, i, j, (INSERT, "I"))
    out = {i: dict(row) for i, row in UNIT.items()}
    power = UNIT
    for _ in range(3):
        power = times(power, one)
        for i, row in power.items():
            for j, element in row.items():
                plus(out, i, j, element)
    return out


INSERTS = _closure()


def turn_matrix(initial: str, fault: str) -> Matrix:
    """A row's edits and then any number of insertions."""
    row: Matrix = {}
    for i in range(4):
        plus(row, i, i, (DELETE, "D"))
    if fault not in ("blank", "duplicate"):
        extra = CUT_SHORT if fault == "truncated" else 0
        for i, j in STEPS.get(initial, {}).items():
            plus(row, i, j, (extra, "K"))
        for role in "ua":
            for i, j in STEPS[role].items():
                plus(row, i, j, (REROLE + extra, "R"))
    return times(row, INSERTS)


TURNS = {(initial, fault): turn_matrix(initial, fault) for initial in ("s", "u", "a", "") for fault in ("", "truncated", "blank")}
TURNS |= {(initial, "duplicate"): TURNS[initial, "blank"] for initial in ("s", "u", "a", "")}


def power(matrix: Matrix, n: int) -> Matrix:
    out = UNIT
    while n:
        if n & 1:
            out = times(out, matrix)
        n >>= 1
        if n:
            matrix = times(matrix, matrix)
    return out


class Part(NamedTuple):
    """What is known of some consecutive rows of a conversation."""

    matrix: Matrix
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str = ""
    last: str = ""
    low: int | None = None
    high: int | None = None
    turns: int = 0


def join(a: Part, b: Part) -> Part:
    """Both parts, ``b`` behind ``a``; turns ascend, so one turn can at most be the last of ``a`` and the first of ``b``."""
    return Part(
        times(a.matrix, b.matrix),
        a.blank + b.blank,
        a.duplicate + b.duplicate,
        a.truncated + b.truncated,
        a.illegal + b.illegal + (a.last + b.first not in GOOD_PAIRS),
        a.first,
        b.last,
        b.low if a.low is None else a.low,
        a.high if b.high is None else b.high,
        a.turns + b.turns - (a.high is not None and a.high == b.low),
    )


def part(initial: str, fault: str, turn: int | None, copies: int) -> Part:
    """Equal rows; all but the first are duplicates, or blank as the first."""
    kind = initial if initial in STEPS else ""
    matrix = TURNS[kind, fault]
    more = copies - 1
    if more:
        matrix = times(matrix, power(TURNS[kind, "blank"], more))
    blank, known = fault == "blank", turn is not None
    twins = 0 if blank else more + (fault == "duplicate")
    wrong = 0 if initial + initial in GOOD_PAIRS else more
    return Part(matrix, copies if blank else 0, twins, int(fault == "truncated"), wrong, initial, initial, turn, turn, int(known))


def result(whole: Part) -> dict:
    gaps = 0 if whole.low is None else whole.high - whole.low + 1 - whole.turns
    ends = times({NOTHING: INSERTS[NOTHING]}, whole.matrix)[NOTHING]
    cost, audit = min(ends[j] for j in ACCEPTED if j in ends)
    return {"gaps": gaps, "blank": whole.blank, "duplicate": whole.duplicate, "truncated": whole.truncated, "illegal": whole.illegal, "cost": cost, "audit": audit}


def repaired(rows: list[tuple[str, str]], audit: str) -> list[str]:
    """The lines ``role:text`` that an audit makes of rows (role, text)."""
    lines = Lines(audit)
    return [line for role, text in rows for line in lines.row(role, text)] + lines.end()


class Lines:
    """Repaired lines of one conversation, row by row.

    The state follows from the letters: an odd number of turns that stay begins with
    the system, and all others go in turns.
    """

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        self.user = (len(audit) - audit.count("D")) % 2 == 0

    def _turn(self) -> str:
        return "user" if self.user else "assistant"

    def _inserted(self) -> list[str]:
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            out.append(f"{self._turn()}:")
            self.user, self.at = not self.user, self.at + 1
        return out

    def row(self, role: str, text: str) -> list[str]:
        out = self._inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "D":
            return out
        out.append(f"{self._turn() if letter == 'R' else role}:{text}")
        self.user = not self.user
        return out

    def end(self) -> list[str]:
        return self._inserted()


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after the damage; equal rows are one."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kept = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    made = kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"))
    return made.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with ``digest`` and the ``fault`` of the first of their copies: blank, duplicate, truncated or none."""
    rows = rows.withColumn("digest", _digest())
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    first = rows.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.max(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_first"))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    seen = F.col("turn").isNotNull() & (F.col("_null") | (F.col("turn") > F.col("_first")))
    fault = F.when(shown == "", "blank").when(seen, "duplicate").when(~F.substring(shown, -1, 1).isin(*ENDS), "truncated").otherwise("")
    return joined.withColumn("fault", fault).drop("_c", "_r", "_d", "_null", "_first")


_STATS = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
_MATRIX = "cost array<long>, audit array<string>"


def _flat(p: Part) -> list:
    cells = [p.matrix.get(i, {}).get(j) for i in range(4) for j in range(4)]
    return [[c and c[0] for c in cells], [c and c[1] for c in cells], *p[1:]]


def _part(cost, audit, *rest) -> Part:
    matrix: Matrix = {}
    for k, c in enumerate(cost):
        if c is not None and c == c:
            matrix.setdefault(k // 4, {})[k % 4] = (int(c), audit[k])
    return Part(matrix, *(int(x) for x in rest[:4]), rest[4], rest[5], *(None if x is None or x != x else int(x) for x in rest[6:8]), int(rest[8]))


def parts(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (conv_id, at, product and statistics), ``at`` ascending along each conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    narrow = rows.select("conv_id", "turn", "role", "digest", "fault", "copies").repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = narrow.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "copies", F.spark_partition_id().cast("long").alias("partition"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, n, serial, conv, place = [], None, 0, 0, None, 0
        for batch in batches:
            for c, turn, initial, fault, copies, place in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "initial", "fault", "copies", "partition")), strict=True):
                row = part(initial, fault, turn, copies)
                if now is not None and c == conv and n < block:
                    now, n = join(now, row), n + copies
                    continue
                if now is not None:
                    made.append([conv, (place << 32) + serial, *_flat(now)])
                    serial += 1
                now, n, conv = row, copies, c
            if len(made) >= 2000:
                yield _batch(made, schema)
                made = []
        if now is not None:
            made.append([conv, (place << 32) + serial, *_flat(now)])
            yield _batch(made, schema)
        release()

    out = f"conv_id {kind}, at long, {_MATRIX}, {_STATS}"
    schema = _arrow(rows, out)
    return narrow.mapInArrow(multiply, out)


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def tree(products: DataFrame, fan: int = FAN) -> DataFrame:
    """One product of each conversation."""
    names = products.columns

    def multiply(keys, frame: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for row in frame.sort_values("at").itertuples(index=False):
            p = _part(*row[2 : len(names)])
            whole = p if whole is None else join(whole, p)
        return pd.DataFrame([[frame["conv_id"].iloc[0], frame["at"].min(), *_flat(whole)]], columns=names)

    done = None
    left = cut(products)
    while True:
        many = left.groupBy(F.col("conv_id").alias("_c")).agg(F.count("*").alias("_n")).where("_n > 1").select("_c")
        same = F.col("conv_id").eqNullSafe(F.col("_c"))
        single = left.join(many, same, "left_anti")
        done = single if done is None else done.unionByName(single)
        left = left.join(many, same, "left_semi")
        if left.isEmpty():
            return done
        # places are numbered without the products, which may be large
        places = left.select(F.col("conv_id").alias("_c"), F.col("at").alias("_at"))
        group = F.floor((F.row_number().over(Window.partitionBy("_c").orderBy("_at")) - 1) / fan)
        places = places.withColumn("_group", group)
        numbered = left.join(places, same & (F.col("at") == F.col("_at"))).select(*names, "_group")
        left = cut(numbered.groupBy("conv_id", "_group").applyInPandas(multiply, products.schema))


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def results(products: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, …, cost, audit) from one product a conversation."""
    kind = products.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, {_RESULT}"
    schema = _arrow(products, out)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[r["conv_id"], *result(_part(*list(r.values())[2:])).values()] for r in batch.to_pylist()]
            if rows:
                yield _batch(rows, schema)

    return products.mapInArrow(finish, out)


def _hash(kind: str, schema: pa.Schema) -> Callable:
    """Rows come by conversation: its result first (if it has rows), then its rows in order."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = head = lines = digest = None
        begun, out, fresh = False, [], True
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

        def feed(made: list[str]) -> None:
            nonlocal fresh
            for line in made:
                digest.update((line if fresh else "\n" + line).encode())
                fresh = False

        def close() -> None:
            feed(lines.end())
            out.append([conv, *head, digest.hexdigest()])

        for batch in batches:
            for row in batch.to_pylist():
                if row["step"] < 2:  # of an id that has rows after the damage the result comes first, then the id itself
                    if begun and row["conv_id"] == conv:
                        continue
                    if begun:
                        close()
                    begun, conv, fresh, digest = True, row["conv_id"], True, hashlib.sha256()
                    head = [row[n] for n in names] if row["step"] == 0 else [0, 0, 0, 0, 0, 0, ""]
                    lines = Lines(head[-1])
                    continue
                for _ in range(row["copies"]):
                    feed(lines.row(row["role"], row["text"]))
            if len(out) >= 2000:
                yield _batch(out, schema)
                out.clear()
        if begun:
            close()
            yield _batch(out, schema)
        release()

    return stream


def repair(conversations: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Every conv_id of rows (conv_id, turn, role, text) with the counts, cost, audit and hash of its repair after the damage."""
    rows = cut(with_faults(damaged(conversations)))
    found = results(tree(parts(rows, block), fan))
    kind = rows.schema["conv_id"].dataType.simpleString()
    nulls = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in [*found.schema, *rows.schema]}
    columns = ["conv_id", "step", "turn", "role", "digest", "text", "copies", *found.columns[1:]]

    def shaped(df: DataFrame, step: int) -> DataFrame:
        return df.select(*(F.lit(step).alias(c) if c == "step" else F.col(c) if c in df.columns else nulls[c] for c in columns))

    every = shaped(found, 0).unionByName(shaped(conversations.select("conv_id").distinct(), 1)).unionByName(shaped(rows, 2))
    order = [F.asc_nulls_first("conv_id"), F.asc("step"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    out = f"conv_id {kind}, {_RESULT}, repaired_sha256 string"
    return every.repartition("conv_id").sortWithinPartitions(*order).drop("digest", "turn").mapInArrow(_hash(kind, _arrow(rows, out)), out)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all conversations."""
    return repair(table(spark, sf_dir, "conversations"))
