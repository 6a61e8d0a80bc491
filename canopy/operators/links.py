"""Batches of edits of rows that tie records together: synonyms, name relations and agents.

Every change gets an ``outcome`` against the snapshot that the batch starts from;
only those with ``applied`` take effect.  Beside the outcomes of ``edits.check``
there are incomplete (a required field is null or empty), self (a row would name
itself), exists, missing, unchanged (nothing to do) and role (no such role).  A
change is checked by joins on its key, so batches may be as large as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.scalars import empty, text
from canopy.operators.edits import APPLIED

# Fixed values of the domain.
ROLES = ["creator", "contact", "editor", "contributor", "publisher"]


def _stamp(rows: DataFrame, actor: str, now: str) -> DataFrame:
    return rows.withColumn("modified", F.lit(now)).withColumn("modified_by", F.lit(actor))


def _again(changes: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    """The changes with ``_bad``: whether ``bad``, an aggregate, holds for the group of their keys; null keys form a group."""
    groups = changes.groupBy(*[text(F.col(k).cast("string")).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(bad.alias("_bad"))
    same = [text(F.col(k).cast("string")) == F.col(f"_g{i}") for i, k in enumerate(keys)]
    for s in same[1:]:
        same[0] = same[0] & s
    return changes.join(groups, same[0], "left").drop(*[f"_g{i}" for i in range(len(keys))])


def check_synonyms(synonyms: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (op, id, taxon_id, name_id, status_id) of synonyms (id, taxon_id, name_id, status_id, …) with ``outcome``.

    ``add`` makes a synonym of a taxon and a name, with an id derived from both if
    none is given.  ``extend`` adds another taxon to a synonym that is there (pro
    parte) and does nothing where it has the taxon.  ``move`` gives a synonym to one
    taxon.  ``remove`` takes one link away (id and taxon_id), or all of an id (without
    taxon_id).  A synonym that is moved or removed can't have another change in the
    batch; neither can the same link twice.
    """
    made = F.md5(F.concat_ws("\x1f", text(F.col("taxon_id")), text(F.col("name_id"))))
    rows = changes.withColumn("id", F.when((F.col("op") == "add") & empty(F.col("id")), made).otherwise(F.col("id")))
    alone = F.max(F.col("op").isin("move", "remove").cast("int")) == 1
    rows = _again(rows, ["id"], (F.count("*") > 1) & alone).withColumnRenamed("_bad", "_mixed")
    rows = _again(rows, ["id", "taxon_id"], F.count("*") > 1).withColumnRenamed("_bad", "_twice")
    known = synonyms.select(F.col("id").alias("_id")).distinct()
    links = synonyms.select(F.col("id").alias("_link"), F.col("taxon_id").alias("_taxon")).distinct()
    rows = rows.join(known, F.col("id") == F.col("_id"), "left").join(links, (F.col("id") == F.col("_link")) & (F.col("taxon_id") == F.col("_taxon")), "left")
    op, there, linked = F.col("op"), F.col("_id").isNotNull(), F.col("_link").isNotNull()
    outcome = (
        F.when(empty(F.col("id")) | (op.isin("add", "extend", "move") & empty(F.col("taxon_id"))) | ((op == "add") & empty(F.col("name_id"))), "incomplete")
        .when(op.isin("add", "extend", "move") & (F.col("id") == F.col("taxon_id")), "self")
        .when(F.col("_mixed") | F.col("_twice"), "repeated")
        .when((op == "add") & there, "exists")
        .when((op != "add") & ~there, "missing")
        .when((op == "remove") & ~empty(F.col("taxon_id")) & ~linked, "missing")
        .when((op == "extend") & linked, "unchanged")
        .otherwise(APPLIED)
    )
    return rows.withColumn("outcome", outcome).drop("_id", "_link", "_taxon", "_mixed", "_twice")


def apply_synonyms(synonyms: DataFrame, checked: DataFrame, actor: str, now: str) -> DataFrame:
    """The synonyms after the applied changes; a further taxon's row takes all else from the synonym's first row, by taxon."""
    good = checked.where(F.col("outcome") == APPLIED)
    gone = good.where("op = 'remove'").select(F.col("id").alias("_id"), F.nullif("taxon_id", F.lit("")).alias("_taxon"))
    kept = synonyms.join(gone, (F.col("id") == F.col("_id")) & (F.col("_taxon").isNull() | (F.col("_taxon") == F.col("taxon_id"))), "left_anti")
    moves = good.where("op = 'move'").select(F.col("id").alias("_id"), F.col("taxon_id").alias("_to"))
    moved = kept.join(moves, F.col("id") == F.col("_id"), "left")
    to = F.col("_to").isNotNull()
    moved = moved.select(
        *[F.coalesce("_to", c).alias(c) if c == "taxon_id" else F.when(to, {"modified": F.lit(now), "modified_by": F.lit(actor)}[c]).otherwise(F.col(c)).alias(c) if c in ("modified", "modified_by") else c for c in synonyms.columns], to.alias("_moved")
    )
    still, went = moved.where("not _moved").drop("_moved"), moved.where("_moved").drop("_moved").distinct()  # links that fall together are one
    fields = [c for c in ("id", "taxon_id", "name_id", "status_id") if c in synonyms.columns]
    new = good.where("op = 'add'").select(*fields, *[F.lit(None).cast(synonyms.schema[c].dataType).alias(c) for c in synonyms.columns if c not in fields])
    more = good.where("op = 'extend'").select(F.col("id").alias("_id"), F.col("taxon_id").alias("_to"))
    some = synonyms.join(more.select(F.col("_id").alias("id")).distinct(), "id", "left_semi")
    first = some.groupBy(F.col("id").alias("_first")).agg(F.min_by(F.struct(*synonyms.columns), F.col("taxon_id")).alias("_row"))
    added = more.join(first, F.col("_id") == F.col("_first")).select(*[F.col("_to").alias(c) if c == "taxon_id" else F.col(f"_row.{c}").alias(c) for c in synonyms.columns])
    return still.unionByName(went).unionByName(_stamp(new.select(*synonyms.columns).unionByName(added), actor, now).select(*synonyms.columns))


def remove_synonyms(synonyms: DataFrame, names: DataFrame, taxa: DataFrame, relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Synonyms and names after synonyms (id) are removed, with the names that nothing else needs.

    A name stays if a taxon, another synonym or a relation has it; a name that was
    bare before and belongs to no removed synonym stays as well.
    """
    ids = ids.select("id").distinct()
    left = synonyms.join(ids, "id", "left_anti")
    freed = synonyms.join(ids, "id", "left_semi").select("name_id").distinct()
    for users in (left.select("name_id"), taxa.select("name_id"), relations.select("name_id"), relations.select(F.col("related_id").alias("name_id"))):
        freed = freed.join(users, "name_id", "left_anti")
    return left, names.join(freed.select(F.col("name_id").alias("id")), "id", "left_anti")


def add_basionyms(names: DataFrame, synonyms: DataFrame, relations: DataFrame, batch: DataFrame, actor: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Names, synonyms and relations after a batch (taxon_id, name_id, basionym_id, canonical), and the batch with ``outcome``.

    Each row makes a name, a synonym of the taxon by it, and its relation to the
    taxon's name; all three or none.
    """
    rows = _again(batch, ["basionym_id"], F.count("*") > 1)
    known = names.select(F.col("id").alias("_new")).distinct()
    old = names.select(F.col("id").alias("_old")).distinct()
    rows = rows.join(known, F.col("basionym_id") == F.col("_new"), "left").join(old, F.col("name_id") == F.col("_old"), "left")
    needed = empty(F.col("taxon_id")) | empty(F.col("name_id")) | empty(F.col("basionym_id")) | empty(F.col("canonical"))
    outcome = F.when(needed, "incomplete").when((F.col("basionym_id") == F.col("name_id")) | (F.col("basionym_id") == F.col("taxon_id")), "self").when(F.col("_bad"), "repeated").when(F.col("_new").isNotNull(), "exists").when(F.col("_old").isNull(), "missing").otherwise(APPLIED)
    checked = rows.withColumn("outcome", outcome).drop("_bad", "_new", "_old")
    good = checked.where(F.col("outcome") == APPLIED)

    def into(table: DataFrame, **values: Column) -> DataFrame:
        values |= {"modified": F.lit(now), "modified_by": F.lit(actor)}
        new = good.select(*[values.get(c, F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns])
        return table.unionByName(new)

    basionym = F.col("basionym_id")
    return (
        into(names, id=basionym, canonical=F.col("canonical")),
        into(synonyms, id=F.md5(F.concat_ws("\x1f", "taxon_id", "basionym_id")), taxon_id=F.col("taxon_id"), name_id=basionym),
        into(relations, name_id=F.col("name_id"), related_id=basionym, type=F.lit("BASIONYM")),
        checked,
    )


def edit_relations(relations: DataFrame, changes: DataFrame, actor: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Relations (name_id, related_id, type, modified, modified_by) after changes (op link or unlink), and the changes with ``outcome``.

    A relation's identity is its names and type: one that is there isn't linked
    again, so a batch that is sent twice changes nothing the second time.
    """
    key = ["name_id", "related_id", "type"]
    rows = _again(changes, key, F.count("*") > 1)
    known = relations.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    rows = rows.join(known, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    there, link = F.col("_name_id").isNotNull(), F.col("op") == "link"
    outcome = (
        F.when(empty(F.col("name_id")) | empty(F.col("related_id")) | empty(F.col("type")), "incomplete")
        .when(link & (F.col("name_id") == F.col("related_id")), "self")
        .when(F.col("_bad"), "repeated")
        .when(link & there, "exists")
        .when(~link & ~there, "missing")
        .otherwise(APPLIED)
    )
    checked = rows.withColumn("outcome", outcome).select(*changes.columns, "outcome")
    good = checked.where(F.col("outcome") == APPLIED)
    left = relations.join(good.where("op = 'unlink'").select(*key), key, "left_anti").select(*relations.columns)
    return left.unionByName(_stamp(good.where("op = 'link'").select(*key), actor, now), allowMissingColumns=True), checked


def _lacking(role: Column, given: Column, family: Column, email: Column) -> Column:
    """Whether an agent lacks what its role requires: a person's names but of publishers, an address of contacts."""
    return ((role != "publisher") & (empty(given) | empty(family))) | ((role == "contact") & empty(email))


def edit_agents(agents: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Agents (role, id, given, family, email, note, …) after a batch, and the changes with ``outcome`` and ``new_id``.

    Changes (seq, op, role, id, to_role, keep_note, given, family, email, note):
    ``create`` and ``update`` set the fields, ``delete`` removes a row, ``copy`` adds
    it under ``to_role``, ``move`` also removes it here.  A note is blanked on the
    way unless ``keep_note``.  New rows get the ids after the role's highest, in the
    order of ``seq``.  A row has one update, delete or move in a batch.
    """
    fields = ["given", "family", "email", "note"]
    ends = F.count_if(F.col("op").isin("update", "delete", "move"))
    rows = _again(changes, ["role", "id"], ends > 1)
    old = agents.select(F.col("role").alias("_role"), F.col("id").alias("_id"), F.struct(*agents.columns).alias("_row"))
    rows = rows.join(old, (F.col("role") == F.col("_role")) & (F.col("id") == F.col("_id")), "left")
    op = F.col("op")
    carried = op.isin("copy", "move")
    target = F.when(carried, F.col("to_role")).otherwise(F.col("role"))
    value = lambda c: F.when(carried, F.col(f"_row.{c}")).otherwise(F.col(c))
    outcome = (
        F.when(~text(F.col("role")).isin(ROLES) | ~text(target).isin(ROLES), "role")
        .when((op != "create") & F.col("id").isNull(), "incomplete")
        .when((op == "move") & (F.col("role") == F.col("to_role")), "self")
        .when(op.isin("update", "delete", "move") & F.col("_bad"), "repeated")
        .when((op != "create") & F.col("_id").isNull(), "missing")
        .when((op != "delete") & _lacking(target, value("given"), value("family"), value("email")), "incomplete")
        .otherwise(APPLIED)
    )
    rows = rows.withColumn("outcome", outcome).withColumn("_target", target)
    makes = (F.col("outcome") == APPLIED) & op.isin("create", "copy", "move")
    top = agents.groupBy(F.col("role").alias("_r")).agg(F.max("id").alias("_top"))  # a row per role
    new = rows.where(makes).withColumn("_n", F.row_number().over(Window.partitionBy("_target").orderBy("seq")))
    new = new.join(top, F.col("_target") == F.col("_r"), "left").withColumn("new_id", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast(agents.schema["id"].dataType))
    note = F.when(~carried, F.col("note")).when(F.col("keep_note"), F.col("_row.note")).otherwise("")
    made = new.select(
        *[{"role": F.col("_target"), "id": F.col("new_id"), "note": note}.get(c, value(c) if c in fields else F.when(carried, F.col(f"_row.{c}"))).alias(c) for c in agents.columns]
    )
    good = rows.where(F.col("outcome") == APPLIED)
    gone = good.where(op.isin("delete", "move", "update")).select("role", "id")
    updated = good.where("op = 'update'").select(*[F.col(c) if c in (*fields, "role", "id") else F.col(f"_row.{c}").alias(c) for c in agents.columns])
    after = agents.join(gone, ["role", "id"], "left_anti").select(*agents.columns).unionByName(updated).unionByName(made)
    checked = rows.where(~makes).select(*changes.columns, "outcome", F.lit(None).cast(agents.schema["id"].dataType).alias("new_id"))
    return after, checked.unionByName(new.select(*changes.columns, "outcome", "new_id"))


def seed(terms: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """The vocabulary with the terms that it doesn't have; those that are there stay as they are."""
    fresh = more.dropDuplicates([key]).join(terms, key, "left_anti")
    return terms.unionByName(fresh.select(*more.columns), allowMissingColumns=True)


def code_for_parent(parents: DataFrame, taxa: DataFrame, names: DataFrame) -> DataFrame:
    """The nomenclatural code of each parent's name (id, code), '' where it isn't known: what a new child starts with."""
    own = taxa.select("id", "name_id")
    code = names.select(F.col("id").alias("name_id"), "code_id")
    return parents.select("id").join(own, "id", "left").join(code, "name_id", "left").select("id", text(F.col("code_id")).alias("code"))


def touch(metadata: DataFrame, touched: DataFrame, actor: str, now: str) -> DataFrame:
    """Which metadata rows were changed when and by whom (id, modified, modified_by): those ``touched`` (id) anew, rows without an entry added empty."""
    rows = metadata.select("id", *[F.col(c) if c in metadata.columns else F.lit("").alias(c) for c in ("modified", "modified_by")])
    hit = touched.select(F.col("id").alias("_hit")).distinct()
    joined = rows.join(hit, F.col("id") == F.col("_hit"), "left")
    new = F.col("_hit").isNotNull()
    return joined.select("id", F.when(new, now).otherwise(text(F.col("modified"))).alias("modified"), F.when(new, actor).otherwise(text(F.col("modified_by"))).alias("modified_by"))
