"""References to records that do not exist.

Parent keys and child references are tagged and unioned in long form, grouped by key space and key, and the groups
without a parent flag are the orphans. Two shapes come out: counts per table, field and period (``orphan_report``), for
which one pre-aggregated shuffle is enough, and the referring rows themselves (``orphan_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.paths import path_key
from inkgrove.operators.hot import hot_join

#: Key spaces: a whole path, or any tail of it without ``.md``.
PATH, TAIL = "path", "tail"
#: Endings of attachments, as documented: a reference with one of them is none to a note.
ATTACHMENTS = ("png", "pdf", "jpg")


def existing_notes(notes: DataFrame) -> DataFrame:
    """``key`` of every note whose newest row (greatest ``indexed_at``, then ``id``) carries no ``deleted_at``.

    Null paths name no note. A null ``indexed_at`` counts as oldest. Columns beside those four are ignored.
    """
    newest = F.max(F.struct(F.col("indexed_at"), F.col("id"), F.col("deleted_at").isNull().alias("alive"))).alias("newest")
    keyed = notes.select(path_key(F.col("rel_path")).alias("key"), "indexed_at", "id", "deleted_at").where(F.col("key").isNotNull())
    return keyed.groupBy("key").agg(newest).where("newest.alive").select("key")


def _bare(key: Column) -> Column:
    return F.regexp_replace(key, r"\.md$", "")


def parent_keys(notes: DataFrame) -> DataFrame:
    """``(space, key)``: each existing note by its whole path and by every tail that begins after a slash."""
    keys = existing_notes(notes)
    parts = F.split(_bare(F.col("key")), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    return keys.select(F.lit(PATH).alias("space"), "key").unionByName(keys.select(F.lit(TAIL).alias("space"), F.explode(tails).alias("key")).distinct())


def _children(df: DataFrame, table: str, field: str, space: str, when: str, only: Column | None = None) -> DataFrame:
    if only is not None:
        df = df.where(only)
    key = path_key(F.col(field))
    out = df.where(F.col(field).isNotNull()).select(
        F.lit(table).alias("src_table"), F.lit(field).alias("src_field"), F.lit(space).alias("space"), key.alias("key"),
        F.col("id").alias("row_id"), F.date_format(when, "yyyy-MM").alias("period"),
    )
    if space == TAIL:  # another file ending is a reference to an attachment
        out = out.where(~F.col("key").rlike(rf"\.({'|'.join(ATTACHMENTS)})$")).withColumn("key", _bare(F.col("key")))
    return out.where(F.col("key") != "")


def note_references(chunks: DataFrame, lint: DataFrame) -> DataFrame:
    """All references to notes in long form ``(src_table, src_field, space, key, row_id, period)``.

    Null and blank values refer to nothing. A null time gives a null ``period``.
    """
    return (
        _children(chunks, "chunks", "rel_path", PATH, "indexed_at")
        .unionByName(_children(lint, "lint_report", "rel_path", PATH, "reported_at"))
        .unionByName(_children(lint, "lint_report", "detail", TAIL, "reported_at", F.col("kind") == "broken"))
    )


def _groups(parents: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per ``(space, key)`` without a parent: the counts of its references by table, field and period.

    The first aggregation folds every hot key to a handful of rows (fields times periods) before anything is gathered,
    so the lists are bounded by the calendar, not by the data.
    """
    tagged = refs.select("space", "key", "src_table", "src_field", "period", F.lit(0).alias("is_parent"), F.lit(1).alias("n")).unionByName(
        parents.select("space", "key", F.lit(None).cast("string").alias("src_table"), F.lit(None).cast("string").alias("src_field"), F.lit(None).cast("string").alias("period"), F.lit(1).alias("is_parent"), F.lit(0).alias("n"))
    )
    folded = tagged.groupBy("space", "key", "src_table", "src_field", "period").agg(F.max("is_parent").alias("is_parent"), F.sum("n").alias("n"))
    return folded.groupBy("space", "key").agg(F.max("is_parent").alias("is_parent"), F.collect_list(F.struct("src_table", "src_field", "period", "n")).alias("counts")).where("is_parent = 0").drop("is_parent")


def orphan_report(parents: DataFrame, refs: DataFrame) -> DataFrame:
    """``(src_table, src_field, period, n_refs, n_keys)``: orphan references and distinct missing keys."""
    return (
        _groups(parents, refs).select("space", "key", F.explode("counts").alias("c"))
        .groupBy("c.src_table", "c.src_field", "c.period")
        .agg(F.sum("c.n").alias("n_refs"), F.count("*").alias("n_keys"))
    )


def orphan_rows(parents: DataFrame, refs: DataFrame, **options) -> DataFrame:
    """``(src_table, src_field, row_id, period)`` of every reference whose group lacks a parent.

    One missing key may hold a third of all rows: references to such a key are dealt over as many salts as their number asks
    for, so no key lands in one task (``options`` go to ``hot_join``).
    """
    return hot_join(refs, _groups(parents, refs).select("space", "key"), ["space", "key"], "left_semi", **options).select("src_table", "src_field", "row_id", "period")
