"""Snapshots of an index: what changed between two, freshness, merging, and publishing a new one atomically."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds by which two modification times may differ and still be the same.
MTIME_TOLERANCE = 0.001


def change_kinds(scan: DataFrame, index: DataFrame, config_changed: bool = False) -> DataFrame:
    """``(rel_path, change)`` with change new, changed, unchanged or deleted: one full outer join of the two listings.

    Unchanged means the same hash, the same mtime within a millisecond, and the same configuration. A scanned file that
    couldn't be read (null hash) is still there, so it's unchanged, or new without content.
    """
    a = scan.select("rel_path", F.col("content_hash").alias("h"), F.col("mtime").alias("m"), F.lit(True).alias("on_disk"))
    b = index.select("rel_path", F.col("content_hash").alias("old_h"), F.col("mtime").alias("old_m"), F.lit(True).alias("indexed"))
    same = F.col("h").eqNullSafe(F.col("old_h")) & F.coalesce(F.abs(F.col("m") - F.col("old_m")) < MTIME_TOLERANCE, F.col("m").eqNullSafe(F.col("old_m")))
    kind = (
        F.when(F.col("on_disk").isNull(), "deleted").when(F.col("indexed").isNull(), "new")
        .when(F.col("h").isNull(), "unchanged").when(same & F.lit(not config_changed), "unchanged").otherwise("changed")
    )
    return a.join(b, "rel_path", "full_outer").select("rel_path", kind.alias("change"))


def run_counts(changes: DataFrame) -> DataFrame:
    """``(change, n)``."""
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def deleted(scan: DataFrame, index: DataFrame) -> DataFrame:
    """``(rel_path)`` indexed but no longer there."""
    return index.select("rel_path").join(scan.select("rel_path"), "rel_path", "left_anti")


def freshness(scan: DataFrame, index: DataFrame) -> DataFrame:
    """``(rel_path, state)`` of what the index is behind on: pending (new, or another mtime) and deleted."""
    a = scan.select("rel_path", F.col("mtime").alias("m"), F.lit(True).alias("on_disk"))
    b = index.select("rel_path", F.col("mtime").alias("old_m"), F.lit(True).alias("indexed"))
    moved = F.coalesce(F.abs(F.col("m") - F.col("old_m")) > MTIME_TOLERANCE, ~F.col("m").eqNullSafe(F.col("old_m")))
    state = F.when(F.col("on_disk").isNull(), "deleted").when(F.col("indexed").isNull() | moved, "pending")
    return a.join(b, "rel_path", "full_outer").select("rel_path", state.alias("state")).where(F.col("state").isNotNull())


def merge(old: DataFrame, new: DataFrame, touched: DataFrame, on: str = "rel_path") -> DataFrame:
    """Replaces the rows of touched notes: everything else of ``old``, and all of ``new``."""
    return old.join(touched.select(on).distinct(), on, "left_anti").unionByName(new)


def health(notes: DataFrame, chunks: DataFrame, vectors: DataFrame, stale: DataFrame) -> DataFrame:
    """One row: counts of the index and its state, STALE before INCONSISTENT before OK."""
    parts = {"indexed": notes.where("skip_reason is null"), "skipped": notes.where("skip_reason is not null"), "chunks": chunks, "vectors": vectors, "stale": stale}
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for name, df in parts.items()])
    one = counts.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts])
    state = F.when(F.col("stale") > 0, "STALE").when(F.col("chunks") != F.col("vectors"), "INCONSISTENT").otherwise("OK")
    return one.withColumn("state", state)
