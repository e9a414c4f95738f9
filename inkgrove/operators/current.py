"""The notes as they stand: one row per path from a table that keeps every version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.paths import display_path, hash_key, path_key

KEPT = ("title", "summary", "tags", "status", "mtime", "skip_reason", "chunk_count")


def current_notes(notes: DataFrame, columns: tuple[str, ...] = KEPT) -> DataFrame:
    """``(key, rel_path, content_hash, *columns)`` of the newest row of each path (greatest ``indexed_at``, then ``id``) unless it is deleted.

    Name the columns that are needed: what goes into the aggregate can't be pruned later.
    """
    row = F.struct(display_path(F.col("rel_path")).alias("rel_path"), hash_key(F.col("content_hash")).alias("content_hash"), F.col("deleted_at").isNull().alias("alive"), *columns)
    keyed = notes.where(F.col("rel_path").isNotNull()).select(path_key(F.col("rel_path")).alias("key"), row.alias("row"), F.struct("indexed_at", "id").alias("age"))
    return keyed.groupBy("key").agg(F.max_by("row", "age").alias("row")).where("row.alive").select("key", "row.rel_path", "row.content_hash", *[f"row.{c}" for c in columns])


def newest_listing(scan: DataFrame, run_id: int) -> DataFrame:
    """``(key, rel_path, content_hash, mtime)``: what one run saw, the latest row of each path."""
    row = F.struct(F.col("seen_at"), hash_key(F.col("content_hash")).alias("content_hash"), F.col("mtime"), display_path(F.col("rel_path")).alias("rel_path"))
    keyed = scan.where((F.col("run_id") == run_id) & F.col("rel_path").isNotNull()).select(path_key(F.col("rel_path")).alias("key"), row.alias("row"))
    return keyed.groupBy("key").agg(F.max("row").alias("row")).select("key", "row.rel_path", "row.content_hash", "row.mtime")
