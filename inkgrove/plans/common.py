"""Inputs and SQL fragments that several plan modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.functions.paths import display_path, path_key
from inkgrove.operators.current import current_notes
from inkgrove.sources.tables import table

KEY = r"lower(nfc_normalize(regexp_replace(trim(replace({0}, '\', '/')), '^(\./)+', '')))"
PATH = r"nfc_normalize(regexp_replace(trim(replace({0}, '\', '/')), '^(\./)+', ''))"
HASH = r"nullif(regexp_replace(lower(trim({0})), '^[a-z][a-z0-9_-]*[:=]', ''), '')"

#: cur: the notes as they stand.
CUR = rf"""cur AS (
  SELECT key, r.* FROM (
    SELECT {KEY.format("rel_path")} AS key, arg_max(struct_pack(rel_path := {PATH.format("rel_path")}, content_hash := {HASH.format("content_hash")}, alive := deleted_at IS NULL,
      title := title, summary := summary, tags := tags, status := status, mtime := mtime, skip_reason := skip_reason, chunk_count := chunk_count), (indexed_at, id)) AS r
    FROM notes WHERE rel_path IS NOT NULL GROUP BY 1) WHERE r.alive)"""

#: ch: the chunks with their path as displayed and its key; a null path is ''.
CH = rf"""ch AS (SELECT id, coalesce({PATH.format("rel_path")}, '') AS rel_path, coalesce({KEY.format("rel_path")}, '') AS key, title, heading, summary, chunk_text, line_start, line_end FROM chunks)"""


def notes_now(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The notes as they stand, with the columns named."""
    return current_notes(table(spark, d, "notes"), columns)


def chunks_now(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.select(
        "id", F.coalesce(display_path(F.col("rel_path")), F.lit("")).alias("rel_path"), F.coalesce(path_key(F.col("rel_path")), F.lit("")).alias("key"), "title", "heading", "summary", "chunk_text", "line_start", "line_end"
    )


def golden(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query", "expected")
