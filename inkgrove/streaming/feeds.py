"""Append-only feeds with Structured Streaming: note drops that become chunks, and counts over the event log.

A file source doesn't emit a file again when it changes, so these serve drops that are only added to; changed notes go
through ``operators.merkle`` or ``operators.snapshots``. Checkpoints lie in the shared folder, sinks are written by
batch id, and a restarted query repeats no batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.operators.notes import chunk_notes
from inkgrove.runtime import scratch


def _source(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Every Parquet file of a table as it appears; the schema is read once."""
    if not path.endswith("/"):
        path = path.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    folder = path if _is_folder(spark, path) else path.rsplit("/", 1)[0]
    return reader.option("pathGlobFilter", "*.parquet" if folder == path else path.rsplit("/", 1)[1]).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _drain(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs until all that is there now has been read."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(stream.sparkSession, "feed")).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def chunk_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of a drop of documents, written batch by batch: ``(doc_id, ordinal, heading, line_start, line_end)``."""
    out = scratch(spark, "chunks")

    def each(batch: DataFrame, number: int) -> None:
        chunks = chunk_notes(batch.select(F.col("doc_id").cast("string").alias("key"), "text"), key="key")
        chunks.select(F.col("key").cast("bigint").alias("doc_id"), "ordinal", "heading", "line_start", "line_end").write.mode("overwrite").parquet(f"{out}/batch={number}")

    _drain(_source(spark, f"{folder}/documents.parquet"), each)
    return spark.read.parquet(out).drop("batch")


def daily_counts(events: DataFrame) -> DataFrame:
    """``(day, event_type, n)`` by the date of the event, which has no zone; no event is too late to count. The state is a
    number per day and kind."""
    return events.groupBy(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


def daily_counts_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The counts after all events, from the latest update of each day and kind."""
    out = scratch(spark, "days")

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("at", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _drain(daily_counts(_source(spark, f"{folder}/events.parquet")), each, "update")
    return spark.read.parquet(out).groupBy("day", "event_type").agg(F.max_by("n", "at").alias("n"))
