"""Feeds: late data, restarts over growing folders."""

import datetime as dt

from pyspark.sql import functions as F

from inkgrove.streaming import feeds


def test_daily_counts_and_late_rows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(hours=h), k) for h in range(0, 96, 6) for k in ("a", "b")]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string").write.parquet(f"file://{tmp_path}/events.parquet")
    got = {(r.day, r.event_type): r.n for r in feeds.daily_counts_stream(spark, f"file://{tmp_path}").collect()}
    assert got == {(f"2024-01-0{d}", k): 4 for d in range(1, 5) for k in "ab"}


def test_chunk_stream(spark, tmp_path):
    spark.createDataFrame([(1, "# A\n\nsome text that is long enough to stay\n\n# B\n\nmore text that is long enough too"), (2, None), (3, "")], "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    out = feeds.chunk_stream(spark, f"file://{tmp_path}")
    assert [(r.doc_id, r.heading, r.line_start, r.line_end) for r in out.orderBy("ordinal").collect()] == [(1, "A", 1, 3), (1, "B", 5, 7)]
    assert out.where(F.col("doc_id") > 1).count() == 0
