"""Incremental state: what a run found against the index, freshness, health, and figures over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.operators import evaluate, filters, snapshots
from inkgrove.operators.current import newest_listing
from inkgrove.plans.common import CUR, HASH, KEY, notes_now
from inkgrove.sources.tables import table

EARLIER, LATER = 4, 6


def _listing(spark: SparkSession, d: str, run: int) -> DataFrame:
    return newest_listing(table(spark, d, "vault_scan"), run).select(F.col("key").alias("rel_path"), "content_hash", "mtime")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return notes_now(spark, d, "mtime").select(F.col("key").alias("rel_path"), "content_hash", "mtime")


def change_diff(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_kinds(_listing(spark, d, LATER), _listing(spark, d, EARLIER))


def change_diff_reconfigured(spark: SparkSession, d: str) -> DataFrame:
    """A changed configuration makes everything that is there change."""
    return snapshots.run_counts(snapshots.change_kinds(_listing(spark, d, LATER), _index(spark, d), config_changed=True))


def run_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.run_counts(snapshots.change_kinds(_listing(spark, d, LATER), _index(spark, d)))


def deleted_notes(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.deleted(_listing(spark, d, LATER), _index(spark, d))


def freshness(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.freshness(_listing(spark, d, LATER), _index(spark, d))


def merged_index(spark: SparkSession, d: str) -> DataFrame:
    """The later listing's new and changed notes put in place of the earlier ones, deleted ones gone."""
    old, new = _listing(spark, d, EARLIER), _listing(spark, d, LATER)
    touched = snapshots.change_kinds(new, old).where("change <> 'unchanged'")
    fresh = new.join(touched.where("change <> 'deleted'"), "rel_path", "left_semi")
    return snapshots.merge(old, fresh, touched).select("rel_path", "content_hash")


def health_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.health(notes_now(spark, d, "skip_reason"), table(spark, d, "chunks"), table(spark, d, "vec_chunks"), freshness(spark, d))


def tag_filter(spark: SparkSession, d: str) -> DataFrame:
    return notes_now(spark, d, "tags").where(filters.has_tags(F.col("tags"), "#boat, Tools")).select("rel_path")


def status_filter(spark: SparkSession, d: str) -> DataFrame:
    return notes_now(spark, d, "status").where(filters.has_status(F.col("status"), "verified, blocked")).select("rel_path", "status")


def chunks_of_notes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose note has both filters' tags and state, as a semi join."""
    from inkgrove.plans.common import chunks_now

    return filters.of_notes(chunks_now(spark, d), notes_now(spark, d, "tags", "status"), "kiln", "verified,active,draft", "key").select("id", "rel_path")


def recent_notes(spark: SparkSession, d: str) -> DataFrame:
    return filters.recent(notes_now(spark, d, "mtime").where("mtime < 1e10"), folder="server", limit=20).select("rel_path", "mtime")


def skipped_notes(spark: SparkSession, d: str) -> DataFrame:
    return notes_now(spark, d, "skip_reason").where("skip_reason is not null").select("rel_path", "skip_reason")


def chunk_count_drift(spark: SparkSession, d: str) -> DataFrame:
    """Notes whose recorded chunk count is not what the chunk table holds."""
    from inkgrove.plans.common import chunks_now

    real = chunks_now(spark, d).where("key <> ''").groupBy("key").agg(F.count("*").alias("n"))
    both = notes_now(spark, d, "chunk_count").join(real, "key", "left").select("rel_path", F.col("chunk_count").cast("bigint").alias("recorded"), F.coalesce("n", F.lit(0)).alias("held"))
    return both.where(~F.col("recorded").eqNullSafe(F.col("held")))


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency_stats(table(spark, d, "events"), "value", "event_type")


def score_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.score_quantiles(table(spark, d, "events"), "value", "event_type")


def event_days(spark: SparkSession, d: str) -> DataFrame:
    """The event log by day and kind, as the batch twin of the streaming count."""
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def stream_event_days(spark: SparkSession, d: str) -> DataFrame:
    from inkgrove.streaming.feeds import daily_counts_stream

    return daily_counts_stream(spark, d)


def stream_chunks(spark: SparkSession, d: str) -> DataFrame:
    from inkgrove.streaming.feeds import chunk_stream

    return chunk_stream(spark, d)


QUERIES = {
    "change_diff": change_diff, "change_diff_reconfigured": change_diff_reconfigured, "run_counts": run_counts, "deleted_notes": deleted_notes, "freshness": freshness,
    "merged_index": merged_index, "health_counts": health_counts, "tag_filter": tag_filter, "status_filter": status_filter, "chunks_of_notes": chunks_of_notes,
    "recent_notes": recent_notes, "skipped_notes": skipped_notes, "chunk_count_drift": chunk_count_drift, "latency_stats": latency_stats, "score_quantiles": score_quantiles,
    "event_days": event_days, "stream_event_days": stream_event_days, "stream_chunks": stream_chunks,
}


def _listing_sql(name: str, run: int) -> str:
    return f"{name} AS (SELECT key AS rel_path, r.h AS content_hash, r.m AS mtime FROM (SELECT {KEY.format('rel_path')} AS key, arg_max(struct_pack(h := {HASH.format('content_hash')}, m := mtime), (seen_at, {HASH.format('content_hash')}, mtime)) AS r FROM vault_scan WHERE run_id = {run} AND rel_path IS NOT NULL GROUP BY 1))"


_IDX = "idx AS (SELECT key AS rel_path, content_hash, mtime FROM cur)"
_KINDS = "(SELECT coalesce(a.rel_path, b.rel_path) AS rel_path, CASE WHEN a.rel_path IS NULL THEN 'deleted' WHEN b.rel_path IS NULL THEN 'new' WHEN a.content_hash IS NULL THEN 'unchanged' WHEN {2} AND a.content_hash IS NOT DISTINCT FROM b.content_hash AND coalesce(abs(a.mtime - b.mtime) < 0.001, a.mtime IS NOT DISTINCT FROM b.mtime) THEN 'unchanged' ELSE 'changed' END AS change FROM {0} a FULL JOIN {1} b ON a.rel_path = b.rel_path)"
_AB = f"{_listing_sql('early', EARLIER)}, {_listing_sql('late', LATER)}"
_FRESH = "SELECT * FROM (SELECT coalesce(a.rel_path, b.rel_path) AS rel_path, CASE WHEN a.rel_path IS NULL THEN 'deleted' WHEN b.rel_path IS NULL OR coalesce(abs(a.mtime - b.mtime) > 0.001, a.mtime IS DISTINCT FROM b.mtime) THEN 'pending' END AS state FROM late a FULL JOIN idx b ON a.rel_path = b.rel_path) WHERE state IS NOT NULL"
_ORD = "e AS (SELECT event_type, value::DOUBLE AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)"

SQL = {
    "change_diff": f"WITH {_AB} SELECT * FROM {_KINDS.format('late', 'early', 'true')}",
    "change_diff_reconfigured": f"WITH {CUR}, {_IDX}, {_AB} SELECT change, count(*) AS n FROM {_KINDS.format('late', 'idx', 'false')} GROUP BY 1",
    "run_counts": f"WITH {CUR}, {_IDX}, {_AB} SELECT change, count(*) AS n FROM {_KINDS.format('late', 'idx', 'true')} GROUP BY 1",
    "deleted_notes": f"WITH {CUR}, {_IDX}, {_AB} SELECT rel_path FROM idx ANTI JOIN late USING (rel_path)",
    "freshness": f"WITH {CUR}, {_IDX}, {_AB} {_FRESH}",
    "merged_index": f"WITH {_AB}, k AS (SELECT * FROM {_KINDS.format('late', 'early', 'true')} WHERE change <> 'unchanged') SELECT rel_path, content_hash FROM early ANTI JOIN k USING (rel_path) UNION ALL SELECT rel_path, content_hash FROM late SEMI JOIN (SELECT * FROM k WHERE change <> 'deleted') USING (rel_path)",
    "health_counts": f"WITH {CUR}, {_IDX}, {_AB}, c AS (SELECT (SELECT count(*) FROM cur WHERE skip_reason IS NULL) AS indexed, (SELECT count(*) FROM cur WHERE skip_reason IS NOT NULL) AS skipped, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM vec_chunks) AS vectors, (SELECT count(*) FROM ({_FRESH})) AS stale) SELECT *, CASE WHEN stale > 0 THEN 'STALE' WHEN chunks <> vectors THEN 'INCONSISTENT' ELSE 'OK' END AS state FROM c",
    "tag_filter": f"WITH {CUR} SELECT rel_path FROM cur WHERE list_contains(tags, 'boat') AND list_contains(tags, 'tools')",
    "status_filter": f"WITH {CUR} SELECT rel_path, status FROM cur WHERE status IN ('verified', 'blocked')",
    "chunks_of_notes": f"WITH {CUR}, kept AS (SELECT key FROM cur WHERE list_contains(tags, 'kiln') AND status IN ('verified', 'active', 'draft')), c AS (SELECT id, {KEY.format('rel_path')} AS key, nfc_normalize(regexp_replace(trim(replace(rel_path, '{chr(92)}', '/')), '^({chr(92)}./)+', '')) AS rel_path FROM chunks) SELECT id, rel_path FROM c SEMI JOIN kept USING (key)",
    "recent_notes": f"WITH {CUR} SELECT rel_path, mtime FROM cur WHERE mtime < 1e10 AND starts_with(rel_path, 'server/') ORDER BY mtime DESC, rel_path DESC LIMIT 20",
    "skipped_notes": f"WITH {CUR} SELECT rel_path, skip_reason FROM cur WHERE skip_reason IS NOT NULL",
    "chunk_count_drift": f"WITH {CUR}, n AS (SELECT {KEY.format('rel_path')} AS key, count(*) AS n FROM chunks WHERE rel_path IS NOT NULL GROUP BY 1) SELECT rel_path, chunk_count::BIGINT AS recorded, coalesce(n, 0) AS held FROM cur LEFT JOIN n USING (key) WHERE chunk_count::BIGINT IS DISTINCT FROM coalesce(n, 0)",
    "latency_stats": f"WITH {_ORD} SELECT event_type, max(n) AS n, round(avg(v), 6) AS avg_ms, max(v) FILTER (WHERE pos = floor(0.95 * (n - 1))::BIGINT + 1) AS p95_ms FROM e GROUP BY 1",
    "score_quantiles": f"WITH {_ORD}, j AS (SELECT *, least(greatest(floor(0.1 * (n + 1))::BIGINT, 1), n - 1) AS j FROM e) SELECT event_type, max(n) AS n, min(v) AS low, round(CASE WHEN max(n) > 1 THEN max(v) FILTER (WHERE pos = j) + (max(v) FILTER (WHERE pos = j + 1) - max(v) FILTER (WHERE pos = j)) * max(0.1 * (n + 1) - j)::DOUBLE END, 6) AS p10, round(median(v), 6) AS median, max(v) AS high FROM j GROUP BY 1",
    "event_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_event_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
