"""Queries of problems 2 (orphan references) and 3 (new or changed records), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkgrove.operators import merkle, orphans
from inkgrove.sources.tables import table


def _p2(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return orphans.parent_keys(table(spark, d, "notes")), orphans.note_references(table(spark, d, "chunks"), table(spark, d, "lint_report"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_rows(*_p2(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(*_p2(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return merkle.changed_notes(table(spark, d, "notes"), table(spark, d, "vault_scan"), table(spark, d, "index_runs"))


_KEY = r"lower(nfc_normalize(regexp_replace(trim(replace({0}, '\', '/')), '^(\./)+', '')))"
_PATH = r"nfc_normalize(regexp_replace(trim(replace({0}, '\', '/')), '^(\./)+', ''))"
_HASH = r"nullif(regexp_replace(lower(trim({0})), '^[a-z][a-z0-9_-]*[:=]', ''), '')"

_P2_BASE = rf"""
WITH newest AS (
  SELECT {_KEY.format("rel_path")} AS key, arg_max(deleted_at IS NULL, (indexed_at, id)) AS alive
  FROM notes WHERE rel_path IS NOT NULL GROUP BY 1),
alive AS (SELECT key, string_split(regexp_replace(key, '\.md$', ''), '/') AS parts FROM newest WHERE alive),
parents AS (
  SELECT 'path' AS space, key FROM alive
  UNION SELECT 'tail', array_to_string(parts[i:], '/') FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM alive)),
refs AS (
  SELECT 'chunks' AS src_table, 'rel_path' AS src_field, 'path' AS space, {_KEY.format("rel_path")} AS key, id AS row_id, strftime(indexed_at, '%Y-%m') AS period
  FROM chunks WHERE rel_path IS NOT NULL
  UNION ALL
  SELECT 'lint_report', 'rel_path', 'path', {_KEY.format("rel_path")}, id, strftime(reported_at, '%Y-%m') FROM lint_report WHERE rel_path IS NOT NULL
  UNION ALL
  SELECT 'lint_report', 'detail', 'tail', regexp_replace(k, '\.md$', ''), id, strftime(reported_at, '%Y-%m')
  FROM (SELECT *, {_KEY.format("detail")} AS k FROM lint_report WHERE kind = 'broken' AND detail IS NOT NULL)
  WHERE NOT regexp_matches(k, '\.(png|pdf|jpg)$')),
orphan AS (SELECT r.* FROM refs r ANTI JOIN parents p ON r.space = p.space AND r.key = p.key WHERE r.key <> '')
"""

_P3 = rf"""
WITH RECURSIVE start AS (
  SELECT {_KEY.format("rel_path")} AS key, arg_max(struct_pack(a := deleted_at IS NULL, h := {_HASH.format("content_hash")}), (indexed_at, id)) AS r
  FROM notes WHERE rel_path IS NOT NULL GROUP BY 1),
plan AS (
  SELECT run_id, outcome, count(*) FILTER (WHERE outcome = 'ok') OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k
  FROM index_runs WHERE outcome = 'ok' OR outcome IS NULL),
seen AS (
  SELECT p.run_id, p.outcome, p.k, s.key, s.path, s.h FROM plan p JOIN (
    SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seen_at DESC NULLS LAST, h DESC NULLS LAST, path DESC) AS rn FROM (
      SELECT run_id, {_KEY.format("rel_path")} AS key, {_PATH.format("rel_path")} AS path, {_HASH.format("content_hash")} AS h, seen_at
      FROM vault_scan WHERE rel_path IS NOT NULL)) s ON p.run_id = s.run_id AND s.rn = 1),
state AS (
  SELECT 0::BIGINT AS k, key, r.h AS h FROM start WHERE r.a
  UNION ALL
  SELECT n.k + 1, n.key, coalesce(n.h, s.h) FROM seen n LEFT JOIN state s ON s.key = n.key AND s.k = n.k
  WHERE n.outcome = 'ok' AND n.k = (SELECT max(k) FROM state) AND (n.h IS NOT NULL OR s.key IS NOT NULL))
SELECT n.run_id, n.path AS rel_path FROM seen n LEFT JOIN state s ON s.k = n.k AND s.key = n.key
WHERE n.h IS NOT NULL AND (s.key IS NULL OR s.h IS DISTINCT FROM n.h)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found}

SQL = {
    "p2_found": _P2_BASE + "SELECT src_table, src_field, row_id, period FROM orphan",
    "p2_report": _P2_BASE + "SELECT src_table, src_field, period, count(*) AS n_refs, count(DISTINCT key) AS n_keys FROM orphan GROUP BY ALL",
    "p3_found": _P3,
}
