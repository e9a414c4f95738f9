"""The link graph over the links table and the notes as they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.config import STATUS_VALUES
from inkgrove.operators import filters, links
from inkgrove.plans.common import CUR, KEY, notes_now
from inkgrove.sources.tables import table


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "links"), notes_now(spark, d, "status")


def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    return links.resolve_targets(*_both(spark, d))


def link_kinds(spark: SparkSession, d: str) -> DataFrame:
    r = links.resolved_links(*_both(spark, d))
    kind = F.when(F.col("how").isNotNull(), F.col("how")).when(links.attachment(F.col("target")), "attachment").otherwise("broken")
    return r.groupBy(kind.alias("kind"), "embed").agg(F.count("*").alias("n"))


def backlinks(spark: SparkSession, d: str) -> DataFrame:
    return links.backlinks(*_both(spark, d))


def backlink_listing(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty backlinks of each note in walking order."""
    from pyspark.sql import Window

    b = links.backlinks(*_both(spark, d)).withColumn("walk", filters.walk_key(F.col("src_rel")))
    return b.withColumn("rank", F.row_number().over(Window.partitionBy("rel_path").orderBy("walk", "line_no")).cast("bigint")).where("rank <= 50").drop("walk")


def inbound_counts(spark: SparkSession, d: str) -> DataFrame:
    return links.inbound(*_both(spark, d))


def broken_links(spark: SparkSession, d: str) -> DataFrame:
    return links.broken_links(*_both(spark, d))


def broken_beside_files(spark: SparkSession, d: str) -> DataFrame:
    """Broken links where files are known: an attachment is broken only if no file has its name. The files here are those that embeds name."""
    held, notes = _both(spark, d)
    files = held.where("embed").select(links.file_name(F.col("target")).alias("name_lower")).distinct()
    return links.broken_links(held, notes, files)


def content_map(spark: SparkSession, d: str) -> DataFrame:
    return links.content_map(*_both(spark, d))


def orphan_notes(spark: SparkSession, d: str) -> DataFrame:
    return links.orphan_notes(*_both(spark, d))


def hub_notes(spark: SparkSession, d: str) -> DataFrame:
    return notes_now(spark, d).where(filters.is_hub_name(F.col("rel_path"))).select("rel_path")


def without_hub(spark: SparkSession, d: str) -> DataFrame:
    return links.without_hub(*_both(spark, d))


def bad_status(spark: SparkSession, d: str) -> DataFrame:
    return links.bad_status(notes_now(spark, d, "status"))


def lint_counts(spark: SparkSession, d: str) -> DataFrame:
    return links.lint(*_both(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


def lint_listing(spark: SparkSession, d: str) -> DataFrame:
    return links.lint_listing(links.lint(*_both(spark, d)), 30).select("kind", "rel_path", "detail", F.col("rank").cast("bigint").alias("rank"), "total")


def stem_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    """How many notes share each bare name; a link by name is safe only where it is one."""
    return links.note_keys(notes_now(spark, d)).groupBy(F.element_at(F.split("noext", "/"), -1).alias("name")).agg(F.count("*").alias("n"))


QUERIES = {
    "resolve_links": resolve_links, "link_kinds": link_kinds, "backlinks": backlinks, "backlink_listing": backlink_listing, "inbound_counts": inbound_counts,
    "broken_links": broken_links, "broken_beside_files": broken_beside_files, "content_map": content_map, "orphan_notes": orphan_notes, "hub_notes": hub_notes, "without_hub": without_hub,
    "bad_status": bad_status, "lint_counts": lint_counts, "lint_listing": lint_listing, "stem_uniqueness": stem_uniqueness,
}

_TKEY = rf"regexp_replace({KEY}, '\.md$', '')"
_WALK = "array_to_string(list_transform(string_split({0}, '/'), lambda p, i: CASE WHEN i = len(string_split({0}, '/')) THEN '0' ELSE '1' END || p), chr(1))"
_HUB = r"(regexp_replace(lower(string_split({0}, '/')[-1]), '\.md$', '') IN ('readme', 'index', 'inbox', 'hub') OR ends_with(regexp_replace(lower(string_split({0}, '/')[-1]), '\.md$', ''), 'index') OR ends_with(regexp_replace(lower(string_split({0}, '/')[-1]), '\.md$', ''), '-hub') OR contains(regexp_replace(lower(string_split({0}, '/')[-1]), '\.md$', ''), 'overview'))"
_NAME = r"string_split(trim(replace({0}, '\', '/')), '/')[-1]"
_ATTACH = rf"(regexp_matches({_NAME}, '^.+\.[^./]+$') AND NOT ends_with(lower({_NAME}), '.md'))"

_BASE = rf"""WITH {CUR},
nk AS (SELECT DISTINCT rel_path, {_TKEY.format("rel_path")} AS noext, len(string_split(rel_path, '/')) - 1 AS depth, {_WALK.format("rel_path")} AS walk FROM cur),
whole AS (SELECT noext, arg_max(rel_path, walk) AS by_path FROM nk GROUP BY 1),
tails AS (SELECT tail, arg_min(rel_path, walk) AS by_tail FROM (
  SELECT rel_path, walk, array_to_string(p[i:], '/') AS tail FROM (SELECT rel_path, walk, string_split(noext, '/') AS p, unnest(range(2, len(string_split(noext, '/')) + 1)) AS i FROM nk)) WHERE contains(tail, '/') GROUP BY 1),
names AS (SELECT string_split(noext, '/')[-1] AS name, arg_min(rel_path, (depth, rel_path)) AS by_name FROM nk GROUP BY 1),
res AS (SELECT target, coalesce(by_path, by_tail, by_name) AS resolved, CASE WHEN by_path IS NOT NULL THEN 'path' WHEN by_tail IS NOT NULL THEN 'tail' WHEN by_name IS NOT NULL THEN 'name' END AS how FROM (
  SELECT DISTINCT target, {_TKEY.format("target")} AS key FROM links WHERE target IS NOT NULL) t
  LEFT JOIN whole ON t.key = whole.noext LEFT JOIN tails ON t.key = tails.tail LEFT JOIN names ON t.key = names.name AND NOT contains(t.key, '/')),
rl AS (SELECT l.*, nk.rel_path AS src, res.resolved, res.how FROM links l LEFT JOIN nk ON {_TKEY.format("l.src_rel")} = nk.noext LEFT JOIN res ON l.target = res.target),
back AS (SELECT DISTINCT resolved AS rel_path, src AS src_rel, line_no FROM rl WHERE resolved IS NOT NULL AND src IS NOT NULL AND src <> resolved),
inb AS (SELECT rel_path, count(*) AS n FROM (SELECT DISTINCT resolved AS rel_path, coalesce(src, src_rel) AS s, trim(target) AS t FROM rl WHERE resolved IS NOT NULL AND (src IS NULL OR src <> resolved)) GROUP BY 1),
broken AS (SELECT DISTINCT coalesce(src, src_rel) AS rel_path, trim(target) AS target FROM rl WHERE {_ATTACH.format("target")} OR resolved IS NULL),
moc AS (SELECT DISTINCT resolved AS rel_path FROM rl WHERE {_TKEY.format("src_rel")} = 'readme' AND resolved IS NOT NULL),
orph AS (SELECT rel_path FROM nk WHERE lower(rel_path) <> 'readme.md' AND rel_path NOT IN (SELECT rel_path FROM inb)),
nohub AS (SELECT rel_path FROM nk WHERE NOT {_HUB.format("rel_path")} AND rel_path NOT IN (SELECT rel_path FROM moc) AND rel_path NOT IN (
  SELECT src FROM rl WHERE src IS NOT NULL AND ({_HUB.format("trim(replace(target, '" + chr(92) + "', '/'))")} OR resolved IN (SELECT rel_path FROM moc)))),
bad AS (SELECT rel_path, status FROM cur WHERE status IS NOT NULL AND lower(trim(status)) <> '' AND lower(trim(status)) NOT IN ({", ".join(f"'{s}'" for s in STATUS_VALUES)})),
lint AS (SELECT 'broken' AS kind, rel_path, target AS detail FROM broken UNION ALL SELECT 'orphan', rel_path, NULL FROM orph UNION ALL SELECT 'no_hub', rel_path, NULL FROM nohub UNION ALL SELECT 'bad_status', rel_path, status FROM bad)
"""

SQL = {
    "resolve_links": _BASE + "SELECT * FROM res",
    "link_kinds": _BASE + f"SELECT CASE WHEN how IS NOT NULL THEN how WHEN {_ATTACH.format('target')} THEN 'attachment' ELSE 'broken' END AS kind, embed, count(*) AS n FROM rl GROUP BY ALL",
    "backlinks": _BASE + "SELECT * FROM back",
    "backlink_listing": _BASE + f"SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY {_WALK.format('src_rel')}, line_no) AS rank FROM back QUALIFY rank <= 50",
    "inbound_counts": _BASE + "SELECT * FROM inb",
    "broken_links": _BASE + "SELECT * FROM broken",
    "broken_beside_files": _BASE + f"SELECT * FROM broken WHERE NOT {_ATTACH.format('target')} OR lower({_NAME.format('target')}) NOT IN (SELECT lower({_NAME.format('target')}) FROM links WHERE embed AND target IS NOT NULL)",
    "content_map": _BASE + "SELECT * FROM moc",
    "orphan_notes": _BASE + "SELECT * FROM orph",
    "hub_notes": f"WITH {CUR} SELECT rel_path FROM cur WHERE {_HUB.format('rel_path')}",
    "without_hub": _BASE + "SELECT * FROM nohub",
    "bad_status": _BASE + "SELECT * FROM bad",
    "lint_counts": _BASE + "SELECT kind, count(*) AS n FROM lint GROUP BY 1",
    "lint_listing": _BASE + "SELECT *, row_number() OVER (PARTITION BY kind ORDER BY rel_path, detail NULLS FIRST) AS rank, count(*) OVER (PARTITION BY kind) AS total FROM lint QUALIFY rank <= 30",
    "stem_uniqueness": _BASE + "SELECT string_split(noext, '/')[-1] AS name, count(*) AS n FROM nk GROUP BY 1",
}
