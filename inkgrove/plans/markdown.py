"""Markdown operators over the exported documents, keyed by document id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.config import EngineConfig
from inkgrove.functions.text import occurrences, split_lines
from inkgrove.operators import filters, links, notes
from inkgrove.sources.tables import table

PAGE = 2000
IGNORE = ["inbox/", "journal/*/draft-*", "*checklist*"]
MAX_BYTES = 20_000
SECTION = "cellar"
CONFIG = EngineConfig()
#: White space, for regular expressions of both engines.
BLANK = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text", "rel_path", "doc_id", "mtime")


def _id(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("bigint").alias("doc_id"), *[c for c in df.columns if c != "key"])


def headings(spark: SparkSession, d: str) -> DataFrame:
    return _id(notes.extract_headings(_docs(spark, d), "key"))


def wikilinks(spark: SparkSession, d: str) -> DataFrame:
    return _id(notes.extract_links(_docs(spark, d), "key"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _id(notes.extract_paragraphs(_docs(spark, d), "key"))


def note_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = notes.parse_notes(_docs(spark, d), "key", fallback="rel_path")
    return _id(facts).select("doc_id", "title", "summary", F.array_join("tags", ",").alias("tags"), "status", "front_lines", "lines")


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    return _id(notes.parse_notes(_docs(spark, d), "key")).select("doc_id", F.posexplode("targets").alias("at", "target")).select("doc_id", F.col("at").cast("bigint").alias("at"), "target")


def section_extents(spark: SparkSession, d: str) -> DataFrame:
    return _id(notes.section_extents(_docs(spark, d), SECTION, "key"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return _id(notes.chunk_notes(_docs(spark, d), key="key"))


def junk_lines(spark: SparkSession, d: str) -> DataFrame:
    return links.junk_lines(_docs(spark, d).select(F.col("key").alias("rel_path"), "text"), "text", 500).select(F.col("rel_path").cast("bigint").alias("doc_id"), "chars")


def read_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each document: lines while they fit ``PAGE`` characters, each with its break, and what remains."""
    sized = _docs(spark, d).select("doc_id", F.transform(split_lines(F.col("text")), lambda x: F.length(x) + 1).alias("sizes")).where(F.size("sizes") > 0)
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("shown"), F.lit(0).cast("bigint").alias("remaining"))

    def step(a, n):
        upto = a["upto"] + n
        return F.struct(upto.alias("upto"), (a["shown"] + F.when(upto <= PAGE, 1).otherwise(0)).alias("shown"), (a["remaining"] + F.when(upto > PAGE, n).otherwise(0)).alias("remaining"))

    page = sized.select("doc_id", F.size("sizes").cast("bigint").alias("total_lines"), F.aggregate("sizes", start, step).alias("p"))
    return page.select("doc_id", "p.shown", "total_lines", "p.remaining")


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.substring(F.sha2("text", 256), 1, 16).alias("short"))


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by content hash where several share it."""
    h = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return h.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def occurrence_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", occurrences(F.col("text"), "\n- ").alias("n")).where("n > 0")


def skip_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    reason = filters.skip_reason(F.col("rel_path"), F.octet_length("text").cast("bigint"), F.lit(None).cast("string"), IGNORE, MAX_BYTES)
    return docs.select("doc_id", reason.alias("reason"))


def folder_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(filters.in_folder(F.col("rel_path"), "/journal/2024/")).select("doc_id", "rel_path")


def folder_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(filters.under_prefix(F.col("rel_path"), "projects")).select("doc_id", "rel_path")


def hidden_paths(spark: SparkSession, d: str) -> DataFrame:
    """Which documents a scan would see, by component, with a folder taken for hidden."""
    path = F.regexp_replace("rel_path", "^inbox/", ".inbox/")
    return table(spark, d, "documents").select("doc_id", filters.is_hidden(path).alias("hidden"))


def recent_documents(spark: SparkSession, d: str) -> DataFrame:
    return filters.recent(table(spark, d, "documents"), cutoff=1_735_689_600.0, limit=50).select("doc_id", "rel_path", "mtime")


def list_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 paths in walking order with their titles."""
    few = _docs(spark, d).select("key", "rel_path", "doc_id").orderBy(filters.walk_key(F.col("rel_path")), "doc_id").limit(200)
    asked = _docs(spark, d).join(F.broadcast(few.select("key")), "key", "left_semi")  # 200 keys: only those texts are parsed
    facts = notes.parse_notes(asked, "key", fallback="rel_path").select("key", "title")
    return few.join(facts, "key").select("doc_id", "rel_path", "title")


def chunk_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the chunks of each document hold together: their text (by a hash of all that is not blank), its first and last line,
    and whether every chunk keeps the limit. Sections too short to keep are not in it."""
    c = chunk_documents(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "chunk_text"))).alias("c"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.max(F.length("chunk_text")).alias("longest"))
    text = F.array_join(F.transform("c", lambda x: x["chunk_text"]), "")
    return c.select("doc_id", F.md5(F.regexp_replace(text, BLANK, "").cast("binary")).alias("text_md5"), "line_start", "line_end", (F.col("longest") <= CONFIG.chunk_limit).alias("fits"))


def lint_documents(spark: SparkSession, d: str) -> DataFrame:
    """The findings that need the text: no frontmatter, too many bytes, a line over the limit."""
    facts = notes.parse_notes(_docs(spark, d), "key").where("front_lines = 0")
    docs = _docs(spark, d).select(F.col("key").alias("rel_path"), "text", F.octet_length("text").alias("size"))
    parts = [
        facts.select(F.lit("no_frontmatter").alias("kind"), F.col("key").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n")),
        links.oversized(docs, "size", MAX_BYTES).select(F.lit("oversized").alias("kind"), F.col("rel_path").cast("bigint").alias("doc_id"), F.col("bytes").alias("n")),
        links.junk_lines(docs, "text", 500).select(F.lit("junk_line").alias("kind"), F.col("rel_path").cast("bigint").alias("doc_id"), F.col("chars").alias("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def move_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Links by name to one note, pointed at its new path, code untouched."""
    from inkgrove.operators.rewrite import rewrite_moved

    now = _docs(spark, d).select(F.col("key").alias("rel_path"), "text")
    resolution = spark.createDataFrame([("hive-pump", "garden/hive-pump.md")], "target string, resolved string")
    return rewrite_moved(now, resolution, "garden/hive-pump.md", "apiary/new-pump.md", stem_unique=True).select(F.col("rel_path").cast("bigint").alias("doc_id"), "n", F.sha2("text", 256).alias("hash"))


QUERIES = {
    "headings": headings, "wikilinks": wikilinks, "paragraphs": paragraphs, "note_facts": note_facts, "link_targets": link_targets, "section_extents": section_extents,
    "chunk_documents": chunk_documents, "junk_lines": junk_lines, "read_page": read_page, "content_hash": content_hash, "duplicate_texts": duplicate_texts,
    "occurrence_count": occurrence_count, "skip_rules": skip_rules, "folder_range": folder_range, "folder_prefix": folder_prefix, "hidden_paths": hidden_paths,
    "recent_documents": recent_documents, "list_documents": list_documents, "move_rewrite": move_rewrite, "chunk_cover": chunk_cover, "lint_documents": lint_documents,
}

_BRK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
#: doc (doc_id, rel_path, text, ls, front, code): lines, frontmatter length, and whether each line after it is fenced code.
_DOC = rf"""WITH split AS (SELECT doc_id, rel_path, mtime, text, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace(text, '({_BRK})$', ''), '{_BRK}') END AS ls FROM documents),
fronted AS (SELECT *, CASE WHEN len(ls) > 0 AND {_STRIP.format("ls[1]")} = '---' THEN coalesce(list_min(list_filter(range(2, len(ls) + 1), lambda i: {_STRIP.format("ls[i]")} IN ('---', '...'))), 0) ELSE 0 END AS front FROM split),
flat AS (SELECT doc_id, front, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM fronted),
marks AS (SELECT *, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1) AS mark FROM flat),
fold AS (SELECT doc_id, list_reduce(list_prepend(struct_pack(n := 0::BIGINT, mark := '', tail := '', open := '', code := []::BIGINT[]), list(struct_pack(n := n, mark := mark, tail := {_STRIP.format("line")}, open := '', code := []::BIGINT[]) ORDER BY n)),
  lambda a, x: struct_pack(n := x.n, mark := x.mark, tail := '',
    open := CASE WHEN a.open = '' THEN x.mark WHEN x.mark <> '' AND x.mark[1] = a.open[1] AND length(x.mark) >= length(a.open) AND replace(x.tail, a.open[1], '') = '' THEN '' ELSE a.open END,
    code := CASE WHEN a.open <> '' OR x.mark <> '' THEN list_append(a.code, x.n) ELSE a.code END)).code AS code FROM marks WHERE n > front OR mark = '' GROUP BY doc_id),
outline AS (SELECT f.doc_id, f.front, f.n, f.line, list_contains(fold.code, f.n) AS code FROM flat f JOIN fold USING (doc_id)),
heads AS (SELECT doc_id, n, length(regexp_extract(line, '^(#{{1,6}})\s+(.+?)(?:\s+#+)?\s*$', 1)) AS level, {_STRIP.format("regexp_extract(line, '^(#{1,6})" + chr(92) + "s+(.+?)(?:" + chr(92) + "s+#+)?" + chr(92) + "s*$', 2)")} AS heading
  FROM outline WHERE NOT code AND n > front AND regexp_matches(line, '^(#{{1,6}})\s+(.+?)(?:\s+#+)?\s*$'))"""
_LINK = r"(!?)\[\[([^\]|#^]+)([#^][^\]|]*)?(\|[^\]]*)?\]\]"
_LINKS = rf"""{_DOC},
lk AS (SELECT doc_id, n, unnest(range(len(m))) AS ordinal, unnest(m) AS whole FROM (SELECT doc_id, n, regexp_extract_all(regexp_replace(line, '`+[^`]*`+', ' ', 'g'), '{_LINK}') AS m FROM outline WHERE NOT code AND contains(line, '[['))),
links_of AS (SELECT doc_id, n AS line_no, ordinal, starts_with(whole, '!') AS embed, {_STRIP.format(f"regexp_extract(whole, '{_LINK}', 2)")} AS target, nullif(regexp_extract(whole, '{_LINK}', 3), '') AS anchor, nullif(regexp_extract(whole, '{_LINK}', 4), '') AS alias FROM lk)"""

SQL = {
    "headings": _DOC + " SELECT doc_id, n::INTEGER AS line_no, level::INTEGER AS level, heading FROM heads",
    "wikilinks": _LINKS + " SELECT doc_id, line_no::INTEGER AS line_no, ordinal::INTEGER AS ordinal, embed, target, anchor, alias[2:] AS alias FROM links_of",
    "link_targets": _LINKS + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, ordinal) - 1 AS at, target FROM (SELECT doc_id, target, line_no, ordinal, row_number() OVER (PARTITION BY doc_id, target ORDER BY line_no, ordinal) AS k FROM links_of) WHERE k = 1",
    "paragraphs": _DOC + f", isl AS (SELECT doc_id, n, line, count(*) FILTER (WHERE {_STRIP.format('line')} = '') OVER (PARTITION BY doc_id ORDER BY n) AS g FROM flat) SELECT doc_id, min(n)::INTEGER AS line_start, max(n)::INTEGER AS line_end, (sum(length(line) + 1) - 1)::INTEGER AS chars FROM isl WHERE {_STRIP.format('line')} <> '' GROUP BY doc_id, g",
    "section_extents": _DOC + f", st AS (SELECT doc_id, min(n) AS s, arg_min(level, n) AS level FROM heads WHERE contains(lower(heading), '{SECTION}') GROUP BY 1) SELECT st.doc_id, st.s::INTEGER AS line_start, coalesce(min(h.n) - 1, any_value(len(f.ls)))::INTEGER AS line_end FROM st JOIN fronted f USING (doc_id) LEFT JOIN heads h ON h.doc_id = st.doc_id AND h.n > st.s AND h.level <= st.level GROUP BY st.doc_id, st.s",
    "note_facts": _DOC
    + rf""", lead AS (SELECT doc_id, n, {_STRIP.format("line")} AS line FROM outline WHERE n > front AND NOT code AND {_STRIP.format("line")} <> '' AND left({_STRIP.format("line")}, 1) NOT IN ('#', '>')),
summed AS (SELECT doc_id, n, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS upto, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS before FROM lead),
summ AS (SELECT doc_id, string_agg(line, ' ' ORDER BY n) AS s FROM summed WHERE before IS NULL OR before < 200 GROUP BY 1),
title AS (SELECT doc_id, arg_min(heading, n) AS t FROM heads WHERE level = 1 GROUP BY 1),
meta AS (SELECT doc_id, front, len(ls)::INTEGER AS lines, rel_path, coalesce(list_filter(ls[2:front - 1], lambda x: starts_with(x, 'tags:'))[1], '') AS tl, coalesce(list_filter(ls[2:front - 1], lambda x: starts_with(x, 'status:'))[1], '') AS sl FROM fronted)
SELECT m.doc_id, coalesce(t.t, m.rel_path) AS title, CASE WHEN length(coalesce(s, '')) > 280 THEN left(s, 280) || '...' ELSE coalesce(s, '') END AS summary,
  CASE WHEN m.front = 0 THEN '' ELSE array_to_string(list_filter(tg, lambda x, i: list_position(tg, x) = i), ',') END AS tags,
  CASE WHEN m.front = 0 THEN '' ELSE lower({_STRIP.format("regexp_extract(sl, '^status:(.*)$', 1)")}) END AS status, m.front::INTEGER AS front_lines, m.lines
FROM (SELECT *, list_filter(list_transform(string_split(regexp_extract(tl, '^tags:\s*\[(.*)\]', 1), ','), lambda x: lower(trim(x))), lambda x: x <> '') AS tg FROM meta) m LEFT JOIN title t USING (doc_id) LEFT JOIN summ USING (doc_id)""",
    "junk_lines": _DOC + " SELECT doc_id, max(length(line)) AS chars FROM flat GROUP BY 1 HAVING max(length(line)) > 500",
    "read_page": _DOC + f", s AS (SELECT doc_id, length(line) + 1 AS k, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM flat) SELECT doc_id, count(*) FILTER (WHERE upto <= {PAGE}) AS shown, count(*) AS total_lines, coalesce(sum(k) FILTER (WHERE upto > {PAGE}), 0)::BIGINT AS remaining FROM s GROUP BY 1",
    "chunk_cover": _DOC + rf""",
sec AS (SELECT o.doc_id, o.n, CASE WHEN length(o.line) > {CONFIG.max_line_chars} THEN '' ELSE o.line END AS line, count(h.n) OVER (PARTITION BY o.doc_id ORDER BY o.n) AS sec FROM outline o LEFT JOIN (SELECT * FROM heads WHERE level <= 4) h USING (doc_id, n) WHERE o.n > o.front),
par AS (SELECT *, count(*) FILTER (WHERE regexp_full_match(line, '{BLANK}*')) OVER (PARTITION BY doc_id, sec ORDER BY n) AS g FROM sec),
full_lines AS (SELECT * FROM par WHERE NOT regexp_full_match(line, '{BLANK}*')),
weights AS (SELECT doc_id, sec, sum(w) AS w FROM (SELECT doc_id, sec, length(regexp_replace(string_agg(line, chr(10) ORDER BY n), '^{BLANK}+|{BLANK}+$', '', 'g')) AS w FROM full_lines GROUP BY doc_id, sec, g) GROUP BY 1, 2),
kept AS (SELECT doc_id, sec FROM weights QUALIFY w >= {CONFIG.min_chunk_chars} OR max(w) OVER (PARTITION BY doc_id) < {CONFIG.min_chunk_chars})
SELECT doc_id, md5(string_agg(regexp_replace(line, '{BLANK}', '', 'g'), '' ORDER BY n)) AS text_md5, min(n)::INTEGER AS line_start, max(n)::INTEGER AS line_end, true AS fits FROM full_lines JOIN kept USING (doc_id, sec) GROUP BY doc_id""",
    "lint_documents": _DOC + f" SELECT 'no_frontmatter' AS kind, doc_id, NULL::BIGINT AS n FROM fronted WHERE front = 0 UNION ALL SELECT 'oversized', doc_id, octet_length(encode(text)) FROM documents WHERE octet_length(encode(text)) > {MAX_BYTES} UNION ALL SELECT 'junk_line', doc_id, max(length(line)) FROM flat GROUP BY doc_id HAVING max(length(line)) > 500",
    "content_hash": "SELECT doc_id, sha256(text) AS hash, left(sha256(text), 16) AS short FROM documents",
    "duplicate_texts": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "occurrence_count": "SELECT * FROM (SELECT doc_id, (length(text) - length(replace(text, chr(10) || '- ', ''))) // 3 AS n FROM documents) WHERE n > 0",
    "skip_rules": rf"""SELECT doc_id, CASE WHEN starts_with(rel_path, 'inbox/') OR regexp_matches(rel_path, '^journal/.*/draft-.*$') OR contains(string_split(rel_path, '/')[-1], 'checklist') THEN 'ignored'
  WHEN octet_length(encode(text)) > {MAX_BYTES} THEN 'too large (' || (octet_length(encode(text)) // 1024) || ' KB > {MAX_BYTES // 1024} KB)' END AS reason FROM documents""",
    "folder_range": "SELECT doc_id, rel_path FROM documents WHERE rel_path >= 'journal/2024/' AND rel_path < 'journal/20240'",
    "folder_prefix": "SELECT doc_id, rel_path FROM documents WHERE starts_with(rel_path, 'projects/')",
    "hidden_paths": "SELECT doc_id, coalesce(starts_with(rel_path, 'inbox/') OR starts_with(rel_path, '.') OR contains(rel_path, '/.'), false) AS hidden FROM documents",
    "recent_documents": "SELECT doc_id, rel_path, mtime FROM documents WHERE mtime >= 1735689600 ORDER BY mtime DESC, rel_path DESC LIMIT 50",
    "list_documents": _DOC + ", title AS (SELECT doc_id, arg_min(heading, n) AS t FROM heads WHERE level = 1 GROUP BY 1) SELECT s.doc_id, s.rel_path, coalesce(t.t, s.rel_path) AS title FROM (SELECT doc_id, rel_path FROM documents ORDER BY array_to_string(list_transform(string_split(rel_path, '/'), lambda p, i: CASE WHEN i = len(string_split(rel_path, '/')) THEN '0' ELSE '1' END || p), chr(1)), doc_id LIMIT 200) s LEFT JOIN title t USING (doc_id)",
}
