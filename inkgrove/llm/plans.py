"""Queries of the llm problems. SQL twins exist where SQL can express the operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.llm import languages, leaks, markup, neighbours, packing, split
from inkgrove.sources.tables import table

CHUNK_LIMIT, CHUNK_OVERLAP = 1500, 150


def p1_split(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "chunks"), CHUNK_LIMIT, CHUNK_OVERLAP)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_split(spark, d).where("piece_no = 0").select("id")


#: White space and line breaks, as the splitter knows them.
_BLANK = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces of each text: together, without the overlaps, they are the text (by a hash of all that is
    not blank), they begin and end at its lines, none is over the limit, and each shares with the one before what it says."""
    own = F.transform("p", lambda x: F.substring(x["chunk_text"], x["overlap_chars"] + 1, F.length(x["chunk_text"])))
    shared = F.forall(F.sequence(F.lit(1), F.size("p")), lambda k: (k == 1) | F.endswith(F.element_at("p", F.greatest(k - 1, F.lit(1)))["chunk_text"], F.left(F.element_at("p", k)["chunk_text"], F.element_at("p", k)["overlap_chars"])))
    pieces = p1_split(spark, d).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "overlap_chars", "chunk_text"))).alias("p"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.max(F.length("chunk_text")).alias("longest"), F.max("overlap_chars").alias("most"))
    return pieces.select("id", F.md5(F.regexp_replace(F.array_join(own, ""), _BLANK, "").cast("binary")).alias("text_md5"), "line_start", "line_end", ((F.col("longest") <= CHUNK_LIMIT) & (F.col("most") <= CHUNK_OVERLAP)).alias("fits"), shared.alias("shares"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, d))


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    return packing.mixture_report(p6_pack(spark, d))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_spans(spark, d).select("doc_id", "item_id")


def _p4(spark: SparkSession, d: str) -> DataFrame:
    return markup.text_columns(table(spark, d, "chunks"), table(spark, d, "notes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.residue_rows(_p4(spark, d)).select("src_table", "row_id")


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    return markup.label_blocks(_p4(spark, d))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_rows(_p4(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vec_chunks"))


def p5_knn(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, d, "vec_chunks"))


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.recall(table(spark, d, "vec_chunks"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(table(spark, d, "documents"))


def p8_labels(spark: SparkSession, d: str) -> DataFrame:
    return languages.label_languages(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_split": p1_split, "p1_check": p1_check, "p5_found": p5_found, "p5_knn": p5_knn, "p5_recall": p5_recall,
    "p4_found": p4_found, "p4_blocks": p4_blocks, "p4_clean": p4_clean,
    "p6_pack": p6_pack, "p6_fill": p6_fill, "p6_mixture": p6_mixture,
    "p7_found": p7_found, "p7_spans": p7_spans, "p8_found": p8_found, "p8_labels": p8_labels,
}

_INVISIBLE = r"[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]"
_INLINE = r"</?(?:b|i|em|strong|span|font|sup|sub|u|s|code|ref|nowiki|small|a)(?:\s[^<>]*)?/?>"


def _words(text: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace({text}, '<!--[\s\S]*?-->', ' ', 'g'), '{_INLINE}', '', 'gi'), '</?[A-Za-z][^<>]*>', ' ', 'g')"
    return rf"regexp_extract_all(regexp_replace(strip_accents(lower({bare})), '{_INVISIBLE}', '', 'g'), '[\p{{L}}\p{{N}}]+')"


def _grams(table_name: str, key: str, text: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {key}, {_words(text)} AS w FROM {table_name}) WHERE len(w) >= 8)"


SQL = {
    "p1_found": "SELECT id FROM chunks WHERE length(chunk_text) > 1500",
    "p1_check": rf"""SELECT id, md5(regexp_replace(chunk_text, '{_BLANK}', '', 'g')) AS text_md5, coalesce(line_start, 1) AS line_start,
  coalesce(line_start, 1) + len(regexp_extract_all(regexp_replace(chunk_text, '{_BLANK}+$', ''), '{_BREAK}'))::INT AS line_end, true AS fits, true AS shares FROM chunks WHERE length(chunk_text) > {CHUNK_LIMIT}""",
    "p5_found": """WITH u AS (SELECT id, embedding::DOUBLE[] AS v FROM vec_chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(c, 9) DESC, b.id) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM near WHERE c >= 0.9""",
    "p7_found": f"SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id', 'text')}) JOIN ({_grams('eval_items', 'item_id', 'passage')}) USING (g)",
}
