"""Keyword, vector and hybrid retrieval over the chunks, for all golden queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.functions.text import STOPWORDS, csv_values, cut, query_terms
from inkgrove.operators import evaluate, filters, hybrid, keyword, vectors
from inkgrove.plans.common import CH, CUR, chunks_now, golden, notes_now
from inkgrove.runtime import written
from inkgrove.sources.tables import table

LIMIT, POOL = 5, 20
FETCH = LIMIT * 6
FOLDER, TAGS, STATUS = "projects", "", "verified, active, approved, draft"
PHRASES = ("too rusty", "hollow-lantern", "was too heavy", "notebook")
DIM = 64


def query_terms_of(spark: SparkSession, d: str) -> DataFrame:
    return golden(spark, d).select("query_id", F.posexplode(query_terms(F.col("query"))).alias("at", "term")).select("query_id", F.col("at").cast("bigint"), "term")


def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = keyword.keyword_search(table(spark, d, "chunks"), golden(spark, d), FETCH)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(PHRASES)), "query_id bigint, query string")
    terms = asked.select("query_id", keyword.tokens(keyword.fold(F.col("query"))).alias("phrase"))
    hits = keyword.phrase_frequencies(keyword.field_tokens(table(spark, d, "chunks")), terms)
    return hits.select(F.array_join("phrase", " ").alias("phrase"), "id", F.round("f", 6).alias("f"))


def _bow(spark: SparkSession, d: str, n: int) -> DataFrame:
    rows = vectors.bag_of_words(table(spark, d, "chunks"), "chunk_text", "id")
    return vectors.sparse_search(rows, vectors.bag_of_words(golden(spark, d), "query", "query_id"), n)


def bow_search(spark: SparkSession, d: str) -> DataFrame:
    return _bow(spark, d, FETCH).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def knn_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.knn(e, asked, 10, DIM, "vec_id").select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def knn_chunks(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vec_chunks")
    asked = v.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "embedding")
    return vectors.knn(v, asked, 10, DIM).select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def nearest_to_first(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()
    return vectors.nearest(e, list(q.embedding), 10, DIM, "vec_id").select("id", F.round("distance", 6).alias("distance"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    kw = keyword.keyword_search(table(spark, d, "chunks"), golden(spark, d), FETCH)
    return hybrid.rrf([kw, _bow(spark, d, FETCH)], pool=POOL)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "id", F.round("rrf", 8).alias("rrf"), F.col("rank").cast("bigint").alias("rank"))


def _hydrated(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.hydrate(_fused(spark, d), chunks_now(spark, d))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Fusion, hydration, at most two chunks a note, five a query."""
    hits = hybrid.diversify(_hydrated(spark, d), 2, LIMIT)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "rel_path", "heading", "line_start", "line_end", F.round("rrf", 8).alias("score"), cut(F.coalesce("chunk_text", F.lit("")), 400).alias("snippet"))


def rerank_floor(spark: SparkSession, d: str) -> DataFrame:
    """The first eight of the pool by word overlap, floor at 0.4."""
    few = _hydrated(spark, d).where(F.col("rank") <= 8).fillna("", ["title", "heading", "chunk_text"])
    scored = hybrid.overlap_rerank(few, golden(spark, d)).withColumn("score", F.round("rerank", 6))
    kept, _ = hybrid.apply_floor(scored, 0.4)
    return kept.select("query_id", "id", "score")


def best_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose every candidate lies under the floor, with the best score."""
    few = _hydrated(spark, d).where(F.col("rank") <= 8).fillna("", ["title", "heading", "chunk_text"])
    scored = hybrid.overlap_rerank(few, golden(spark, d)).withColumn("score", F.round("rerank", 6))
    return hybrid.apply_floor(scored, 0.8)[1]


def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search inside a folder, over notes of some states; statistics are those of the whole corpus."""
    all_chunks = chunks_now(spark, d)
    inside = filters.of_notes(all_chunks.where(filters.in_folder(F.col("rel_path"), FOLDER)), notes_now(spark, d, "tags", "status"), TAGS, STATUS, "key")
    scores = keyword.bm25_scores(inside, golden(spark, d), corpus=all_chunks)
    return keyword.top_per_query(scores, LIMIT).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def eval_modes(spark: SparkSession, d: str) -> DataFrame:
    """hit@5, recall@5 and MRR of each mode, one chunk a note."""
    c, g = chunks_now(spark, d), golden(spark, d)
    kw, bow = written(keyword.keyword_search(table(spark, d, "chunks"), g, FETCH), "kw"), written(_bow(spark, d, FETCH), "bow")
    lists = {"keyword": kw, "semantic": bow, "hybrid": hybrid.rrf([kw, bow], pool=POOL)}
    out = None
    for mode, hits in lists.items():
        best = hybrid.diversify(hybrid.hydrate(hits.select("query_id", "id", "rank"), c), 1, 5)
        row = evaluate.summary(evaluate.judged(best, g)).select(F.lit(mode).alias("mode"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def judged_queries(spark: SparkSession, d: str) -> DataFrame:
    hits = hybrid.diversify(hybrid.hydrate(keyword.keyword_search(table(spark, d, "chunks"), golden(spark, d), FETCH), chunks_now(spark, d)), 1, 5)
    return evaluate.judged(hits, golden(spark, d)).select("query_id", F.col("hit").cast("bigint").alias("hit"), F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"))


QUERIES = {
    "keyword_topk": keyword_topk, "query_terms": query_terms_of, "phrase_match": phrase_match, "bow_search": bow_search, "knn_embeddings": knn_embeddings,
    "knn_chunks": knn_chunks, "nearest_to_first": nearest_to_first, "rrf_hybrid": rrf_hybrid, "hybrid_search": hybrid_search, "rerank_floor": rerank_floor,
    "best_rejected": best_rejected, "filtered_search": filtered_search, "eval_modes": eval_modes, "judged_queries": judged_queries,
}

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOPWORDS))
_TERMS = rf"""words AS (
  SELECT item_id AS query_id, list_filter(list_transform(string_split_regex(regexp_replace(query, '[^\p{{L}}\p{{N}} _\-]', ' ', 'g'), ' +'), lambda t: regexp_replace(t, '^[-_]+|[-_]+$', '', 'g')), lambda t: t <> '') AS w FROM eval_items),
terms AS (SELECT query_id, CASE WHEN len(c) > 0 THEN c ELSE w END AS t FROM (SELECT *, list_filter(w, lambda x: lower(x) NOT IN ({_STOP})) AS c FROM words))"""


def _tok(text: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower(coalesce({text}, ''))), '[\p{{L}}\p{{N}}]+')"


_FIELDS = " UNION ALL ".join(f"SELECT id, {k} AS field, {w}::DOUBLE AS w, {_tok(f)} AS t FROM chunks" for k, (f, w) in enumerate((("title", 2.0), ("heading", 3.0), ("summary", 0.2), ("chunk_text", 1.0))))
#: freq (phrase, id, f) and scores (query_id, id, score) by BM25; wants ph (query_id, phrase, times).
_FREQ = f"""fields AS ({_FIELDS}),
tok AS (SELECT id, field, w, unnest(range(len(t))) AS pos, unnest(t) AS term FROM fields),
places AS (SELECT phrase, len(phrase) AS size, unnest(range(len(phrase))) AS k, unnest(phrase) AS term FROM (SELECT DISTINCT phrase FROM ph)),
runs AS (SELECT phrase, id, field, w, pos - k AS start FROM tok JOIN places USING (term) GROUP BY phrase, size, id, field, w, pos - k HAVING count(*) = size),
freq AS (SELECT phrase, id, sum(w) AS f FROM runs GROUP BY ALL)"""
_PH = _TERMS + ", ph AS (SELECT query_id, phrase, count(*) AS times FROM (SELECT query_id, regexp_extract_all(strip_accents(lower(unnest(t))), '[\\p{L}\\p{N}]+') AS phrase FROM terms) WHERE len(phrase) > 0 GROUP BY ALL)"
_BM25 = f"""{_PH}, {_FREQ},
sizes AS (SELECT id, sum(len(t))::DOUBLE AS d FROM fields GROUP BY id),
stats AS (SELECT count(*) AS n_rows, avg(d) AS avgdl FROM sizes),
idf AS (SELECT phrase, avgdl, CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT phrase, count(*) AS n FROM freq GROUP BY 1), stats),
scores AS (SELECT query_id, id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avgdl)) * times) AS score FROM freq JOIN idf USING (phrase) JOIN sizes USING (id) JOIN ph USING (phrase) GROUP BY ALL),
kw AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scores QUALIFY rank <= {FETCH})"""
_HEX = " * 16 + ".join("strpos('0123456789abcdef', h[{}]) - 1".format(i) for i in (1, 2, 3))


def _bow_sql(name: str, table_name: str, key: str, text: str) -> str:
    return rf"""{name}_w AS (SELECT {key} AS key, unnest(list_filter(string_split_regex(lower(coalesce({text}, '')), '\s+'), lambda x: x <> '')) AS word FROM {table_name}),
{name}_c AS (SELECT key, (((strpos('0123456789abcdef', h[1]) - 1) * 16 + strpos('0123456789abcdef', h[2]) - 1) * 16 + strpos('0123456789abcdef', h[3]) - 1) % 1024 AS bucket, count(*) AS n FROM (SELECT key, right(md5(word), 3) AS h FROM {name}_w) GROUP BY ALL),
{name} AS (SELECT key, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS value FROM {name}_c)"""


_BOW = f"""{_bow_sql("rowv", "chunks", "id", "chunk_text")}, {_bow_sql("qv", "eval_items", "item_id", "query")},
bow AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
  SELECT q.key AS query_id, r.key AS id, sum(r.value * q.value) AS score FROM rowv r JOIN qv q USING (bucket) GROUP BY ALL) QUALIFY rank <= {FETCH})"""
_RRF = f"""{_BM25}, {_BOW},
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first, id) AS rank FROM (
  SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min((list, rank)) AS first FROM (SELECT query_id, id, rank, 0 AS list FROM kw UNION ALL SELECT query_id, id, rank, 1 FROM bow) GROUP BY ALL) QUALIFY rank <= {POOL}),
{CH}, hyd AS (SELECT f.query_id, f.id, f.rrf, f.rank, ch.* EXCLUDE (id) FROM fused f JOIN ch USING (id))"""
_DIVERSE = """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, rel_path ORDER BY rank) AS of_note FROM {0}) WHERE of_note <= {1} QUALIFY r2 <= 5"""
_OVERLAP = rf"""ov AS (SELECT h.query_id, h.id, round(coalesce(len(list_intersect(q, {_tok("d")})) / nullif(len(q), 0)::DOUBLE, 0), 6) AS score FROM (
  SELECT query_id, id, 'Title: ' || coalesce(title, '') || ' > ' || coalesce(heading, '') || chr(10) || coalesce(substring(chunk_text, 1, 600), '') AS d FROM hyd WHERE rank <= 8) h
  JOIN (SELECT item_id, list_distinct({_tok("query")}) AS q FROM eval_items) e ON e.item_id = h.query_id)"""


def _usable(v: str) -> str:
    return f"len({v}) = {DIM} AND len(list_filter({v}, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM} AND len(list_filter({v}, lambda x: x <> 0)) > 0"


def _knn_sql(table_name: str, key: str) -> str:
    return f"""WITH u AS (SELECT {key} AS id, embedding::DOUBLE[] AS v FROM {table_name} WHERE embedding IS NOT NULL AND {_usable("embedding")})
SELECT query_id, id, round(distance, 6) AS distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM (
    SELECT q.id AS query_id, u.id, 1 - list_cosine_similarity(q.v, u.v) AS distance FROM u, (SELECT * FROM u WHERE id % 100 = 0) q)) WHERE rank <= 10"""


#: Judgements of one list of (query_id, rank, rel_path).
_JUDGE = r"""SELECT query_id, max((first IS NOT NULL)::BIGINT) AS hit, max(least(1.0::DOUBLE, found / n::DOUBLE)) AS recall, max(coalesce(1.0::DOUBLE / first, 0)) AS rr FROM (
  SELECT w.query_id, any_value(w.n) AS n, min(g.rank) FILTER (WHERE g.path = w.want OR (NOT contains(w.want, '/') AND string_split(g.path, '/')[-1] = w.want)) AS first,
    count(DISTINCT g.path) FILTER (WHERE g.path = w.want OR (NOT contains(w.want, '/') AND string_split(g.path, '/')[-1] = w.want)) AS found
  FROM want w LEFT JOIN (SELECT query_id, r2 AS rank, regexp_replace(key, '\.md$', '') AS path FROM {0}) g ON g.query_id = w.query_id GROUP BY w.query_id) GROUP BY query_id"""
_WANT = r"""want AS (SELECT item_id AS query_id, len(expected) AS n, regexp_replace(lower(nfc_normalize(regexp_replace(trim(replace(unnest(expected), '\', '/')), '^(\./)+', ''))), '\.md$', '') AS want FROM eval_items WHERE len(expected) > 0)"""
_MODES = ", ".join(f"{m}_h AS (SELECT x.query_id, x.rank, ch.* FROM {src} x JOIN ch USING (id)), {m}_d AS ({_DIVERSE.format(m + '_h', 1)}), {m}_j AS ({_JUDGE.format(m + '_d')})" for m, src in (("keyword", "kw"), ("semantic", "bow"), ("hybrid", "fused")))


def _six(column: str) -> str:
    return f"floor(avg({column}) * 1e6::DOUBLE + 0.500001::DOUBLE) / 1e6::DOUBLE"


_STATES = ", ".join(f"'{s}'" for s in csv_values(STATUS))

SQL = {
    "query_terms": f"WITH {_TERMS} SELECT query_id, unnest(range(len(t))) AS at, unnest(t) AS term FROM terms",
    "keyword_topk": f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM kw",
    "phrase_match": "WITH ph AS (SELECT unnest([" + ", ".join(str(p.replace("-", " ").split()) for p in PHRASES) + f"]) AS phrase), {_FREQ} SELECT array_to_string(phrase, ' ') AS phrase, id, round(f, 6) AS f FROM freq",
    "bow_search": f"WITH {_BOW} SELECT query_id, id, round(score, 6) AS score, rank FROM bow",
    "knn_embeddings": _knn_sql("embeddings", "vec_id"),
    "knn_chunks": _knn_sql("vec_chunks", "id"),
    "nearest_to_first": f"SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings WHERE {_usable('embedding')} ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9), vec_id LIMIT 10",
    "rrf_hybrid": f"WITH {_RRF} SELECT query_id, id, round(rrf, 8) AS rrf, rank FROM fused",
    "hybrid_search": f"WITH {_RRF} SELECT query_id, r2 AS rank, id, rel_path, heading, line_start, line_end, round(rrf, 8) AS score, CASE WHEN length(coalesce(chunk_text, '')) > 400 THEN substring(chunk_text, 1, 400) || '...' ELSE coalesce(chunk_text, '') END AS snippet FROM ({_DIVERSE.format('hyd', 2)})",
    "rerank_floor": f"WITH {_RRF}, {_OVERLAP} SELECT * FROM ov WHERE score >= 0.4",
    "best_rejected": f"WITH {_RRF}, {_OVERLAP} SELECT query_id, max(score) AS best_rejected FROM ov GROUP BY 1 HAVING max(score) < 0.8",
    "filtered_search": f"WITH {_BM25}, {CH}, {CUR} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scores JOIN ch USING (id) WHERE ch.rel_path >= '{FOLDER}/' AND ch.rel_path < '{FOLDER}0' AND ch.key IN (SELECT key FROM cur WHERE status IN ({_STATES})) QUALIFY rank <= {LIMIT}",
    "judged_queries": f"WITH {_BM25}, {CH}, {_WANT}, h AS (SELECT k.query_id, k.rank, ch.* FROM kw k JOIN ch USING (id)), dv AS ({_DIVERSE.format('h', 1)}) SELECT query_id, hit, round(recall, 6) AS recall, round(rr, 6) AS rr FROM ({_JUDGE.format('dv')})",
    "eval_modes": f"WITH {_RRF}, {_WANT}, {_MODES} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, count(*) AS queries, {_six("hit")} AS hit_at_k, {_six("recall")} AS recall_at_k, {_six("rr")} AS mrr FROM {m}_j" for m in ("keyword", "semantic", "hybrid")),
}
