"""Keyword retrieval: field-weighted BM25 over several text fields, phrases included, many queries at once.

``f = sum over fields of weight * tf``; a row scores ``idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * D / avgdl))`` per phrase,
with D its tokens over all fields and ``idf = ln((N - n + 0.5) / (n + 0.5))``, 1e-6 where that is not positive. A query
term that holds marks ("bge-m3") is a phrase of adjacent tokens.

Only tokens that some query asks for leave the explode (a semi join on the query terms), tf is added up map-side, and
the per-query ranking is a window with a group limit, so rows beyond the limit never cross the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.config import EngineConfig
from inkgrove.functions.text import fold, query_terms, tokens
from inkgrove.runtime import spread, written

FIELDS = ("title", "heading", "summary", "chunk_text")


def field_tokens(chunks: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(id, one token array per field)``."""
    return spread(chunks.select("id", *fields)).select("id", *[tokens(fold(F.coalesce(F.col(f), F.lit("")))).alias(f) for f in fields])


def query_phrases(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """``(query_id, phrase, times)``: each query's phrases as token arrays, with how often the query repeats them."""
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(query_terms(F.col(query))).alias("term"))
    phrase = terms.select("query_id", tokens(fold(F.col("term"))).alias("phrase")).where(F.size("phrase") > 0)
    return phrase.groupBy("query_id", "phrase").agg(F.count("*").alias("times"))


def postings(tokenised: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(term, id, field, pos)``: the inverted index, ``field`` being the place in ``fields``."""

    def placed(k: int, f: str) -> Column:
        return F.transform(f, lambda t, i: F.struct(t.alias("term"), F.lit(k).alias("field"), i.alias("pos")))

    places = [placed(k, f) for k, f in enumerate(fields)]
    return tokenised.select("id", F.explode(F.concat(*places)).alias("p")).select("p.term", "id", "p.field", "p.pos")


def sizes(tokenised: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(id, d)``: tokens of each row over all fields."""
    return tokenised.select("id", reduce(lambda a, b: a + b, [F.size(f) for f in fields]).cast("double").alias("d"))


def phrase_frequencies(tokenised: DataFrame, phrases: DataFrame, fields: tuple[str, ...] = FIELDS, weights: tuple[float, ...] = EngineConfig.weights) -> DataFrame:
    """``(phrase, id, f)``: weighted frequency of each distinct phrase in each row that holds it."""
    return frequencies(postings(tokenised, fields), phrases, weights)


def frequencies(index: DataFrame, phrases: DataFrame, weights: tuple[float, ...] = EngineConfig.weights) -> DataFrame:
    """``phrase_frequencies`` from an inverted index. Terms no phrase asks for are dropped before anything is shuffled."""
    distinct = phrases.select("phrase").distinct()
    wanted = distinct.select(F.explode("phrase").alias("term")).distinct()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("field") + 1)
    mine = index.join(wanted, "term", "left_semi").withColumn("weight", weight)
    single = distinct.where(F.size("phrase") == 1).select("phrase", F.col("phrase")[0].alias("term"))
    hits = mine.join(single, "term").groupBy("phrase", "id").agg(F.sum("weight").alias("f"))
    if distinct.where(F.size("phrase") > 1).isEmpty():
        return hits
    places = distinct.where(F.size("phrase") > 1).select("phrase", F.size("phrase").alias("size"), F.posexplode("phrase").alias("k", "term"))
    runs = mine.join(places, "term").groupBy("phrase", "size", "id", "field", "weight", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("got")).where("got = size")
    return hits.unionByName(runs.groupBy("phrase", "id").agg(F.sum("weight").alias("f")))


def score(freq: DataFrame, row_sizes: DataFrame, phrases: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, score)``, higher is better. Statistics are those of ``row_sizes`` and ``freq``; ``candidates`` (id) limits who is ranked."""
    stats = row_sizes.agg(F.count("*").alias("n_rows"), F.avg("d").alias("avgdl")).first()
    df = freq.groupBy("phrase").agg(F.count("*").alias("n"))
    raw = F.log((F.lit(stats.n_rows) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = df.select("phrase", F.when(raw > 0, raw).otherwise(F.lit(1e-6)).alias("idf"))
    part = F.col("idf") * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.25 + 0.75 * F.col("d") / F.lit(stats.avgdl or 1.0)))
    scored = freq.join(idf, "phrase").join(row_sizes, "id").select("phrase", "id", part.alias("part"))
    if candidates is not None:
        scored = scored.join(candidates.select("id"), "id", "left_semi")
    return scored.join(phrases, "phrase").groupBy("query_id", "id").agg(F.sum(F.col("part") * F.col("times")).alias("score"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, fields: tuple[str, ...] = FIELDS, weights: tuple[float, ...] = EngineConfig.weights, corpus: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, score)``. ``corpus`` (default: ``chunks``) gives N, n and avgdl; ``chunks`` the candidates."""
    base = field_tokens(corpus if corpus is not None else chunks, fields)
    phrases = written(query_phrases(queries), "phrases")
    freq = written(phrase_frequencies(base, phrases, fields, weights), "freq")  # else texts are tokenised once per use
    return score(freq, written(sizes(base, fields), "sizes"), phrases, chunks if corpus is not None else None)


def top_per_query(scores: DataFrame, n: int, score: str = "score", ascending: bool = False, digits: int = 9) -> DataFrame:
    """Adds ``rank`` from 1 and keeps the best ``n`` of each query; equal scores (to ``digits`` digits) by id."""
    rounded = F.round(score, digits)
    w = Window.partitionBy("query_id").orderBy(rounded.asc() if ascending else rounded.desc(), F.col("id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def keyword_search(chunks: DataFrame, queries: DataFrame, n: int = 30, **options) -> DataFrame:
    """``(query_id, id, score, rank)``."""
    return top_per_query(bm25_scores(chunks, queries, **options), n)
