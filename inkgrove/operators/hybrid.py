"""Fusion and ranking after retrieval: reciprocal ranks, rerank, score floor, per-note diversity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.config import EngineConfig
from inkgrove.functions.text import fold, tokens


def rrf(lists: list[DataFrame], k: int = EngineConfig.rrf_k, pool: int | None = None) -> DataFrame:
    """Fuses ranked lists ``(query_id, id, rank)``: ``(query_id, id, rrf, first_list, list_rank, rank)``, score sum of 1 / (k + rank).

    Ties keep the order in which a row first appears: an earlier list before a later one, then by rank there.
    """
    tagged = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)])
    fused = tagged.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("rrf"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), F.col("first"), F.col("id"))
    out = fused.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "rrf", F.col("first.list").alias("first_list"), F.col("first.rank").alias("list_rank"), "rank")
    return out.where(F.col("rank") <= pool) if pool else out


def diversify(hits: DataFrame, per_note: int = EngineConfig.per_note, limit: int = 5, note: str = "rel_path") -> DataFrame:
    """At most ``per_note`` hits of one note and ``limit`` of a query, in order of ``rank``; ``rank`` is renumbered."""
    kept = hits.withColumn("of_note", F.row_number().over(Window.partitionBy("query_id", note).orderBy("rank"))).where(F.col("of_note") <= per_note).drop("of_note")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= limit)


def overlap_score(query: pd.Series, text: pd.Series) -> pd.Series:
    """A deterministic stand-in for a cross-encoder: the share of the query's words that the text holds."""
    import re

    word = re.compile(r"[^\W_]+")
    return pd.Series([len(q & set(word.findall(t.lower()))) / len(q) if (q := set(word.findall((a or "").lower()))) else 0.0 for a, t in zip(query, text.fillna(""), strict=True)], dtype="float64")


def overlap_rerank(hits: DataFrame, queries: DataFrame, chars: int = EngineConfig.rerank_chars) -> DataFrame:
    """The same score as an expression that stays in the JVM; ``hits`` have query_id, title, heading, chunk_text."""
    doc = F.concat(F.lit("Title: "), F.col("title"), F.lit(" > "), F.col("heading"), F.lit("\n"), F.substring("chunk_text", 1, chars))
    q, d = F.array_distinct(tokens(fold(F.col("query")))), tokens(fold(doc))
    return hits.join(queries.select("query_id", "query"), "query_id").withColumn("rerank", F.coalesce(F.size(F.array_intersect(q, d)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0)))


def rerank(hits: DataFrame, queries: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], limit: int = 5, pool: int = EngineConfig.rerank_pool, chars: int = EngineConfig.rerank_chars) -> DataFrame:
    """Scores the first ``max(limit, pool)`` hits of each query with ``score(query, document)``, which sees at most ``chars``
    characters of the text, and renumbers ``rank`` by it; equal scores keep their order. Hits beyond the pool go."""
    run = F.pandas_udf(score, T.DoubleType())
    doc = F.concat(F.lit("Title: "), F.col("title"), F.lit(" > "), F.col("heading"), F.lit("\n"), F.substring("chunk_text", 1, chars))
    few = hits.where(F.col("rank") <= max(limit, pool)).join(queries.select("query_id", "query"), "query_id")
    scored = few.withColumn("score", run("query", doc)).drop("query")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


def apply_floor(hits: DataFrame, floor: float | None) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)``: hits at or above ``floor``, and per query that keeps none its best rejected score."""
    if floor is None:
        return hits, hits.groupBy("query_id").agg(F.max("score").alias("best_rejected")).limit(0)
    best = hits.groupBy("query_id").agg(F.max("score").alias("best_rejected")).where(F.col("best_rejected") < floor)
    return hits.where(F.col("score") >= floor), best


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds path, title, heading, text and lines; ids that are gone are dropped."""
    return hits.join(chunks.select("id", "rel_path", "title", "heading", "chunk_text", "line_start", "line_end"), "id")
