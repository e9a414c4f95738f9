"""Retrieval quality over many queries at once: hit@k, recall@k, reciprocal rank, latency and score distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.functions.paths import path_key
from inkgrove.runtime import written


def _bare(path: Column) -> Column:
    return F.regexp_replace(path_key(path), r"\.md$", "")


def judged(hits: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, hit, recall, rr)`` per golden query ``(query_id, expected)`` from ``hits (query_id, rank, rel_path)``.

    An expected entry is a path, or a bare name that equals a note's base name. Queries without expectations are refused
    by the source and ignored here.
    """
    wanted = golden.where(F.size("expected") > 0).select("query_id", F.posexplode("expected").alias("at", "e"), F.size("expected").alias("n"))
    wanted = wanted.select("query_id", "at", "n", _bare(F.col("e")).alias("want"))
    got = hits.where(F.col("rank") <= k).select("query_id", "rank", _bare(F.col("rel_path")).alias("path"))
    got = got.select("query_id", "rank", "path", F.element_at(F.split("path", "/"), -1).alias("name"))
    match = (F.col("path") == F.col("want")) | (~F.contains("want", F.lit("/")) & (F.col("name") == F.col("want")))
    joined = wanted.join(got, "query_id", "left").withColumn("ok", F.coalesce(match, F.lit(False)))
    per = joined.groupBy("query_id").agg(
        F.max("n").alias("n"), F.min(F.when(F.col("ok"), F.col("rank"))).alias("first"), F.count_distinct(F.when(F.col("ok"), F.col("path"))).alias("found")
    )
    return per.select(
        "query_id", F.col("first").isNotNull().cast("int").alias("hit"), F.least(F.lit(1.0), F.col("found") / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr")
    )


def six_digits(value: Column) -> Column:
    """Rounded to six digits, so that sums in another order give the same result: ties, even missed by a hair, go up."""
    return F.floor(value * 1e6 + 0.500001) / F.lit(1e6)


def summary(judgements: DataFrame) -> DataFrame:
    """One row ``(queries, hit_at_k, recall_at_k, mrr)``."""
    return judgements.agg(F.count("*").alias("queries"), *[six_digits(F.coalesce(F.avg(c), F.lit(0.0))).alias(n) for c, n in (("hit", "hit_at_k"), ("recall", "recall_at_k"), ("rr", "mrr"))])


def _ordered(samples: DataFrame, value: str, group: str) -> DataFrame:
    """``(group, v, c, upto, n)``: distinct values with their counts, running counts and the group's size.

    Equal values are counted first (map-side), then laid out in order over all tasks, however few the groups are; the running
    count is that inside a part plus the sums of the parts before it, of which there are as many as partitions.
    """
    v = F.col(value).cast("double")
    counts = samples.where(v.isNotNull()).groupBy(group, v.alias("v")).agg(F.count("*").alias("c"))
    laid = written(counts.repartitionByRange(group, "v").withColumn("part", F.spark_partition_id()), "ordered")
    sums = laid.groupBy(F.col(group).alias("of"), F.col("part").alias("at")).agg(F.sum("c").alias("s"))
    w = Window.partitionBy("of")
    base = sums.select("of", "at", (F.sum("s").over(w.orderBy("at")) - F.col("s")).alias("before"), F.sum("s").over(w).alias("n"))
    joined = laid.join(base, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    inside = F.sum("c").over(Window.partitionBy(group, "part").orderBy("v"))
    return joined.select(group, "v", "c", (F.col("before") + inside).alias("upto"), "n")


def _at(position: Column) -> Column:
    """The value at a position from 1 in sorted order."""
    return F.min(F.when(F.col("upto") >= position, F.col("v")))


def latency_stats(samples: DataFrame, value: str, group: str) -> DataFrame:
    """``(group, n, avg_ms, p95_ms)``; p95 is the value at position ``floor(0.95 * (n - 1))`` from 0, no interpolated percentile."""
    return _ordered(samples, value, group).groupBy(group).agg(
        F.max("n").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 6).alias("avg_ms"), _at(F.floor(F.lit(0.95) * (F.col("n") - 1)) + 1).alias("p95_ms")
    )


def score_quantiles(samples: DataFrame, value: str, group: str) -> DataFrame:
    """``(group, n, low, p10, median, high)``; p10 by the exclusive method (position 0.1 * (n + 1)), null below two values."""
    n = F.col("n")
    j = F.least(F.greatest(F.floor(0.1 * (n + 1)), F.lit(1)), n - 1)
    low, high, share = _at(j), _at(j + 1), F.max(0.1 * (n + 1) - j)
    return _ordered(samples, value, group).groupBy(group).agg(
        F.max("n").alias("n"), F.min("v").alias("low"), F.round(F.when(F.max("n") > 1, low + (high - low) * share), 6).alias("p10"),
        F.round((_at(F.floor((n + 1) / 2)) + _at(F.floor((n + 2) / 2))) / 2, 6).alias("median"), F.max("v").alias("high"),
    )


def report(rows: DataFrame) -> str:
    """A markdown table of ``Engine.evaluate`` results (one row per mode, so few rows are collected)."""
    names = [c for c in ("mode", "queries", "hit_at_k", "recall_at_k", "mrr", "avg_ms", "p95_ms") if c in rows.columns]
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for r in rows.orderBy("mode").collect():
        lines.append("| " + " | ".join(f"{r[c]:.2f}" if isinstance(r[c], float) else str(r[c]) for c in names) + " |")
    return "\n".join(lines)
