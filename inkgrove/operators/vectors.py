"""Vector retrieval: exact cosine neighbours of stated queries, and a deterministic bag-of-words embedding."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.operators.keyword import top_per_query
from inkgrove.runtime import spread, written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def usable(v: Column, dim: int) -> Column:
    """``dim`` finite numbers, not all zero."""
    return (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def nearest(rows: DataFrame, query: list[float], k: int, dim: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """``(id, distance)``: the k nearest rows of one query vector, all in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query])
    data = rows.where(usable(F.col(vector), dim))
    return data.select(F.col(id_col).alias("id"), cosine_distance(F.col(vector), q).alias("distance")).orderBy(F.round("distance", 9), "id").limit(k)


def knn(rows: DataFrame, queries: DataFrame, k: int, dim: int, id_col: str = "id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """``(query_id, id, distance, rank)``: the k nearest rows of each query ``(query_id, vector)`` by exact cosine.

    Queries go in blocks of at most ``block`` vectors, the proven bound of what is sent to the tasks. A task multiplies a
    block with its Arrow batches and keeps k rows a query and batch; the group limit of the window does the rest.
    """
    spark = rows.sparkSession
    data = rows.where(usable(F.col(vector), dim)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(usable(F.col(vector), dim)).select(F.col("query_id").cast("bigint"), vector).toLocalIterator()
    out = None
    while held := [(r[0], r[1]) for r in islice(asked, block)]:
        part = spark.sparkContext.broadcast((np.array([i for i, _ in held]), _unit(np.array([v for _, v in held], np.float64))))

        def scan(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            ids, q = part.value
            for batch in batches:
                if batch.num_rows:
                    mine = batch.column("id").to_numpy()
                    s = 1 - q @ _unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)).T
                    order = np.lexsort((np.broadcast_to(mine, s.shape), s.round(9)), axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, order.shape[1])), pa.array(mine[order].ravel()), pa.array(np.take_along_axis(s, order, axis=1).ravel())], ["query_id", "id", "distance"])

        best = top_per_query(data.mapInArrow(scan, "query_id bigint, id bigint, distance double"), k, "distance", ascending=True)
        if out is None and len(held) < block:  # the only block
            return best
        best = written(best, "nearest")
        part.unpersist()  # the driver holds one block at a time
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], "query_id bigint, id bigint, distance double, rank int")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bag_of_words(df: DataFrame, text: str, key: str, dim: int = 1024) -> DataFrame:
    """``(key, bucket, value)``: a sparse unit vector per text. The bucket of a lower-cased word is its md5 modulo ``dim`` (a power of two up to 4096)."""
    words = spread(df.select(key, text)).select(F.col(key).alias("key"), F.explode(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")).alias("word"))
    bucket = (F.conv(F.right(F.md5("word"), F.lit(3)), 16, 10).cast("int") % dim).alias("bucket")
    counts = words.groupBy("key", bucket).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("key")))  # a text has at most dim buckets
    return counts.select("key", "bucket", (F.col("n") / norm).alias("value"))


def sparse_search(rows: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """``(query_id, id, score, rank)`` by cosine of sparse unit vectors ``(key, bucket, value)``: an equi-join on the bucket, added up map-side."""
    q = queries.select(F.col("key").alias("query_id"), "bucket", F.col("value").alias("qv"))
    score = rows.join(q, "bucket").groupBy("query_id", F.col("key").alias("id")).agg(F.sum(F.col("value") * F.col("qv")).alias("score"))
    return top_per_query(score, n)
