"""The k most similar vectors of every vector: a forest of random-projection trees.

Each tree splits by hyperplanes between two centres, at the median of a sample. A query goes down all trees at once with
one shared priority queue, whose keys are the smallest margin on the way to a node (positive only on the query's own
side). The queue is kept level by level: a node's key never exceeds its parent's, and every node has a leaf with the
node's own key or (on the query's side) a positive one, so keeping the ``probes`` best nodes of all trees at each level
ends with the keys of the ``probes`` leaves that a heap would pop first. Candidates are then reranked by exact cosine in
double precision, leaf by leaf.

Work at scale: hyperplanes are fitted on a bounded sample (``SAMPLE``) and broadcast (``trees * leaves * dim`` floats);
every row is indexed. Where the table is too large for the leaves this gives, the task that ranks a leaf grows a further
tree over its members and goes down that, so candidates stay a few leaves of ``leaf`` members at any size. Exact copies are
folded to one vector before the search and unfolded after it. Vectors are routed once. Neighbouring leaves of a tree
travel together as a region, so a query that visits several of them is sent once, and only its best k of the region come
back. A region with more than ``REGION_BLOCK`` members, or more than ``VISIT_BLOCK`` visitors, is cut into blocks, and
each visitor meets each block, so nothing is capped or dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.runtime import written

#: Vectors the trees are fitted on. With 16 of them a leaf, one tree has at most SAMPLE / 16 leaves.
SAMPLE = 32_768
TREES, LEAF, PROBES = 6, 512, 16
#: Leaves of a tree up to which ``PROBES`` are enough.
PROBED_LEAVES = 256
#: Members a region of neighbouring leaves aims at, and bounds of what one task ranks at once.
REGION, REGION_BLOCK, VISIT_BLOCK = 8192, 16_384, 32_768
#: float32 products closer than this are told apart in double precision.
ROUNDING = 2e-6


@dataclass(frozen=True)
class Forest:
    """Per level the hyperplanes (trees * 2**level, dim) and offsets; node q of tree t at level d is row t * 2**d + q."""

    trees: int
    depth: int
    planes: tuple[np.ndarray, ...]
    offsets: tuple[np.ndarray, ...]

    def route(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves (B, w) to visit and whether each is the vector's own leaf in its tree."""
        b = len(x)
        node = np.tile(np.arange(self.trees), (b, 1))
        key = np.full(node.shape, np.inf, np.float32)
        own = np.ones(node.shape, bool)
        for plane, offset in zip(self.planes, self.offsets, strict=True):
            margin = np.einsum("bwd,bd->bw", plane[node], x) - offset[node]
            right = margin > 0
            node = np.concatenate([2 * node, 2 * node + 1], axis=1)
            key = np.concatenate([np.minimum(key, -margin), np.minimum(key, margin)], axis=1)
            own = np.concatenate([own & ~right, own & right], axis=1)
            if node.shape[1] > probes:
                top = np.argpartition(np.where(own, -np.inf, -key), probes - 1, axis=1)[:, :probes]
                node, key, own = (np.take_along_axis(a, top, axis=1) for a in (node, key, own))
        return node, own


def grow(sample: np.ndarray, trees: int, depth: int, seed: int = 7) -> Forest:
    """Fits the forest. A node's plane lies between two centres that a few rounds of 2-means move apart."""
    dim = sample.shape[1]
    planes = [np.zeros((trees << d, dim), np.float32) for d in range(depth)]
    offsets = [np.zeros(trees << d, np.float32) for d in range(depth)]
    for t in range(trees):
        rng = np.random.default_rng(seed + t)
        members = [np.arange(len(sample))]
        for d in range(depth):
            below = []
            for q, rows in enumerate(members):
                plane, pts = rng.normal(size=dim).astype(np.float32), sample[rows]
                if len(rows) > 2:
                    a, c = pts[rng.choice(len(rows), 2, replace=False)]
                    for _ in range(4):
                        near = pts @ (a - c) > 0
                        if near.all() or not near.any():
                            break
                        a, c = pts[near].mean(axis=0), pts[~near].mean(axis=0)
                    if np.linalg.norm(a - c) > 1e-6:
                        plane = a - c
                plane /= np.linalg.norm(plane)
                along = pts @ plane
                cut = np.float32(np.median(along)) if len(rows) else np.float32(0)
                planes[d][(t << d) + q], offsets[d][(t << d) + q] = plane, cut
                below += [rows[along <= cut], rows[along > cut]]
            members = below
    return Forest(trees, depth, tuple(planes), tuple(offsets))


def probes_of(depth: int) -> int:
    """Leaves to visit in trees of this depth: with a fixed number the share searched, and with it the recall, falls as the table grows."""
    return max(PROBES, math.ceil(PROBES * ((1 << depth) / PROBED_LEAVES) ** (2 / 3)))


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as a binary column."""
    x = np.ascontiguousarray(x, np.float32)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def usable(df: DataFrame, dim: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``(id, vec)`` of rows whose vector has ``dim`` finite numbers, not all zero; ``vec`` is binary float32 as stored."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = df.where(F.col(id_col).isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<float>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) + np.float32(0)
                yield pa.RecordBatch.from_arrays([batch.column("id"), _binary(x)], ["id", "vec"])

    return good.mapInArrow(pack, "id bigint, vec binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else very large and very small numbers overflow
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision between a (n, d) and b (n, k, d)."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("nd,nkd->nk", a, b) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=2))


def _by_product(ids: np.ndarray, q: np.ndarray, member_ids: np.ndarray, members: np.ndarray, k: int, take: int, rounding: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``take`` members (B, take) with the largest products in the precision of ``q``, and for which queries more of them
    than that lie within ``rounding`` of the k-th."""
    s = q @ members.T
    s[ids[:, None] == member_ids[None, :]] = -2
    if take >= len(members):
        return np.tile(np.arange(len(members)), (len(q), 1)), np.zeros(len(q), bool)
    top = np.argpartition(-s, take - 1, axis=1)[:, :take]
    best = -np.sort(-np.take_along_axis(s, top, axis=1), axis=1)
    return top, best[:, k - 1] - best[:, -1] < rounding


def top_in_block(query_ids: np.ndarray, queries: np.ndarray, member_ids: np.ndarray, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, other id, cosine): the k most similar members of each query but itself, by exact cosine, ties to the smaller id.

    float32 products select the candidates; where more of them lie within rounding of the k-th, products in double precision
    do, and where even those are tied, all members count.
    """
    out, wide = [], None

    def rank(ids: np.ndarray, q: np.ndarray, top: np.ndarray) -> None:
        cos = np.where(ids[:, None] == member_ids[top], -2, _exact(q, members[top]))
        order = np.lexsort((member_ids[top], -cos), axis=1)[:, :k]
        cos, near = np.take_along_axis(cos, order, axis=1), member_ids[np.take_along_axis(top, order, axis=1)]
        real = cos > -2
        out.append((np.repeat(ids, real.sum(axis=1)), near[real], cos[real]))

    for a in range(0, len(queries), 1024):
        ids, q = query_ids[a : a + 1024], queries[a : a + 1024]
        top, tied = _by_product(ids, q, member_ids, members, k, min(k + 4, len(members)), ROUNDING)
        rank(ids[~tied], q[~tied], top[~tied])
        wide = members.astype(np.float64) if wide is None and tied.any() else wide
        left = np.flatnonzero(tied)
        for b in range(0, len(left), 256):
            part = left[b : b + 256]
            top, still = _by_product(ids[part], q[part].astype(np.float64), member_ids, wide, k, min(4 * k + 16, len(members)), 1e-13)
            rank(ids[part][~still], q[part][~still], top[~still])
            for j in part[still]:
                rank(ids[j : j + 1], q[j : j + 1], np.arange(len(members))[None, :])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _first(q: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its k best, in order; a pair found twice counts once."""
    order = np.lexsort((other, -cos, q))
    q, other, cos = q[order], other[order], cos[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (other[1:] != other[:-1])
    q, other, cos = q[fresh], other[fresh], cos[fresh]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[place < k], other[place < k], cos[place < k]


def top_in_leaf(query_ids: np.ndarray, queries: np.ndarray, member_ids: np.ndarray, members: np.ndarray, k: int, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``top_in_block``, but a leaf of more than two times ``leaf`` members is searched by a tree of its own."""
    if len(members) <= 2 * leaf:
        return top_in_block(query_ids, queries, member_ids, members, k)
    depth = math.ceil(math.log2(len(members) / leaf))
    order = np.argsort(member_ids * np.int64(0x9E3779B97F4A7C1))  # the same tree whatever the order of rows
    below = grow(members[order[:SAMPLE]], 1, depth, seed=len(members))
    home = np.concatenate([below.route(members[a : a + 2048], 1)[0][:, 0] for a in range(0, len(members), 2048)])
    probes = min(1 << depth, math.ceil(2 ** (2 * depth / 3)))  # the law by which probes grow with leaves
    visits = np.concatenate([below.route(queries[a : a + 2048], probes)[0] for a in range(0, len(queries), 2048)])
    found = []
    for node in range(1 << depth):
        mine, asked = home == node, (visits == node).any(axis=1)
        if mine.any() and asked.any():
            found.append(top_in_block(query_ids[asked], queries[asked], member_ids[mine], members[mine], k))
    return _first(*(np.concatenate(x) for x in zip(*found, strict=True)), k)


NEAR = "array<struct<d:double,other:bigint>>"


def _nearest(scored: DataFrame, k: int) -> DataFrame:
    """``(id, near)``, ``near`` in order of d = -cosine and id, from scored candidates; a query has a bounded number of them (probes * k).

    One pair gets the same cosine in every leaf, bit by bit, so its repeats are neighbours once sorted.
    """
    pool = scored.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("pool"))
    fresh = F.filter("pool", lambda x, i: (i == 0) | (x != F.element_at("pool", F.greatest(i, F.lit(1)))))
    return pool.select("id", F.slice(fresh, 1, k).alias("near"))


def search(vectors: DataFrame, dim: int, k: int, min_cosine: float | None = None, trees: int = TREES, leaf: int = LEAF, probes: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """``(id, near)`` for distinct ``(id, vec)``: every row is indexed and every row is a query. Candidates under ``min_cosine``
    are dropped in their leaf, before the shuffle; those above it keep their ranks. Without ``probes`` they follow from the
    depth of the trees."""
    spark = vectors.sparkSession
    n = vectors.count()
    if n < 2:
        return spark.createDataFrame([], f"id bigint, near {NEAR}")
    share = int(min(1.0, 1.05 * sample / n) * (1 << 20)) + 1
    rows = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).select("vec").limit(sample).collect()
    fitted = _unit(np.frombuffer(b"".join(bytes(r.vec) for r in rows), np.float32).reshape(-1, dim)) if rows else np.zeros((0, dim), np.float32)
    depth = max(0, min(math.ceil(math.log2(max(1, n / leaf))), int(math.log2(max(1, len(fitted) / 16)))))
    probes = probes_of(depth) if probes is None else probes
    width = min(max(probes, trees), trees << depth)
    shift = max(0, min(depth, math.floor(math.log2(max(1, REGION * (1 << depth) / n)))))  # neighbouring leaves of a region
    size, local = (trees << depth) >> shift, (1 << shift) - 1
    forest = spark.sparkContext.broadcast(grow(fitted, trees, depth))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                x = _unit(_matrix(batch.column("vec").slice(a, 2048), dim))
                node, own = f.route(x, width)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, 2048), _binary(x), _binary(np.where(own, ~node, node).astype(np.int32).view(np.float32))], ["id", "vec", "nodes"])

    routed = written(vectors.mapInArrow(route, "id bigint, vec binary, nodes binary"), "routed")

    def nodes_of(batch: pa.RecordBatch, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Visited leaves (B, w) and whether each is the vector's own."""
        coded = np.frombuffer(b"".join(batch.column("nodes").slice(a, 2048).to_pylist()), np.int32).reshape(-1, width)
        return np.where(coded < 0, ~coded, coded).astype(np.int64), coded < 0

    def by_region(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order that brings the visits of a row to a region together, and where each such group starts in it."""
        key = (np.arange(len(node))[:, None] * size + (node >> shift)).ravel()
        order = np.argsort(key, kind="stable")
        return order, np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, visits = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                node, own = nodes_of(batch, a)
                order, starts = by_region(node)
                visits += np.bincount((node >> shift).ravel()[order[starts]], minlength=size)
                members += np.bincount((node >> shift)[own], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(members), pa.array(visits)], ["region", "m", "v"])

    blocks, salts = np.ones(size, np.int64), np.ones(size, np.int64)
    for r in routed.select("nodes").mapInArrow(count, "region bigint, m bigint, v bigint").groupBy("region").agg(F.sum("m").alias("m"), F.sum("v").alias("v")).where(f"m > {REGION_BLOCK} or v > {VISIT_BLOCK}").collect():
        blocks[r.region], salts[r.region] = max(1, -(-r.m // REGION_BLOCK)), max(1, -(-r.v // VISIT_BLOCK))
    cuts = spark.sparkContext.broadcast((blocks, salts))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nb, ns = cuts.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                ids = batch.column("id").slice(a, 2048).to_numpy()
                vec = batch.column("vec").slice(a, 2048)
                node, own = nodes_of(batch, a)
                order, starts = by_region(node)
                row, g = order[starts] // node.shape[1], (node >> shift).ravel()[order[starts]]
                inside = (node & local).ravel()[order]
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.append(starts, len(order)), len(order)).astype(np.int32)), pa.array(inside.astype(np.int32)))  # the last is empty
                own_leaf = np.maximum.reduceat(np.where(own.ravel()[order], inside, -1), starts)
                mix = ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                block, salt = (mix % nb[g].astype(np.uint64)).astype(np.int64), (mix // np.uint64(131) % ns[g].astype(np.uint64)).astype(np.int64)
                every = np.arange(len(row))
                parts = [(every, block, salt, own_leaf, np.ones(len(row), bool))]  # a query here and, in its own leaf, a member
                for j in np.flatnonzero(nb[g] > 1):  # a query meets the other blocks of a large region
                    others = np.delete(np.arange(nb[g[j]]), block[j])
                    parts.append((np.full(len(others), j), others, np.full(len(others), salt[j]), np.full(len(others), -1), np.ones(len(others), bool)))
                for j in np.flatnonzero((own_leaf >= 0) & (ns[g] > 1)):  # a member stands in every share of a much visited region
                    others = np.delete(np.arange(ns[g[j]]), salt[j])
                    parts.append((np.full(len(others), j), np.full(len(others), block[j]), others, np.full(len(others), own_leaf[j]), np.zeros(len(others), bool)))
                j, bl, sa, leaf_of, asks = (np.concatenate(p) for p in zip(*parts, strict=True))
                visited = lists.take(pa.array(np.where(asks, j, len(row))))
                yield pa.RecordBatch.from_arrays([pa.array((g[j] << 32) + (bl << 16) + sa), pa.array(ids[row[j]]), pa.array(leaf_of.astype(np.int32)), visited, vec.take(pa.array(row[j]))], ["cell", "id", "home", "visited", "vec"])

    def rank(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), _matrix(table.column("vec"), dim)
        home, visited = table.column("home").to_numpy(), table.column("visited").combine_chunks()
        asked = np.repeat(np.arange(len(ids)), np.diff(visited.offsets.to_numpy()))
        node = visited.flatten().to_numpy()
        found = []
        for n in np.intersect1d(np.unique(node), home):
            mine, q = np.flatnonzero(home == n), asked[node == n]
            found.append(top_in_leaf(ids[q], x[q], ids[mine], x[mine], k, leaf))
        if not found:
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], near_type)})
        q, other, cos = _first(*(np.concatenate(y) for y in zip(*found, strict=True)), k)
        if min_cosine is not None:
            q, other, cos = q[cos >= min_cosine], other[cos >= min_cosine], cos[cos >= min_cosine]
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(q)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(-cos), pa.array(other)], ["d", "other"]))
        return pa.table({"id": pa.array(q[starts]), "near": lists})

    near_type = pa.list_(pa.struct([("d", pa.float64()), ("other", pa.int64())]))
    scored = routed.mapInArrow(visit, "cell bigint, id bigint, home int, visited array<int>, vec binary").groupBy("cell").applyInArrow(rank, f"id bigint, near {NEAR}")
    return _nearest(scored, k)


def folded(vectors: DataFrame, k: int) -> DataFrame:
    """``(id, vec, ids)``: one row per distinct vector; ``ids`` are its k + 1 smallest ids, ``id`` the first of them.

    The rank filter is pushed below the shuffle, so a vector with a third of all rows sends k + 1 rows per task.
    """
    ranked = vectors.withColumn("rank", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("rank") <= k + 1)
    ids = F.sort_array(F.collect_list("id"))
    return ranked.groupBy("vec").agg(ids.alias("ids")).select(F.col("ids")[0].alias("id"), "vec", "ids")


def nearest_neighbours(df: DataFrame, k: int = 5, dim: int = 64, min_cosine: float | None = None, id_col: str = "id", vector_col: str = "embedding", **forest) -> DataFrame:
    """``(id, rank, other, cosine)``: for every usable vector the k most similar other rows, ties to the smaller id.

    Unusable vectors (null, wrong length, not finite, all zero) neither ask nor answer. Rows with equal vectors are each
    other's neighbours with cosine 1; of more than k copies those with the smallest ids are named. With ``min_cosine``
    less similar neighbours are left out, which changes no rank of the others. Repeated ids count as one row each.
    Further columns are ignored.
    """
    all_rows = usable(df, dim, id_col, vector_col)
    groups = written(folded(all_rows, k), "vectors")
    found = search(groups.select("id", "vec"), dim, k, min_cosine, **forest).select("id", F.explode("near").alias("n")).select("id", "n.other", "n.d")
    copies = groups.where(F.size("ids") > 1).select(F.col("id").alias("other"), F.col("ids").alias("other_ids"))
    known = found.join(copies, "other", "left").select("id", F.transform(F.coalesce("other_ids", F.array("other")), lambda x: F.struct("d", x.alias("other"))).alias("near"))
    near = known.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))  # at most k lists of k + 1
    whole = groups.select("id", "ids").join(near, "id", "left")
    own = F.transform("ids", lambda x: F.struct(F.lit(-1.0).alias("d"), x.alias("other"))).cast(NEAR)
    pool = F.concat(own, F.coalesce(F.col("near").cast(NEAR), F.array().cast(NEAR)))
    each = whole.select(F.explode("ids").alias("me"), pool.alias("pool")).select("me", F.slice(F.array_sort(F.filter("pool", lambda x: x["other"] != F.col("me"))), 1, k).alias("near"))
    full = groups.where(F.size("ids") > k).select("vec", "ids")  # copies beyond the k + 1 smallest ids
    ranked = [F.col("me").alias("id"), F.posexplode("near").alias("rank", "n")]
    final = [F.col("id"), (F.col("rank") + 1).alias("rank"), F.col("n.other"), (-F.col("n.d")).alias("cosine")]
    if full.isEmpty():  # no vector with more copies than that: the vectors need not be shuffled once more
        return each.select(*ranked).select(*final)
    rest = all_rows.join(full, "vec").where(~F.array_contains("ids", F.col("id"))).select(F.col("id").alias("me"), F.slice(own, 1, k).alias("near"))
    return each.unionByName(rest).select(*ranked).select(*final)


def similar_pairs(df: DataFrame, min_cosine: float = 0.9, **options) -> DataFrame:
    """``(id_a, id_b)``, smaller id first, once: pairs of at least ``min_cosine`` where one is among the k most similar of the other."""
    near = nearest_neighbours(df, min_cosine=min_cosine, **options)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def brute_force(df: DataFrame, queries: DataFrame, k: int = 5, dim: int = 64, block: int = 2048) -> DataFrame:
    """``(id, near)`` of a stated query set against all rows, for measuring recall: queries stream through the driver in
    blocks, each is broadcast, met with all rows and done with before the next."""
    spark = df.sparkSession
    rows = usable(df, dim)

    def blocks() -> Iterator[list]:
        held: list = []
        for r in usable(queries, dim).toLocalIterator():
            held.append((r.id, bytes(r.vec)))
            if len(held) == block:
                yield held
                held = []
        if held:
            yield held

    out = None
    for held in blocks():
        part = spark.sparkContext.broadcast((np.array([i for i, _ in held]), _unit(np.frombuffer(b"".join(v for _, v in held), np.float32).reshape(-1, dim))))

        def scan(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            ids, x = part.value
            for batch in batches:
                if batch.num_rows:
                    found = top_in_block(ids, x, batch.column("id").to_numpy(), _unit(_matrix(batch.column("vec"), dim)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(y) for y in found], ["id", "other", "cosine"])

        near = rows.mapInArrow(scan, "id bigint, other bigint, cosine double").select("id", F.array(F.struct((-F.col("cosine")).alias("d"), "other")).alias("near"))
        found = written(_nearest(near, k), "truth")
        part.unpersist()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"id bigint, near {NEAR}") if out is None else out


def recall(df: DataFrame, k: int = 5, every: int = 100, dim: int = 64, **options) -> DataFrame:
    """One row ``(queries, found, wanted, recall)``: neighbours against brute force for ids divisible by ``every``; a neighbour counts if it is as similar as the k-th true one."""
    asked = df.where(F.col("id") % every == 0)
    truth = brute_force(df, asked, k, dim).select("id", (-F.element_at("near", -1)["d"]).alias("least"), F.size("near").alias("want"))
    got = nearest_neighbours(df, k, dim, **options).where(F.col("id") % every == 0).join(truth, "id", "right")
    per = got.groupBy("id", "want").agg(F.sum(F.when(F.col("cosine") >= F.col("least") - 1e-6, 1).otherwise(0)).alias("hit"))
    return per.agg(F.count("*").alias("queries"), F.sum(F.least("hit", "want")).alias("found"), F.sum("want").alias("wanted")).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 4))
