import numpy as np

from inkgrove.llm import neighbours as N


def frame(spark, x, ids=None, extra=()):
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame([*rows, *extra], "id bigint, embedding array<float>")


def leaf_key(f, x, leaf):
    """The key of a leaf (of depth 5) by its path from the root."""
    key, tree, q = -np.inf, leaf >> 5, leaf & 31
    for d in range(5):
        at = (tree << d) + (q >> (5 - d))
        m = float(f.planes[d][at] @ x - f.offsets[d][at])
        key = max(key, -m if q >> (4 - d) & 1 else m)
    return key


def test_route_is_the_shared_queue():
    """The level-wise beam ends with leaves of the same keys that a heap over all trees pops first (many leaves share a key)."""
    import heapq

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    f = N.grow(x, 3, 5)
    node, own = f.route(x[:40], 7)
    assert (own.sum(axis=1) == 3).all()
    for k in range(40):
        heap, popped = [(-np.inf, t, 0) for t in range(3)], []
        while heap and len(popped) < 7:
            key, n, d = heapq.heappop(heap)
            if d == 5:
                popped.append(key)
                continue
            m = float(f.planes[d][n] @ x[k] - f.offsets[d][n])
            heapq.heappush(heap, (max(key, m), 2 * n, d + 1))
            heapq.heappush(heap, (max(key, -m), 2 * n + 1, d + 1))
        assert np.allclose(sorted(popped), sorted(leaf_key(f, x[k], n) for n in node[k]), atol=1e-5)


def test_recall_and_exact_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(40, size=3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32)
    df = frame(spark, x)
    r = N.recall(df, 5, 10, dim=16, leaf=128).first()
    assert r.queries == 300 and r.recall >= 0.9
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype(float) @ u.T.astype(float)
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :5]
    want = {(min(a, b), max(a, b)) for a in range(3000) for b in top[a] if s[a, b] >= 0.98}
    got = {tuple(p) for p in N.similar_pairs(df, 0.98, dim=16, leaf=128).collect()}
    assert len(want & got) >= 0.97 * len(want) and not got - want


def test_copies_ties_and_unusable(spark):
    x = np.eye(4, dtype=np.float32)
    copies = np.tile([[1, 1, 0, 0]], (9, 1)).astype(np.float32)
    bad = [(100, None), (101, [0.0] * 4), (102, [1.0] * 3), (103, [float("nan"), 1.0, 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0, 1.0]), (105, [1.0, None, 1.0, 1.0]), (None, [1.0] * 4)]
    df = frame(spark, np.concatenate([x, copies]), [*range(4), *range(10, 19)], bad)
    near = {}
    for r in N.nearest_neighbours(df, 5, 4).collect():
        near.setdefault(r.id, []).append((r.rank, r.other, round(r.cosine, 6)))
    assert set(near) == {*range(4), *range(10, 19)}
    assert [o for _, o, _ in sorted(near[18])] == [10, 11, 12, 13, 14] and [o for _, o, _ in sorted(near[12])] == [10, 11, 13, 14, 15]
    assert [o for _, o, _ in sorted(near[0])] == [10, 11, 12, 13, 14] and sorted(near[3])[0][1] == 0
    pairs = {tuple(p) for p in N.similar_pairs(df, 0.9, dim=4).collect()}
    assert (10, 18) in pairs and (17, 18) not in pairs and all(a >= 10 for a, _ in pairs)
    assert N.similar_pairs(df.limit(0), 0.9, dim=4).count() == 0 and N.similar_pairs(df.where("id = 1"), 0.9, dim=4).count() == 0


def test_large_leaves_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "REGION_BLOCK", 64)
    monkeypatch.setattr(N, "VISIT_BLOCK", 100)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(700, 8))).astype(np.float32)
    df = frame(spark, x)
    got = {(r.id, r.other) for r in N.nearest_neighbours(df, 3, 8, leaf=10_000).collect()}
    want = {(r.id, n.other) for r in N.brute_force(df, df, 3, 8).collect() for n in r.near}
    assert got == want


def test_recall_stays_as_the_leaves_grow_in_number(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(40, 16))[rng.integers(40, size=30_000)] + 0.6 * rng.normal(size=(30_000, 16))).astype(np.float32)
    r = N.recall(frame(spark, x), 5, 100, dim=16, leaf=32).first()  # 1024 leaves a tree
    assert r.queries == 300 and r.recall >= 0.95


def test_trees_inside_leaves_take_over_where_the_sample_allows_no_deeper_forest(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(40, 16))[rng.integers(40, size=30_000)] + 0.6 * rng.normal(size=(30_000, 16))).astype(np.float32)
    r = N.recall(frame(spark, x), 5, 100, dim=16, leaf=64, sample=256).first()  # 16 leaves a tree from the sample, 32 more inside each
    assert r.recall >= 0.95


def test_vectors_closer_than_rounding(spark):
    """Many vectors within float32 rounding of each other: the exact order decides, ties go to the smaller id."""
    rng = np.random.default_rng(9)
    near = np.ones((60, 8)) + 1e-7 * rng.integers(-3, 4, size=(60, 8))
    ids, x = np.arange(60), N._unit(near.astype(np.float32))
    q, other, cos = N.top_in_block(ids, x, ids, x, 3)
    e = N._exact(x, np.tile(x, (60, 1, 1)))
    np.fill_diagonal(e, -2)
    want = np.lexsort((np.tile(ids, (60, 1)), -e), axis=1)[:, :3]
    got = {i: other[q == i].tolist() for i in ids}
    assert all(np.allclose(e[i, got[i]], e[i, want[i]], atol=0) for i in ids)
