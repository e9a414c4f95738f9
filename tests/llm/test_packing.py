import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrove.llm import packing as P
from inkgrove.llm.tokens import FOLDER, token_count


def test_fill_keeps_everything_and_the_mixture():
    rng = random.Random(1)
    items = [(rng.choice([0, 0, 0, 1, 2]), rng.randint(1, 100), n) for n in range(3000)]
    total = np.bincount([s for s, *_ in items], weights=[z for _, z, _ in items])
    share = total / total.sum()
    windows = P.fill(items, share, np.zeros(3), 100)
    flat = [i for w in windows for *_, i in w]
    assert sorted(flat) == list(range(3000)) and all(sum(z for _, z, _ in w) <= 100 for w in windows)
    assert total.sum() / (100 * len(windows)) > 0.98
    for a in range(0, len(windows) - 100, 50):
        part = np.zeros(3)
        for w in windows[a : a + 50]:
            for s, z, _ in w:
                part[s] += z
        assert np.abs(part / part.sum() - share).max() < 0.1


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(n, "w " * rng.randint(1, 90), rng.choice(["a", "a", "b", "c"]), "x") for n in range(2000)]
    rows += [(5000, "w " * 731, "a", "x"), (5001, "w " * 200, "b", "x"), (5002, "", "b", "x"), (5003, None, "c", "x"), (5004, "w w", None, "x"), (None, "w w w", "a", "x"), (5, "w " * 30, "a", "x"), (5, "w " * 30, "a", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, position string")


def spaces():
    return F.size(F.filter(F.split("text", " "), lambda w: w != ""))


def test_pack(spark, docs):
    out = P.pack(docs, 100, tokens=spaces(), shard_tokens=20_000).collect()
    per = {}
    for r in out:
        per.setdefault(r.sequence_id, []).append(r)
    assert max(sum(r.n_tokens for r in w) for w in per.values()) <= 100 and len({s >> 32 for s in per}) > 2
    assert all([r.position for r in sorted(w, key=lambda r: r.position)] == list(range(len(w))) for w in per.values())
    want = sum(r.n for r in docs.select(F.greatest(F.coalesce(spaces(), F.lit(0)), F.lit(0)).alias("n")).collect())
    assert sum(r.n_tokens for r in out) == want and want / (100 * len(per)) > 0.97
    assert [(r.part_no, r.n_tokens) for r in sorted((r for r in out if r.doc_id == 5000), key=lambda r: r.part_no)] == [(k, 100) for k in range(7)] + [(7, 31)]
    assert sum(r.doc_id == 5 for r in out) == 3 and {r.n_tokens for r in out if r.doc_id in (5002, 5003)} == {0} and sum(r.doc_id is None for r in out) == 1
    assert {r.source for r in out if r.doc_id == 5004} == {P.NO_SOURCE} and len({(r.doc_id, r.part_no) for r in out}) == len(out) - 2
    assert sorted(map(tuple, P.pack(docs.repartition(7), 100, tokens=spaces(), shard_tokens=20_000).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_targets_and_reports(spark, docs):
    packed = P.pack(docs, 100, {"c": 0.6, "a": 0.3, "b": 0.1}, tokens=spaces(), shard_tokens=1_000_000)
    first = packed.where("sequence_id < 100 and source <> '(none)'").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    n = {r.source: r.n for r in first}
    assert abs(n["c"] / sum(n.values()) - 0.6) < 0.05
    assert P.fill_report(packed, 100).first().filled > 0.92 and P.mixture_report(packed).count() == 4
    assert P.pack(docs.limit(0), 100, tokens=spaces()).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tokenizer files")
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("ünïcödé 漢字",)], "text string")
    n = [r[0] for r in df.select(token_count(F.col("text"), name)).collect()]
    assert n[0] in (2, 3) and n[1] == n[2] == 0 and n[3] > 2


def test_reports_see_starved_sources_any_run_and_gaps(spark, monkeypatch):
    def packed(*sequences):
        rows = [(sid, at, 1, 0, s, n) for sid, w in sequences for at, (s, n) in enumerate(w.items())]
        return spark.createDataFrame(rows, P.PACKED)

    starved = packed(*[(k, {"a": 4, "b": 6}) for k in range(4)], *[(k, {"a": 10}) for k in (4, 5)])
    assert {r.source: (r.share, r.worst) for r in P.mixture_report(starved, 2).collect()} == {"a": (0.6, 0.4), "b": (0.4, 0.4)}
    between = packed((0, {"a": 10}), (1, {"b": 10}), (1 << 32, {"b": 10}), ((1 << 32) + 1, {"a": 10}))
    monkeypatch.setattr(P, "STRETCH", 2)
    assert {r.source: (r.share, r.worst) for r in P.mixture_report(between, 2).collect()} == {"a": (0.5, 0.5), "b": (0.5, 0.5)}
    assert {r.source: r.worst for r in P.mixture_report(between, 64).collect()} == {"a": 0.0, "b": 0.0}
    gaps = packed((0, {"a": 7}), (1, {"a": 10}), (2, {"a": 1}), (1 << 32, {"a": 2}))
    assert P.fill_report(gaps, 10).first().gap == 3
