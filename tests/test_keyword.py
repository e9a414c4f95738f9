"""BM25 against the full-text engine of the standard library, fusion, diversity, rerank, quantiles."""

import random
import sqlite3
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkgrove.functions.text import STOPWORDS, cut, occurrences, query_terms, split_lines, strip
from inkgrove.operators import evaluate, filters, hybrid, keyword

WORDS = "boat lantern café où foo_bar bge-m3 the trellis Über pump2 rope reef".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)

    def text(n):
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return [(n, text(rng.randint(0, 3)), text(rng.randint(0, 4)), text(rng.randint(0, 12)), text(rng.randint(0, 60))) for n in range(1, 200)]


@pytest.mark.parametrize("query", ["boat lantern", "cafe", "bge-m3", "foo_bar pump2 boat boat", "over UBER", "rope-reef où", "the", "zzz"])
def test_scores_match_fts5(spark, corpus, query):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(title, heading, summary, chunk_text, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    db.executemany("INSERT INTO t(rowid, title, heading, summary, chunk_text) VALUES (?, ?, ?, ?, ?)", corpus)
    terms = [t for t in query.split() if t not in STOPWORDS] or query.split()
    want = dict(db.execute("SELECT rowid, -bm25(t, 2.0, 3.0, 0.2, 1.0) FROM t WHERE t MATCH ?", (" OR ".join(f'"{t}"' for t in terms),)).fetchall())
    chunks = spark.createDataFrame(corpus, "id bigint, title string, heading string, summary string, chunk_text string")
    got = {r.id: r.score for r in keyword.bm25_scores(chunks, spark.createDataFrame([(1, query)], "query_id bigint, query string")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_query_terms(spark):
    df = spark.createDataFrame([("How is the boat, really?",), ("the of",), ("bge-m3 NOT -x- _y",), ("",)], "q string")
    assert [r[0] for r in df.select(query_terms(F.col("q"))).collect()] == [["boat", "really"], ["the", "of"], ["bge-m3", "NOT", "x", "y"], []]


def test_text_expressions(spark):
    df = spark.createDataFrame([("  a \t",), ("a\r\nb\n\nc d\n",), ("",), (None,)], "t string")
    rows = df.select(strip(F.col("t")), split_lines(F.col("t")), cut(F.col("t"), 3), occurrences(F.col("t"), "\n")).collect()
    assert rows[0][0] == "a" and rows[1][1] == ["a", "b", "", "c", "d"] and rows[2][1] == [] and rows[1][2] == "a\r\n..." and rows[1][3] == 4 and rows[3][1] is None


def lists(spark, *ranked):
    return [spark.createDataFrame([(1, i, r) for r, i in enumerate(x, 1)], "query_id bigint, id bigint, rank int") for x in ranked]


def test_rrf_keeps_first_seen_order_on_ties(spark):
    out = hybrid.rrf(lists(spark, [10, 20, 30], [20, 40])).orderBy("rank").collect()
    assert [r.id for r in out] == [20, 10, 40, 30] and abs(out[0].rrf - (1 / 62 + 1 / 61)) < 1e-12
    assert [r.id for r in hybrid.rrf(lists(spark, [1], [2])).orderBy("rank").collect()] == [1, 2]


def test_diversify_floor_and_rerank(spark):
    hits = spark.createDataFrame([(1, i, i, n, "T", "H", f"boat {i} rope" if i > 2 else "nothing") for i, n in enumerate("aaabb", 1)], "query_id bigint, id bigint, rank int, rel_path string, title string, heading string, chunk_text string")
    assert [r.id for r in hybrid.diversify(hits, 2, 3).orderBy("rank").collect()] == [1, 2, 4]
    queries = spark.createDataFrame([(1, "boat rope")], "query_id bigint, query string")
    seen = hybrid.rerank(hits, queries, hybrid.overlap_score, limit=2, pool=4)
    assert [(r.id, r.score) for r in seen.orderBy("rank").collect()] == [(3, 1.0), (4, 1.0), (1, 0.0), (2, 0.0)]
    assert [r.rerank for r in hybrid.overlap_rerank(hits, queries).orderBy("id").collect()] == [0.0, 0.0, 1.0, 1.0, 1.0]
    kept, rejected = hybrid.apply_floor(seen, 0.5)
    assert kept.count() == 2 and rejected.count() == 0 and hybrid.apply_floor(seen, 2.0)[1].first().best_rejected == 1.0
    assert hybrid.overlap_score(pd.Series([None]), pd.Series([None])).tolist() == [0.0]


def test_quantiles_are_the_exclusive_ones(spark):
    rng = random.Random(1)
    data = {g: [rng.choice([1.0, 2.5, rng.random()]) for _ in range(n)] for g, n in (("a", 40), ("b", 2), ("c", 1), ("d", 9))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v double")
    for r in evaluate.score_quantiles(df, "v", "g").collect():
        v = data[r.g]
        assert (r.n, r.low, r.high) == (len(v), min(v), max(v)) and abs(r.median - statistics.median(v)) < 1e-6
        assert r.p10 is None if len(v) < 2 else abs(r.p10 - statistics.quantiles(v, n=10)[0]) < 1e-6
    for r in evaluate.latency_stats(df, "v", "g").collect():
        assert r.p95_ms == sorted(data[r.g])[int(0.95 * (len(data[r.g]) - 1))]


def test_filters(spark):
    df = spark.createDataFrame([("a/x.md",), ("a0/x.md",), ("a/b/c.tmp.md",), (".h/x.md",), ("lib/deep/Livro_1.md",), ("b/index.md",)], "p string")
    p = F.col("p")

    def which(cond):
        return {r.p for r in df.where(cond).collect()}

    assert which(filters.in_folder(p, " /a/ ")) == {"a/x.md", "a/b/c.tmp.md"} == which(filters.under_prefix(p, "a"))
    assert which(filters.is_ignored(p, ["a/"])) == {"a/x.md", "a/b/c.tmp.md"} and which(filters.is_ignored(p, ["*.tmp.md"])) == {"a/b/c.tmp.md"}
    assert which(filters.is_ignored(p, ["lib/**/Livro_*.md"])) == {"lib/deep/Livro_1.md"} and which(filters.is_hidden(p)) == {".h/x.md"} and which(filters.is_hub_name(p)) == {"b/index.md"}
    r = df.select(filters.skip_reason(p, F.lit(3000), F.lit("No"), ["b/"], 2048).alias("r"), "p").collect()
    assert {x.r for x in r} == {"ignored", "too large (2 KB > 2 KB)"}
    assert df.select(filters.skip_reason(p, F.lit(3), F.lit("No"), [], 2048)).first()[0] == "index: false"
    assert filters.folder_bounds("") is None
