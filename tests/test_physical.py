"""Plans are the ones we want: filters and columns reach the scan, limits lie below shuffles, nothing is a cartesian product."""

import os

import pytest
from pyspark.sql import functions as F

from inkgrove.operators import filters, keyword
from inkgrove.operators.current import current_notes
from inkgrove.operators.hot import hot_join
from inkgrove.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_folder_range_is_pushed_down(spark):
    p = plan(registry.queries()["folder_range"](spark, FOLDER))
    assert "GreaterThanOrEqual(rel_path,journal/2024/)" in p and "LessThan(rel_path,journal/20240)" in p and "text:string" not in p


def test_columns_are_pruned(spark):
    p = plan(registry.queries()["orphan_notes"](spark, FOLDER))
    assert "alias:string" not in p and "summary:string" not in p
    p = plan(registry.queries()["p2_found"](spark, FOLDER))
    assert "chunk_text:string" not in p and "LeftSemi" in p and "ArrowEvalPython" not in p


def test_hot_keys_are_dealt_out_and_no_row_is_lost(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, "hot").when(F.col("id") < 1900, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.col("id").alias("row"))
    right = spark.createDataFrame([("hot", 1), ("k3", 2), (None, 3)], "key string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = hot_join(left, right, ["key"], how, rows=100)
        assert "_salt" in plan(got) and "_salt" not in got.columns
        assert got.exceptAll(left.join(right, ["key"], how)).count() == 0 and got.count() == left.join(right, ["key"], how).count()
    assert "_salt" not in plan(hot_join(left, right, ["key"], "left"))


@pytest.mark.parametrize("name", ["p2_found", "p2_report", "resolve_links", "backlinks", "current", "read_page"])
def test_no_rows_leave_the_jvm(spark, name):
    if name == "current":
        p = plan(current_notes(spark.read.parquet(f"{FOLDER}/notes.parquet")))
    else:
        p = plan(registry.queries()[name](spark, FOLDER))
    assert "Python" not in p
    if name == "read_page":
        assert "Exchange" not in p


def test_few_documents_are_parsed_for_a_listing(spark):
    p = plan(registry.queries()["list_documents"](spark, FOLDER))
    assert p.count("MapInPandas") == 1 and "LeftSemi" in p


def test_limits_lie_below_the_shuffle(spark):
    scores = spark.range(1000).select((F.col("id") % 5).alias("query_id"), "id", F.rand(1).alias("score"))
    assert "WindowGroupLimit" in plan(keyword.top_per_query(scores, 3))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    p = plan(filters.recent(docs, folder="journal"))
    assert "TakeOrderedAndProject" in p and "StringStartsWith(rel_path,journal/)" in p


def test_semi_join_for_note_filters(spark):
    assert "LeftSemi" in plan(registry.queries()["chunks_of_notes"](spark, FOLDER))


@pytest.mark.parametrize("name", ["resolve_links", "backlinks", "without_hub", "change_diff", "freshness", "health_counts", "phrase_match", "p2_report", "score_quantiles"])
def test_no_products(spark, name):
    p = plan(registry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
