"""Every registered query against its SQL, at the smallest scale, and properties of the plans."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference
from threadloom.registry.core import CASES, run

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name in entry.oracle_sql():
        assert difference(df, duck, entry.oracle_sql()[name]) is None
    else:
        assert df.columns


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "share_of_voice" in df.columns


def plan(spark, name):
    return run(name, spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in CASES if n.split("_")[0] in ("agg", "win", "join", "conv", "ml", "prj", "qc")])
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned(spark):
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan(spark, "fn_23_week_start")


def test_topk_cuts_groups_before_the_shuffle(spark):
    text = plan(spark, "run_02_last_runs")
    assert "WindowGroupLimit" in text and "Partial" in text


def test_texts_are_cleaned_once(spark):
    text = plan(spark, "agg_01_brand_daily")
    assert text.count("https?://") == 1


def test_lexicon_runs_in_the_jvm(spark):
    assert "Python" not in plan(spark, "ml_01_lexicon_sentiment")
    assert plan(spark, "ml_01_pandas_sentiment").count("ArrowEvalPython") == 1


def test_author_influence_reads_the_posts_once(spark):
    assert plan(spark, "agg_16_author_influence").count("documents.parquet") == 1


def test_author_dimension_needs_one_shuffle_after_dedup(spark):
    assert plan(spark, "agg_04_dim_authors").count("Exchange hashpartitioning(author_id") == 1
