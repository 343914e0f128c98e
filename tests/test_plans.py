"""Shapes of physical plans that matter at scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver


def plan(spark, tables, name) -> str:
    df = driver.queries()[name](spark, tables)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_no_query_crosses_tables(spark, tables, name):
    text = plan(spark, tables, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_time_ranges_reach_the_scan(spark, tables):
    for name, column in (("stories_in_period", "o_orderdate"), ("day_window", "ts")):
        text = plan(spark, tables, name)
        assert f"GreaterThanOrEqual({column}," in text and f"LessThan({column}," in text


def test_scans_read_only_their_columns(spark, tables):
    text = plan(spark, tables, "top_domains_stories")
    assert "html" not in text
    assert "ReadSchema: struct<l_orderkey:bigint>" in text
    assert "l_orderkey" not in plan(spark, tables, "upvote_hist_100")


def test_rankings_keep_only_the_best_rows_per_task(spark, tables):
    for name in ("domain_rank_table", "spike_stories", "topic_strings", "cluster_keywords"):
        assert "WindowGroupLimit" in plan(spark, tables, name), name
    assert "TakeOrderedAndProject" in plan(spark, tables, "top_submitters")


def test_text_is_tokenized_once(spark, tables):
    text = plan(spark, tables, "title_vectors")
    assert "Filter ((size(flatten" not in text
    assert "Filter ((size(filter" not in plan(spark, tables, "bag_of_words")


def test_topics_of_an_article_stay_in_its_row(spark, tables):
    text = plan(spark, tables, "lda_article_topics")
    # Blocks of texts meet their ids; nothing is shuffled behind the topic weights.
    assert "Window" not in text and "Exchange" not in text[: text.index("MapInArrow")]
