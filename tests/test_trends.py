from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from storytrends.operators import explore as ex
from storytrends.operators import popularity as pop
from storytrends.operators import trends as tr
from storytrends.plans.views import stories

ROWS = [
    (1, "2014-11-03", "a", 10, 0, 0), (2, "2014-11-20", "b", 30, 0, 1), (3, "2015-01-02", "a", 0, 5, 0),
    (4, "2015-01-15", "c", 0, 5, None), (5, "2015-02-10", "a", 7, 1, 1),
]


@pytest.fixture(scope="module")
def few(spark):
    schema = "story_id int, day string, author string, points int, num_comments int, topic int"
    return spark.createDataFrame(ROWS, schema).withColumn("created_at", F.col("day").cast("timestamp"))


def test_month_calendar(spark):
    months = [r.month for r in ex.month_calendar(spark).orderBy("month").collect()]
    assert len(months) == 101 and months[0] == "2007-02" and months[-1] == "2015-06"


def test_partial_last_month(few):
    flags = {r.month: r.partial for r in ex.monthly_totals(few).collect()}
    assert flags == {"2014-11": False, "2015-01": False, "2015-02": True}


def test_shares_with_empty_totals_and_stories_without_topic(few):
    rows = {(r.topic, r.month): r for r in pop.topic_popularity(few).collect()}
    assert set(rows) == {(0, "2014-11"), (1, "2014-11"), (0, "2015-01"), (1, "2015-02")}
    november = rows[0, "2014-11"]
    assert (november.articles_share, november.points_share, november.comments_share) == (0.5, 0.25, 0.0)
    assert november.score == pytest.approx(0.25)
    # The story without a topic counts in the month's totals; nobody got points.
    january = rows[0, "2015-01"]
    assert (january.articles_share, january.points_share, january.comments_share) == (0.5, 0.0, 0.5)


def test_totals_of_all_stories_give_the_same_shares(few):
    given = few.filter("topic IS NOT NULL").select("story_id", "topic")
    joined = pop.topic_popularity(few.drop("topic"), given, ex.monthly_totals(few))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, pop.topic_popularity(few).collect()))


def test_dense_grid_and_arrays(few):
    dense = pop.topic_month_dense(pop.topic_popularity(few))
    assert dense.count() == 2 * 4
    arrays = {r.topic: (r.articles, r.points, r.comments) for r in pop.topic_series_arrays(dense).collect()}
    assert arrays == {0: ([1, 0, 1, 0], [10, 0, 0, 0], [0, 0, 5, 0]), 1: ([1, 0, 0, 1], [30, 0, 0, 7], [0, 0, 0, 1])}
    assert pop.topic_series(dense, 1000).count() == 0
    with pytest.raises(ValueError):
        pop.topic_series(dense, 1000, 1000)


def test_dense_grid_of_all_months_without_one_task(few):
    found = pop.topic_popularity(few)
    months = ex.monthly_totals(few).select("month").unionByName(few.sparkSession.createDataFrame([("2014-11",), ("2015-12",)], "month string"))
    dense = pop.topic_month_dense(found, months)
    assert dense.agg(F.min("month"), F.max("month")).first()[:] == ("2014-11", "2015-12")
    assert dense.count() == 2 * 14


def test_scores_of_a_month_add_up_to_one(spark, tables):
    found = pop.topic_popularity(stories(spark, tables, topic=True))
    sums = found.groupBy("month").agg(F.sum("score").alias("s")).collect()
    assert sums and all(abs(r.s - 1) < 1e-9 for r in sums)


def test_weighted_counts(few):
    given = [(1, 0, 0.75), (1, 1, 0.25), (2, 1, 1.0)]
    topics = few.sparkSession.createDataFrame(given, "story_id int, topic int, probability double")
    counts = {r.topic: (r.articles, r.points) for r in pop.topic_month_counts(few, topics, weighted=True).collect()}
    assert counts == {0: (0.75, 7.5), 1: (1.25, 32.5)}


def scores(spark, topics):
    months = [f"{y}-{m:02d}" for y in (2012, 2013) for m in range(1, 13)]
    rows = [(t, m, spikes.get(m, 0.01)) for t, spikes in topics.items() for m in months]
    return spark.createDataFrame(rows, "topic int, month string, score double")


def test_trend_kinds(spark):
    dense = scores(
        spark,
        {
            0: {"2012-10": 0.5},
            1: {"2012-06": 0.3, "2013-06": 0.3},
            2: {"2012-11": 0.2, "2012-12": 0.2, "2013-01": 0.2},
            3: {},
        },
    )
    rows = {r.topic: (r.spikes, r.run, r.years, r.kind) for r in tr.trend_kind(dense, 2.0).collect()}
    assert rows == {0: (1, 1, 1, "single"), 1: (2, 1, 2, "recurring"), 2: (3, 3, 1, "long-lasting"), 3: (0, 0, 0, "none")}


def test_peak_ties_and_spike_stories(spark, few):
    dense = scores(spark, {0: {"2012-03": 0.5, "2013-03": 0.5}})
    assert [(r.month, r.score) for r in tr.topic_peak_month(dense).collect()] == [("2012-03", 0.5)]
    peaks = tr.topic_peak_month(pop.topic_popularity(few))
    best = tr.spike_stories(peaks, few, 1).collect()
    assert {(r.topic, r.month, r.story_id) for r in best} == {(0, "2015-01", 3), (1, "2015-02", 5)}


def test_days_without_stories(few):
    found = ex.days_without_stories(few.filter("day >= '2015-01-01'"))
    assert found.count() == 40 - 3
