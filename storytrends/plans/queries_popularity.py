"""Popularity of topics by month, and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import popularity as pop
from ..operators import trends as tr
from ..operators.explore import monthly_totals
from ..session import cut_lineage
from .registry import MONTH, on_stories, query
from .views import article_topics, register_views, stories

_COUNTS = f""", counts AS (
  SELECT topic, {MONTH} AS month, count(*) AS articles, CAST(sum(points) AS BIGINT) AS points,
         CAST(sum(num_comments) AS BIGINT) AS comments
  FROM stories GROUP BY ALL)"""
_SHARES = f"""{_COUNTS}, totals AS (
  SELECT {MONTH} AS month, count(*) AS a, sum(points) AS p, sum(num_comments) AS c
  FROM stories GROUP BY 1),
shares AS (
  SELECT topic, month, articles, points, comments,
         CAST(articles AS DOUBLE) / CAST(a AS DOUBLE) AS articles_share,
         coalesce(CAST(points AS DOUBLE) / nullif(CAST(p AS DOUBLE), 0), 0) AS points_share,
         coalesce(CAST(comments AS DOUBLE) / nullif(CAST(c AS DOUBLE), 0), 0) AS comments_share
  FROM counts JOIN totals USING (month)),
popularity AS (SELECT *, (articles_share + points_share + comments_share) / 3 AS score FROM shares)"""
_DENSE = f"""{_SHARES}, span AS (
  SELECT min(created_at) AS lo, max(created_at) AS hi FROM stories),
months AS (
  SELECT strftime(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi),
                                         INTERVAL 1 MONTH)), '%Y-%m') AS month FROM span),
dense AS (
  SELECT t.topic, m.month, coalesce(articles, 0) AS articles, coalesce(points, 0) AS points,
         coalesce(comments, 0) AS comments, coalesce(articles_share, 0) AS articles_share,
         coalesce(points_share, 0) AS points_share, coalesce(comments_share, 0) AS comments_share,
         coalesce(score, 0) AS score
  FROM (SELECT DISTINCT topic FROM counts) t CROSS JOIN months m
  LEFT JOIN popularity p ON p.topic = t.topic AND p.month = m.month)"""


def _popularity(spark, root):
    return pop.topic_popularity(stories(spark, root, topic=True))


def _dense(spark, root):
    return pop.topic_month_dense(_popularity(spark, root))


@query("topic_month_counts", on_stories(f"{_COUNTS} SELECT * FROM counts"))
def topic_month_counts(spark, root):
    return pop.topic_month_counts(stories(spark, root, topic=True))


@query("topic_month_shares", on_stories(f"{_SHARES} SELECT * FROM shares"))
def topic_month_shares(spark, root):
    return pop.topic_month_shares(pop.topic_month_counts(stories(spark, root, topic=True)))


@query("topic_popularity", on_stories(f"{_SHARES} SELECT * FROM popularity"))
def topic_popularity(spark, root):
    return _popularity(spark, root)


_MULTI = f""", lines AS (
  SELECT l_orderkey AS id, s_nationkey AS topic, sum(l_quantity) AS w
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
dist AS (SELECT id, topic, w / sum(w) OVER (PARTITION BY id) AS probability FROM lines),
totals AS (
  SELECT {MONTH} AS month, count(*) AS a, sum(points) AS p, sum(num_comments) AS c
  FROM stories GROUP BY 1),
counts AS (
  SELECT d.topic, {MONTH} AS month, sum({{0}}) AS articles, sum({{0}} * points) AS points,
         sum({{0}} * num_comments) AS comments
  FROM stories JOIN dist d ON d.id = story_id GROUP BY ALL)
SELECT topic, month, round(articles, 6) AS articles, round(points, 6) AS points,
       round(comments, 6) AS comments, round((articles / a + points / p + comments / c) / 3, 9) AS score
FROM counts JOIN totals USING (month)"""


def _multi(spark, root, weighted):
    facts = stories(spark, root)
    topics = article_topics(spark, root).withColumnRenamed("id", "story_id")
    found = pop.topic_popularity(facts, topics, monthly_totals(facts), weighted)
    counts = (F.round(F.col(c).cast("double"), 6).alias(c) for c in pop.COUNTS)
    return found.select("topic", "month", *counts, F.round("score", 9).alias("score"))


@query("topic_popularity_multi", on_stories(_MULTI.format("1.0::DOUBLE")))
def topic_popularity_multi(spark, root):
    return _multi(spark, root, weighted=False)


@query("topic_popularity_weighted", on_stories(_MULTI.format("probability")))
def topic_popularity_weighted(spark, root):
    return _multi(spark, root, weighted=True)


@query("topic_month_dense", on_stories(f"{_DENSE} SELECT * FROM dense"))
def topic_month_dense(spark, root):
    return _dense(spark, root)


@query(
    "topic_series_arrays",
    on_stories(
        f"""{_DENSE} SELECT topic, CAST(to_json({{'articles': list(articles ORDER BY month),
              'points': list(points ORDER BY month), 'comments': list(comments ORDER BY month)}}) AS VARCHAR)
              AS series FROM dense GROUP BY topic"""
    ),
)
def topic_series_arrays(spark, root):
    arrays = pop.topic_series_arrays(_dense(spark, root))
    return arrays.select("topic", F.to_json(F.struct(*pop.COUNTS)).alias("series"))


@query(
    "popularity_hist",
    on_stories(
        f"{_DENSE} SELECT CAST(least(floor(score / 0.001::DOUBLE), 10) AS INTEGER) AS bucket, "
        "count(*) AS cells FROM dense GROUP BY 1"
    ),
)
def popularity_hist(spark, root):
    return pop.popularity_hist(_dense(spark, root))


@query(
    "popularity_summary",
    on_stories(
        f"{_DENSE} SELECT count(*) AS cells, round(avg(score), 9) AS average, "
        "avg(CASE WHEN score < 0.0001::DOUBLE THEN 1 ELSE 0 END) AS below FROM dense"
    ),
)
def popularity_summary(spark, root):
    return pop.popularity_summary(_dense(spark, root))


@query(
    "topic_series",
    on_stories(f"{_DENSE} SELECT month, articles, points, comments FROM dense WHERE topic = 7"),
)
def topic_series(spark, root):
    return pop.topic_series(_dense(spark, root), 7)


_PEAKS = f"""{_SHARES}, peaks AS (
  SELECT topic, month, score FROM popularity
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, month) = 1)"""


@query("topic_peak_month", on_stories(f"{_PEAKS} SELECT * FROM peaks"))
def topic_peak_month(spark, root):
    return tr.topic_peak_month(_popularity(spark, root))


@query(
    "spike_stories",
    on_stories(
        f"""{_PEAKS}, ranked AS (
          SELECT s.topic, p.month, s.story_id, s.points,
                 row_number() OVER (PARTITION BY s.topic ORDER BY s.points DESC, s.story_id) AS rank
          FROM stories s JOIN peaks p ON p.topic = s.topic AND p.month = {MONTH})
        SELECT topic, month, CAST(rank AS INTEGER) AS rank, story_id, points FROM ranked WHERE rank <= 5"""
    ),
)
def spike_stories(spark, root):
    # The written peaks are one row per topic, small enough for Spark to see by their size.
    peaks = cut_lineage(tr.topic_peak_month(_popularity(spark, root)), "peaks")
    return tr.spike_stories(peaks, stories(spark, root, comments=False, topic=True), 5)


_FACTOR = 1.3
_SPIKES = f"""{_DENSE}, means AS (
  SELECT *, avg(score) OVER (PARTITION BY topic) AS mean_score FROM dense),
spikes AS (
  SELECT topic, month, score, mean_score FROM means WHERE score > 0 AND score >= {_FACTOR} * mean_score)"""


@query(
    "spike_months",
    on_stories(
        f"{_SPIKES} SELECT topic, month, round(score, 9) AS score, round(mean_score, 9) AS mean_score FROM spikes"
    ),
)
def spike_months(spark, root):
    spikes = tr.spike_months(_dense(spark, root), _FACTOR)
    rounded = (F.round(c, 9).alias(c) for c in ("score", "mean_score"))
    return spikes.select("topic", "month", *rounded)


@query(
    "trend_kind",
    on_stories(
        f"""{_SPIKES}, marks AS (
          SELECT topic, month[6:7] AS calendar,
                 CAST(month[1:4] AS INTEGER) * 12 + CAST(month[6:7] AS INTEGER) AS pos FROM spikes),
        islands AS (
          SELECT *, pos - row_number() OVER (PARTITION BY topic ORDER BY pos) AS island FROM marks),
        runs AS (SELECT topic, max(n) AS run FROM (
          SELECT topic, island, count(*) AS n FROM islands GROUP BY ALL) GROUP BY 1),
        years AS (SELECT topic, max(n) AS years FROM (
          SELECT topic, calendar, count(*) AS n FROM marks GROUP BY ALL) GROUP BY 1),
        totals2 AS (SELECT topic, count(*) AS spikes FROM marks GROUP BY 1)
        SELECT t.topic, coalesce(spikes, 0) AS spikes, coalesce(run, 0) AS run, coalesce(years, 0) AS years,
               CASE WHEN run >= 3 THEN 'long-lasting' WHEN years >= 2 THEN 'recurring'
                    WHEN spikes > 0 THEN 'single' ELSE 'none' END AS kind
        FROM (SELECT DISTINCT topic FROM dense) t LEFT JOIN runs USING (topic)
        LEFT JOIN years USING (topic) LEFT JOIN totals2 USING (topic)"""
    ),
)
def trend_kind(spark, root):
    return tr.trend_kind(_dense(spark, root), _FACTOR)


_AD_HOC = """SELECT p.topic, count(*) AS months, max(p.articles) AS most_articles,
  CAST(sum(t.articles) AS BIGINT) AS stories_seen
FROM popularity p JOIN totals t ON p.month = t.month GROUP BY p.topic"""


@query(
    "sql_views",
    on_stories(
        f"""{_SHARES}, named AS (SELECT month, a AS articles FROM totals)
        {_AD_HOC.replace('JOIN totals t', 'JOIN named t')}"""
    ),
)
def sql_views(spark, root):
    facts = stories(spark, root, topic=True)
    views = {"stories": facts, "popularity": pop.topic_popularity(facts), "totals": monthly_totals(facts)}
    register_views(spark, views)
    return spark.sql(_AD_HOC)
