"""Peaks, spikes and kinds of trends of topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topic_peak_month(popularity: DataFrame) -> DataFrame:
    """``topic, month, score`` of the best month; the earliest of equal ones."""
    order = F.struct("score", F.negative(F.unix_date(F.to_date(F.concat("month", F.lit("-01"))))))
    return popularity.groupBy("topic").agg(
        F.max_by("month", order).alias("month"), F.max("score").alias("score")
    )


def spike_stories(peaks: DataFrame, stories: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` stories of most points in the peak month of their topic.

    Every task keeps its best ``n`` per topic before rows are exchanged.
    """
    posts = stories.withColumn("_first", F.trunc("created_at", "month"))
    first = F.to_date(F.concat("month", F.lit("-01"))).alias("_first")
    order = Window.partitionBy("topic").orderBy(F.desc("points"), "story_id")
    ranked = posts.join(peaks.select("topic", "month", first), ["topic", "_first"]).withColumn(
        "rank", F.row_number().over(order)
    )
    return ranked.filter(F.col("rank") <= n).select("topic", "month", "rank", "story_id", "points")


def spike_months(dense: DataFrame, factor: float = 2.0) -> DataFrame:
    """Months whose score is at least ``factor`` times the mean of the topic."""
    mean = F.avg("score").over(Window.partitionBy("topic"))
    spiked = dense.withColumn("mean_score", mean).filter(
        (F.col("score") > 0) & (F.col("score") >= factor * F.col("mean_score"))
    )
    return spiked.select("topic", "month", "score", "mean_score")


def trend_kind(
    dense: DataFrame, factor: float = 2.0, long_run: int = 3, recurring_years: int = 2
) -> DataFrame:
    """Kind of trend per topic, from its spike months.

    ``long-lasting``: ``long_run`` spike months in a row; else ``recurring``: the same
    calendar month spikes in ``recurring_years`` years; else ``single``; ``none``
    without a spike. The thresholds are our own.
    """
    # Months of a topic are few, so its spikes are judged in one list.
    at = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    mean = F.avg("score").over(Window.partitionBy("topic"))
    spike = (F.col("score") > 0) & (F.col("score") >= factor * mean)
    marked = dense.select("topic", F.when(spike, at).alias("at"))
    lists = marked.groupBy("topic").agg(F.array_sort(F.collect_list("at")).alias("at"))
    # A run of months has one difference between month and place; a calendar month one remainder.
    islands = F.transform("at", lambda x, i: x - i)
    months = F.transform("at", lambda x: x % 12)
    per_topic = lists.select("topic", F.size("at").cast("bigint").alias("spikes"), islands.alias("islands"), months.alias("months"))

    def most(values: str) -> Column:
        counts = F.transform(values, lambda x: F.size(F.filter(values, lambda y: y == x)))
        return F.coalesce(F.array_max(counts), F.lit(0)).cast("bigint")

    per_topic = per_topic.select("topic", "spikes", most("islands").alias("run"), most("months").alias("years"))
    kind = (
        F.when(F.col("run") >= long_run, "long-lasting")
        .when(F.col("years") >= recurring_years, "recurring")
        .when(F.col("spikes") > 0, "single")
        .otherwise("none")
    )
    return per_topic.select("topic", "spikes", "run", "years", kind.alias("kind"))
