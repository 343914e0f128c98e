"""Monthly popularity of topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .explore import by_month, month_range, named_month

COUNTS = ("articles", "points", "comments")


def topic_month_counts(
    stories: DataFrame, topics: DataFrame | None = None, weighted: bool = False
) -> DataFrame:
    """``topic, month, articles, points, comments``.

    Stories carry their ``topic``, or ``topics`` gives ``story_id, topic`` and, to be
    ``weighted``, ``probability``. A story then counts once for each of its topics.
    """
    if topics is not None:
        stories = stories.drop("topic").join(topics, "story_id")
    weight = F.col("probability") if weighted else F.lit(1)
    counts = by_month(stories, "created_at", "topic").agg(
        F.sum(weight).alias("articles"),
        F.sum(F.col("points") * weight).alias("points"),
        F.sum(F.col("num_comments") * weight).alias("comments"),
    )
    return named_month(counts)


def topic_month_shares(counts: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Counts with their shares of the month; a share of an empty total is 0.

    ``totals`` gives ``month`` and the three measures of all stories. Without it each
    story has just one topic (null for none) and the totals are the sums over topics.
    """
    if totals is None:
        month = Window.partitionBy("month")
        for c in COUNTS:
            counts = counts.withColumn(f"_{c}", F.sum(c).over(month))
        counts = counts.filter(F.col("topic").isNotNull())
    else:
        totals = totals.select("month", *(F.col(c).alias(f"_{c}") for c in COUNTS))
        counts = counts.join(totals, "month")
    return counts.select("topic", "month", *COUNTS, *(_share(c) for c in COUNTS))


def _share(c: str) -> Column:
    ratio = F.col(c).cast("double") / F.nullif(F.col(f"_{c}"), F.lit(0)).cast("double")
    return F.coalesce(ratio, F.lit(0.0)).alias(f"{c}_share")


def with_score(shares: DataFrame) -> DataFrame:
    """The score of a topic in a month: the mean of its three shares."""
    a, p, c = (F.col(f"{x}_share") for x in COUNTS)
    return shares.withColumn("score", (a + p + c) / 3)


def topic_popularity(
    stories: DataFrame,
    topics: DataFrame | None = None,
    totals: DataFrame | None = None,
    weighted: bool = False,
) -> DataFrame:
    """Counts, shares and score of each topic and month with stories."""
    counts = topic_month_counts(stories, topics, weighted)
    return with_score(topic_month_shares(counts, totals))


def calendar(months: DataFrame) -> DataFrame:
    """``month``: every month from the first to the last one of ``months``."""
    day = F.to_date(F.concat("month", F.lit("-01")))
    return month_range(months.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi")), F.col("_lo"), F.col("_hi")).select("month")


def topic_month_dense(popularity: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """The popularity of every topic in every month, zeros where it has no story.

    The months span those of ``months`` (a ``month`` column), by default those with a
    story of any topic. The months of a topic, at most one row each, become a map that the
    calendar, one short list of all months, looks its values up in.
    """
    if months is None:
        popularity = months = cut_lineage(popularity, "popularity")  # read for the cells and for the span
    values = [c for c in popularity.columns if c not in ("topic", "month")]
    cell = F.struct("month", F.struct(*values))
    topics = popularity.groupBy("topic").agg(F.map_from_entries(F.collect_list(cell)).alias("_cells"))
    span = calendar(months).agg(F.array_sort(F.collect_list("month")))
    grid = topics.withColumn("_months", span.scalar()).select("topic", "_cells", F.explode("_months").alias("month"))
    cells = grid.select("topic", "month", F.col("_cells")[F.col("month")].alias("_cell"))
    filled = (F.coalesce(F.col(f"_cell.{c}"), F.lit(0)).alias(c) for c in values)
    return cells.select("topic", "month", *filled)


def topic_series_arrays(dense: DataFrame) -> DataFrame:
    """``topic`` with arrays of articles, points and comments in month order."""
    months = F.array_sort(F.collect_list(F.struct("month", *COUNTS)))
    arrays = dense.groupBy("topic").agg(months.alias("months"))
    return arrays.select("topic", *(F.col(f"months.{c}").alias(c) for c in COUNTS))


def popularity_hist(dense: DataFrame, step: float = 0.001, buckets: int = 10) -> DataFrame:
    """Cells by score in steps of ``step``; the last bucket is open upwards."""
    bucket = F.least(F.floor(F.col("score") / step), F.lit(buckets))
    return dense.groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("cells"))


def popularity_summary(dense: DataFrame, low: float = 0.0001) -> DataFrame:
    """Mean score over all cells and share of cells below one basis point."""
    return dense.agg(
        F.count("*").alias("cells"),
        F.round(F.avg("score"), 9).alias("average"),
        F.avg((F.col("score") < low).cast("int")).alias("below"),
    )


def topic_series(dense: DataFrame, topic: int, topics: int | None = None) -> DataFrame:
    """The months of one topic; unknown ones have none. ``topics`` bounds the number if given."""
    if topic < 0 or topics is not None and topic >= topics:
        raise ValueError(f"topic must be in 0..{'' if topics is None else topics - 1}")
    return dense.filter(F.col("topic") == topic).select("month", *COUNTS)
