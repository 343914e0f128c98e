"""Totals, histograms and rankings of stories.

Stories have the columns ``story_id, created_at, author, points, num_comments`` and,
for domains, ``url``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.web import host
from .rows import with_computed

MEASURES = ("stories", "points", "comments")


def month_of(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def by_month(df: DataFrame, ts: str, *keys: str) -> GroupedData:
    """Group by ``keys`` and ``month``, the first day of the month of ``ts``.

    Months stay dates until the rows are aggregated; ``named_month`` spells them out.
    """
    return df.groupBy(*keys, F.trunc(ts, "month").alias("month"))


def named_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", month_of("month"))


def _measures() -> list[Column]:
    return [
        F.count("*").alias("stories"),
        F.sum("points").alias("points"),
        F.sum("num_comments").alias("comments"),
    ]


def overall_totals(stories: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return stories.agg(
        F.count("*").alias("stories"),
        distinct("author").alias("submitters"),
        F.sum("points").alias("upvotes"),
        F.sum("num_comments").alias("comments"),
    )


def monthly_totals(stories: DataFrame) -> DataFrame:
    """``month, articles, points, comments, partial``; ``partial`` marks a last month
    whose last story comes before its last day."""
    months = by_month(stories, "created_at").agg(
        F.count("*").alias("articles"),
        F.sum("points").alias("points"),
        F.sum("num_comments").alias("comments"),
        F.to_date(F.max("created_at")).alias("_last"),
    )
    # One row per month is left here, so a single window over all of them is small.
    newest = F.max("month").over(Window.partitionBy())
    partial = (F.col("month") == newest) & (F.col("_last") < F.last_day("_last"))
    return months.select(
        month_of("month").alias("month"), "articles", "points", "comments", partial.alias("partial")
    )


def month_range(df: DataFrame, first: Column, last: Column, name: str = "month") -> DataFrame:
    """Every row of ``df`` once for each month from ``first`` to ``last`` (dates)."""
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return df.withColumn(name, F.explode(F.transform(months, lambda m: month_of(m))))


def month_calendar(
    spark: SparkSession, first: str = "2007-02", last: str = "2015-06"
) -> DataFrame:
    """The months from ``first`` to ``last``, both ``yyyy-MM``."""
    bounds = (F.lit(f"{m}-01").cast("date") for m in (first, last))
    return month_range(spark.range(1), *bounds).select("month")


def months_covered(stories: DataFrame) -> DataFrame:
    """``month, articles`` for every month between the first and the last story."""
    counted = named_month(by_month(stories, "created_at").agg(F.count("*").alias("articles")))
    day = F.to_date(F.concat("month", F.lit("-01")))
    span = counted.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    months = month_range(span, F.col("first"), F.col("last")).select("month")
    return months.join(counted, "month", "left").select(
        "month", F.coalesce("articles", F.lit(0)).alias("articles")
    )


# Registers of a sketch are 2 to this power; the relative standard error is about 0.8 %.
SKETCH_BITS = 14


def submitter_sketches(stories: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """``day, stories, sketch``: a sketch of the distinct submitters of each day, to be stored.

    New days are added without reading the old ones. Stories without an author count as
    stories only.
    """
    day = F.to_date("created_at").alias("day")
    return stories.groupBy(day).agg(F.count("*").alias("stories"), F.hll_sketch_agg("author", bits).alias("sketch"))


def merged_submitters(sketches: DataFrame, key: Column | None = None) -> DataFrame:
    """``month, stories, submitters`` of all days, or of the groups of ``key``, from stored sketches alone."""
    grouped = sketches.groupBy((F.lit("all") if key is None else key).alias("month"))
    merged = grouped.agg(F.sum("stories").alias("stories"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("month", "stories", F.hll_sketch_estimate("sketch").alias("submitters"))


def submitters_by_month(sketches: DataFrame) -> DataFrame:
    return merged_submitters(sketches, month_of("day"))


def days_without_stories(stories: DataFrame) -> DataFrame:
    days = stories.select(F.to_date("created_at").alias("day")).distinct()
    span = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    every = span.select(F.explode(F.sequence("first", "last")).alias("day"))
    return every.join(days, "day", "left_anti")


def upvote_hist(stories: DataFrame, width: int = 100, max_points: int | None = None) -> DataFrame:
    """``bucket, n``; ``bucket`` is the lower end of a range of ``width`` points."""
    if max_points is not None:
        stories = stories.filter(F.col("points") <= max_points)
    bucket = (F.floor(F.col("points") / width) * width).cast("bigint")
    return stories.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def upvote_share(stories: DataFrame, width: int = 100) -> DataFrame:
    """Share of stories in the first bucket and share above it."""
    return stories.agg(
        F.avg((F.col("points") < width).cast("int")).alias("first_bucket"),
        F.avg((F.col("points") > width).cast("int")).alias("above"),
    )


def top_stories(stories: DataFrame, min_points: int = 2100, n: int | None = None) -> DataFrame:
    best = stories.filter(F.col("points") > min_points).orderBy(F.desc("points"), "story_id")
    return best if n is None else best.limit(n)


def group_measures(stories: DataFrame, key: str | Column) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return stories.groupBy(key).agg(*_measures())


def top_n(df: DataFrame, key: str, measure: str, n: int = 10) -> DataFrame:
    """The ``n`` rows of greatest ``measure``; ties by ``key``."""
    return df.orderBy(F.desc(measure), key).limit(n)


def top_submitters(stories: DataFrame, measure: str = "stories", n: int = 10) -> DataFrame:
    return top_n(group_measures(stories, "author"), "author", measure, n)


def top_submitters_rate(stories: DataFrame, n: int = 10) -> DataFrame:
    """Stories of the top submitters together, and per submitter and day."""
    days = stories.agg(
        (F.datediff(F.max("created_at"), F.min("created_at")) + 1).alias("days")
    ).scalar()
    top = top_n(stories.groupBy("author").agg(F.count("*").alias("stories")), "author", "stories", n)
    return top.agg(
        F.count("*").alias("submitters"), F.sum("stories").alias("stories")
    ).select(
        "submitters", "stories", (F.col("stories") / F.col("submitters") / days).alias("per_day")
    )


def domain_measures(stories: DataFrame, url: str = "url") -> DataFrame:
    """``domain`` with its measures; stories without a host are left out."""
    named = with_computed(stories, "domain", host(F.col(url)))
    return group_measures(named.filter(F.col("domain").isNotNull()), "domain")


def top_domains(stories: DataFrame, measure: str = "stories", n: int = 10) -> DataFrame:
    return top_n(domain_measures(stories), "domain", measure, n)


def domain_rank_table(stories: DataFrame, n: int = 10) -> DataFrame:
    """The rankings by stories, points and comments side by side, one row per rank.

    All three come from one aggregate: each domain is turned into one row per measure,
    every task keeps only its best ``n`` per measure, and the ranks are pivoted.
    """
    tall = domain_measures(stories).unpivot("domain", list(MEASURES), "measure", "value")
    order = Window.partitionBy("measure").orderBy(F.desc("value"), "domain")
    ranked = tall.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    columns = []
    for m in MEASURES:
        mine = F.col("measure") == m
        columns.append(F.max(F.when(mine, F.col("domain"))).alias(f"domain_by_{m}"))
        columns.append(F.max(F.when(mine, F.col("value"))).alias(m))
    return ranked.groupBy("rank").agg(*columns)


def measure_correlation(grouped: DataFrame) -> DataFrame:
    """Correlations between the measures over the groups."""
    pairs = (("stories", "points"), ("stories", "comments"), ("points", "comments"))
    return grouped.agg(
        F.count("*").alias("groups"),
        *(F.round(F.corr(a, b), 6).alias(f"{a}_{b}") for a, b in pairs),
    )
