"""The two JSON documents of the trend page: scores by month and words by topic.

Both find a topic by its position, so ids without data get an empty entry. They hold
one value per topic and month, or a few words per topic, and so are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.popularity import COUNTS, topic_series_arrays
from ..operators.topics import topic_keywords


def _by_position(rows: DataFrame, entry: Column, empty: Column) -> DataFrame:
    """``entries``: the entry of each topic from 0 to the last one, in order."""
    found = rows.agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("topic").cast("int"), entry))).alias("m"),
        F.max(F.col("topic").cast("int")).alias("last"),
    )
    positions = F.sequence(F.lit(0), F.col("last"))
    entries = F.transform(positions, lambda i: F.coalesce(F.col("m")[i], empty))
    return found.select(entries.alias("entries"))


def scores_json(totals: DataFrame, dense: DataFrame) -> DataFrame:
    """One row ``value``: ``totals`` by month and ``topicseries`` by topic."""
    months = F.array_sort(F.collect_list(F.struct(F.col("month").alias("date"), *COUNTS)))
    zeros = F.struct(*(F.array().cast("array<bigint>").alias(c) for c in COUNTS))
    series = _by_position(topic_series_arrays(dense), F.struct(*COUNTS), zeros)
    listed = totals.agg(months.alias("totals")).scalar().alias("totals")
    document = F.to_json(F.struct(listed, F.col("entries").alias("topicseries")))
    return series.select(document.alias("value"))


def keywords_json(words: DataFrame, n: int = 10) -> DataFrame:
    """One row ``value``: an array of ``w, s`` entries per topic."""
    none = F.array().cast("array<struct<w:string,s:double>>")
    entries = _by_position(topic_keywords(words, n), F.col("kw"), none)
    return entries.select(F.to_json("entries").alias("value"))
