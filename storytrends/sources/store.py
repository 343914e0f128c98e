"""A store of stories in Parquet, one folder per year and month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_months(stories: DataFrame, path: str, ts: str | Column = "HNItem.created_at") -> None:
    """Write ``stories`` below ``path``; months that they hold are replaced, all others stay.

    Rows are dealt by month with their sizes balanced at run time, so a large month becomes
    several files and small ones do not leave many. Stories without a time are a month of
    their own. The columns ``year`` and ``month`` are added and must not be there.
    """
    when = F.col(ts) if isinstance(ts, str) else ts
    keyed = stories.withColumns({"year": F.year(when), "month": F.month(when)}).hint("rebalance", F.col("year"), F.col("month"))
    writer = keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("year", "month").parquet(path)


def read_months(spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Stories of the months of ``first`` to ``last``, both included; other folders are not listed for reading."""
    df = spark.read.parquet(path)
    year, month = F.col("year"), F.col("month")
    if first:
        df = df.filter((year > first.year) | ((year == first.year) & (month >= first.month)))
    if last:
        df = df.filter((year < last.year) | ((year == last.year) & (month <= last.month)))
    return df
