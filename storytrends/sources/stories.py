"""Story files by day, periods, and comment dumps."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import COMMENT_DUMP, ITEM


def period_glob(root: str, year: int | str | None = None, month: int | None = None) -> str:
    """Path pattern of the day files of a year (``2015`` or ``"200*"``) and month.

    Day files end in ``stories-<year>-<MonthName>-<day>``.
    """
    name = calendar.month_name[month] if month else "*"
    return f"{root.rstrip('/')}/*stories-{year or '*'}-{name}-*"


def _filled(name: str, schema: T.StructType) -> Column:
    """A struct without nulls: a missing text is empty, a missing number 0."""
    fields = []
    for field in schema.fields:
        value = F.col(f"{name}.{field.name}")
        if isinstance(field.dataType, T.StringType):
            value = F.coalesce(value, F.lit(""))
        elif isinstance(field.dataType, T.IntegerType):
            value = F.coalesce(value, F.lit(0))
        fields.append(value.alias(field.name))
    return F.struct(*fields).alias(name)


def file_day(path: Column) -> Column:
    """Day of a story file from its path, null if the path names none."""
    text = F.regexp_extract(path, r"stories-(\d{4}-[A-Z][a-z]+-\d{1,2})(?:/|$|\.)", 1)
    return F.to_date(F.nullif(text, F.lit("")), "yyyy-MMMM-d")


def read_stories(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """Stories of newline JSON files: ``webpage``, ``HNItem`` and ``file_day``.

    ``FAILFAST`` stops at a malformed line. ``PERMISSIVE`` keeps it as a story of
    empty values and puts the line in ``_corrupt_record``.
    """
    schema, extra = ITEM, []
    if mode.upper() == "PERMISSIVE":
        schema = T.StructType([*ITEM.fields, T.StructField("_corrupt_record", T.StringType())])
        extra = ["_corrupt_record"]
    raw = spark.read.schema(schema).option("mode", mode).json(path)
    day = file_day(F.col("_metadata.file_path")).alias("file_day")
    return raw.select(*(_filled(f.name, f.dataType) for f in ITEM.fields), day, *extra)


def in_period(df: DataFrame, ts: str, year: int, month: int | None = None) -> DataFrame:
    """Rows of a year or month, as a range on ``ts`` that reaches the scan."""
    first = dt.date(year, month or 1, 1)
    months = 1 if month else 12
    end = dt.date(year + (first.month + months > 12), (first.month + months - 1) % 12 + 1, 1)
    return df.filter(
        (F.col(ts) >= timestamp_like(df, ts, f"{first} 00:00:00"))
        & (F.col(ts) < timestamp_like(df, ts, f"{end} 00:00:00"))
    )


def timestamp_like(df: DataFrame, ts: str, text: str) -> Column:
    """A time literal of the type of ``ts``, so that the column itself is not cast."""
    return F.lit(text).cast(df.schema[ts].dataType)


def comment_rows(dump: DataFrame) -> DataFrame:
    return dump.select(F.explode("hits").alias("hit")).select("hit.comment_text")


def read_comments(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Single comments of a dump; one JSON document per line can be split over tasks."""
    dump = spark.read.schema(COMMENT_DUMP).option("multiLine", multi_line).json(path)
    return comment_rows(dump)


def read_split_comments(spark: SparkSession, path: str, first_key: str = "created_at") -> DataFrame:
    """Single comments of dumps of any size, also of one JSON document in one line or over many.

    A file is cut where a further hit begins, ``,{"<first_key>"``, which no text can hold
    since quotes are escaped there; so many tasks read one file. What a cut takes off a hit is
    put back, and what stands between two documents is left out. Hits must begin with
    ``first_key``, written without blanks around the brace; other dumps need ``read_comments``.
    """
    begin = f'{{"{first_key}"'
    cut = spark.read.option("lineSep", f",{begin}").text(path)
    # A piece goes on with a hit, and holds the first hits of the documents that begin in it.
    parts = cut.select(F.explode(F.split("value", re.escape(f"[{begin}"))).alias("part"))
    hits = parts.filter(F.col("part").rlike(r"^\s*:"))
    hit = COMMENT_DUMP["hits"].dataType.elementType
    parsed = F.from_json(F.concat(F.lit(begin), "part"), hit, {"mode": "FAILFAST"})
    return hits.select(parsed.alias("hit")).select("hit.comment_text")
