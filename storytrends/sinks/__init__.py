"""Writers of the tables and files the jobs leave behind."""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words_to_text
from ..schema import JOB_INFO
from ..session import cut_lineage


def _write(df: DataFrame, path: str, format: str) -> None:
    """Write to a new folder; an existing one is an error."""
    df.write.mode("errorifexists").format(format).save(path)


def write_clustering(df: DataFrame, path: str, format: str = "parquet") -> None:
    _write(df, path, format)


def write_topics(df: DataFrame, path: str, format: str = "parquet") -> None:
    _write(df, path, format)


def write_job_info(spark: SparkSession, info: dict, path: str) -> None:
    _write(spark.createDataFrame([info], JOB_INFO), path, "json")


def write_lines(df: DataFrame, path: str) -> None:
    """Write the single text column of a report."""
    _write(df, path, "text")


def write_tokenized(df: DataFrame, path: str, format: str = "parquet") -> None:
    if format == "text":
        df = df.select(F.concat_ws(", ", F.col("id"), words_to_text(F.col("words"))))
    _write(df, path, format)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    """``word, vector``, written by the tasks that hold them; an older table gives way."""
    vectors.select("word", F.col("vector").cast("array<float>")).write.mode("overwrite").parquet(path)


def day_name(day: Column) -> Column:
    return F.concat(F.lit("stories-"), F.date_format(day, "yyyy-MMMM-d"))


def write_daily(
    stories: DataFrame,
    path: str,
    day: Column | None = None,
    order: Column | None = None,
    partitions: int | None = None,
) -> None:
    """Stories as newline JSON in one folder per day, in ``order`` within the day.

    By default the day and the order are those of ``HNItem.created_at``, then the id.

    Ranges over (day, order) keep the order and split a day too big for one task
    over several files. Their number is fixed, so that small ranges are not merged
    into one task that opens the files of all days in turn.
    """
    day = F.to_date("HNItem.created_at") if day is None else day
    order = F.struct("HNItem.created_at", "HNItem.objectID") if order is None else order
    partitions = partitions or int(stories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = stories.select("*", day.alias("_day"), order.alias("_order"), day_name(day).alias("file"))
    # Ranging samples its input first, so what it reads is written once.
    keyed = cut_lineage(keyed, "stories")
    # The writer needs rows in order of the folder; sorting by it first keeps the rest.
    (
        keyed.repartitionByRange(partitions, "_day", "_order")
        .sortWithinPartitions("file", "_order")
        .drop("_day", "_order")
        .write.mode("errorifexists")
        .partitionBy("file")
        .json(path)
    )


def article_export(stories: DataFrame) -> DataFrame:
    """The twelve columns of the relational ``articles`` table."""
    post, page = "HNItem", "webpage"
    return stories.select(
        F.col(f"{post}.created_at").alias("Date"),
        F.col(f"{page}.cleanedText").alias("Article"),
        F.col(f"{post}.author").alias("Author"),
        F.col(f"{post}.title").alias("Title"),
        F.col(f"{post}.points").alias("Points"),
        F.col(f"{post}.url").alias("Url"),
        F.col(f"{post}.objectID").alias("ObjectId"),
        F.col(f"{page}.title").alias("Webpage_title"),
        F.col(f"{page}.metaDescription").alias("MetaDescription"),
        F.col(f"{page}.metaKeywords").alias("MetaKeywords"),
        F.col(f"{page}.finalUrl").alias("FinalUrl"),
        F.col(f"{page}.topImage").alias("TopImage"),
    )


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    batch_size: int = 10_000,
    connections: int = 16,
    mode: str = "append",
) -> None:
    """Insert in batches over a bounded number of connections.

    A retried task may insert its rows again, so load a staging table and move the
    rows over by key in the database.
    """
    (
        df.write.mode(mode)
        .option("batchsize", batch_size)
        .option("numPartitions", connections)
        .jdbc(url, table, properties=properties or {})
    )
