"""Readers and writers, each written to the shared folder and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import sinks, sources
from ..functions.text import words_to_text
from ..operators import filters as fl
from ..session import scratch_path
from .queries_text import PAGE_TEXTS, TOKENIZED
from .queries_topics import DISTRIBUTION, _TOPIC_WORDS, _topic_words
from .registry import CORPUS, STORIES, query
from .views import article_topics, items, stories, table, tokenized

# Stories by day: a document, the order of the same key and a page.
_ITEMS = f"""WITH {CORPUS}, {STORIES}, {PAGE_TEXTS},
items AS (
  SELECT c.id, c.title, c.text, s.created_at, s.author, s.points, s.num_comments, p.url,
         t.title AS page_title, t."metaDescription", t."metaKeywords", t."finalUrl", t."topImage"
  FROM corpus c JOIN stories s ON s.story_id = c.id CROSS JOIN np
  JOIN pages p ON p.page_id = c.id % np.c JOIN page_texts t ON t.page_id = p.page_id)"""


def _written_items(spark, root):
    path = scratch_path(spark, "daily")
    stories = items(spark, root)
    order = F.col("HNItem.objectID").cast("bigint")
    sinks.write_daily(stories, path, F.col("day"), order)
    return path


@query(
    "story_load",
    f"""{_ITEMS} SELECT CAST(id AS VARCHAR) AS id, title, url, CAST(author AS VARCHAR) AS author,
        CAST(points AS INTEGER) AS points, CAST(num_comments AS INTEGER) AS num_comments,
        CAST(epoch(created_at) AS INTEGER) AS created_at_i, md5(text) AS text_md5, page_title,
        strftime(created_at, '%Y-%m-%d') AS file_day FROM items""",
)
def story_load(spark, root):
    loaded = sources.read_stories(spark, sources.period_glob(_written_items(spark, root)))
    post = (F.col(f"HNItem.{c}") for c in ("title", "url", "author", "points", "num_comments", "created_at_i"))
    return loaded.select(
        F.col("HNItem.objectID").alias("id"),
        *post,
        F.md5("webpage.cleanedText").alias("text_md5"),
        F.col("webpage.title").alias("page_title"),
        F.col("file_day").cast("string").alias("file_day"),
    )


@query(
    "daily_write",
    f"""{_ITEMS} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS stories,
        CAST(sum(points) AS BIGINT) AS points FROM items
        WHERE year(created_at) = 1997 AND month(created_at) = 6 GROUP BY 1""",
)
def daily_write(spark, root):
    """The day files of one month, found by their names alone."""
    june = sources.period_glob(_written_items(spark, root), 1997, 6)
    loaded = sources.read_stories(spark, june)
    return loaded.groupBy(F.col("file_day").cast("string").alias("day")).agg(
        F.count("*").alias("stories"), F.sum("HNItem.points").alias("points")
    )


@query(
    "article_export",
    f"""{_ITEMS} SELECT strftime(created_at, '%Y-%m-%d') AS "Date", text AS "Article",
        CAST(author AS VARCHAR) AS "Author", title AS "Title", CAST(points AS INTEGER) AS "Points", url AS "Url",
        CAST(id AS VARCHAR) AS "ObjectId", page_title AS "Webpage_title", "metaDescription" AS "MetaDescription",
        "metaKeywords" AS "MetaKeywords", "finalUrl" AS "FinalUrl", "topImage" AS "TopImage" FROM items""",
)
def article_export(spark, root):
    rows = sinks.article_export(items(spark, root))
    # The day is taken before the session time zone can shift it.
    day = F.date_from_unix_date(F.floor(F.unix_seconds("Date") / 86400).cast("int"))
    return rows.withColumn("Date", day.cast("string"))


@query(
    "flatten_items",
    f"""{_ITEMS} SELECT page_title, "metaDescription", "metaKeywords", text AS "cleanedText", "finalUrl",
        "topImage", title, url, CAST(author AS VARCHAR) AS author, CAST(points AS INTEGER) AS points,
        '' AS story_text, CAST(num_comments AS INTEGER) AS num_comments,
        CAST(epoch(created_at) AS INTEGER) AS created_at_i, CAST(id AS VARCHAR) AS "objectID" FROM items""",
)
def flatten_items(spark, root):
    return fl.flatten_items(items(spark, root))


@query(
    "tokenized_roundtrip",
    f"WITH {TOKENIZED} SELECT CAST(id AS VARCHAR) AS id, array_to_string(words, ' ') AS words, "
    "CAST(len(words) AS INTEGER) AS n_words FROM tokenized",
)
def tokenized_roundtrip(spark, root):
    path = scratch_path(spark, "tokenized")
    sinks.write_tokenized(tokenized(spark, root), path, "text")
    loaded = sources.read_tokenized(spark, path, "text")
    return loaded.select("id", words_to_text(F.col("words")).alias("words"), F.size("words").alias("n_words"))


@query("comments_flatten", "SELECT text AS comment_text FROM conversations")
def comments_flatten(spark, root):
    turns = table(spark, root, "conversations")
    # As in a paged dump, a document holds at most a thousand comments.
    page = F.floor(F.col("turn") / 1000)
    hits = F.collect_list(F.struct(F.col("text").alias("comment_text")))
    dump = turns.groupBy("conv_id", page.alias("page")).agg(hits.alias("hits")).select("hits")
    path = scratch_path(spark, "comments")
    dump.write.json(path)
    return sources.read_comments(spark, path)


@query("comments_split", "SELECT text AS comment_text FROM conversations")
def comments_split(spark, root):
    """Dumps of which each is one line, read by cutting where a hit begins."""
    turns = table(spark, root, "conversations")
    hits = F.collect_list(F.struct(F.lit(0).alias("created_at"), F.col("text").alias("comment_text")))
    page = turns.groupBy("conv_id", F.floor(F.col("turn") / 1000).alias("page")).agg(hits.alias("hits"))
    path = scratch_path(spark, "dump")
    page.select("hits", F.lit(0).alias("nbPages")).write.option("ignoreNullFields", "false").json(path)
    return sources.read_split_comments(spark, path)


@query(
    "month_store",
    f"""WITH {STORIES} SELECT year(created_at) AS year, month(created_at) AS month, count(*) AS stories,
        CAST(sum(CASE WHEN strftime(created_at, '%Y-%m') = '1997-06' THEN 2 * points ELSE points END) AS BIGINT) AS points
        FROM stories WHERE strftime(created_at, '%Y-%m') BETWEEN '1996-11' AND '1997-09' GROUP BY ALL""",
)
def month_store(spark, root):
    """All stories stored by month, one month written again, and a range of months read."""
    path = scratch_path(spark, "store")
    posts = stories(spark, root, comments=False)
    sources.write_months(posts, path, "created_at")
    june = sources.in_period(posts, "created_at", 1997, 6)
    sources.write_months(june.withColumn("points", F.col("points") * 2), path, "created_at")
    read = sources.read_months(spark, path, dt.date(1996, 11, 1), dt.date(1997, 9, 30))
    return read.groupBy(F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month")).agg(
        F.count("*").alias("stories"), F.sum("points").alias("points")
    )


@query(
    "clustering_roundtrip",
    f"""WITH {DISTRIBUTION} SELECT CAST(id AS VARCHAR) AS "objectID", topic AS "topicId", probability
        FROM dist""",
)
def clustering_roundtrip(spark, root):
    rows = article_topics(spark, root).select(
        F.col("id").cast("string").alias("objectID"), F.col("topic").alias("topicId"), "probability"
    )
    path = scratch_path(spark, "clustering")
    sinks.write_clustering(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query(
    "topics_roundtrip",
    f"""WITH {_TOPIC_WORDS} SELECT CAST(ascii(topic) AS INTEGER) AS "topicId", word, weight FROM ranked""",
)
def topics_roundtrip(spark, root):
    words = _topic_words(spark, root).select(F.ascii("topic").alias("topicId"), "word", "weight")
    path = scratch_path(spark, "topics")
    sinks.write_topics(words, path, "csv")
    return sources.read_topic_words(spark, path, "csv")
