"""Views of the test tables in the shapes the operators take."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_words, title_tokens, token_filter
from ..operators.filters import webpage_extract
from ..operators.rows import array_rows
from ..operators.similarity import group_vector_mean
from ..operators.terms import count_terms, vocab_index
from ..session import cut_lineage, spread

# Function words of the four languages of the documents, of more than three letters.
STOP = (
    "that", "this", "with", "from", "have", "were", "their", "which",
    "dans", "pour", "avec", "nicht", "sich", "eine", "para", "como",
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _row_count(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


def stories(
    spark: SparkSession, root: str, comments: bool = True, topic: bool = False, url: bool = False
) -> DataFrame:
    """Orders as stories; the tables behind the optional columns are joined on demand.

    Every order has its customer and its page, so leaving them out loses no row.
    """
    orders = table(spark, root, "orders")
    columns = [
        F.col("o_orderkey").alias("story_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_custkey").alias("author"),
        F.floor(F.col("o_totalprice") / 1000).alias("points"),
    ]
    df = orders
    if comments:
        lines = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
        df = df.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        columns.append(F.coalesce("n", F.lit(0)).alias("num_comments"))
    if topic:
        customers = table(spark, root, "customer").select("c_custkey", "c_nationkey")
        df = df.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        columns.append(F.col("c_nationkey").alias("topic"))
    if url:
        pages = table(spark, root, "pages").select("page_id", "url")
        page = F.col("o_orderkey") % _row_count(pages)
        df = df.withColumn("_page", page).join(pages, F.col("_page") == F.col("page_id"))
        columns.append(F.col("url"))
    return df.select(*columns)


def corpus(spark: SparkSession, root: str) -> DataFrame:
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    docs = table(spark, root, "documents").select("doc_id", "lang", "source", "text")
    return spread(docs, "doc_id").select(
        F.col("doc_id").alias("id"), "lang", "source", title.alias("title"), "text"
    )


def filtered_words(df: DataFrame) -> Column:
    return token_filter(split_words(F.col("text")), STOP)


def tokenized(spark: SparkSession, root: str) -> DataFrame:
    docs = corpus(spark, root)
    return docs.select("id", filtered_words(docs).alias("words"))


def titles(spark: SparkSession, root: str) -> DataFrame:
    return corpus(spark, root).select("id", title_tokens(F.col("title")).alias("words"))


def vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label"
    )


def word_table(spark: SparkSession, root: str) -> DataFrame:
    return vectors(spark, root).select(F.col("id").alias("word"), "vector")


def label_means(spark: SparkSession, root: str, name: str = "label") -> DataFrame:
    """Mean vector per label; written, so that joins know how small it is."""
    means = group_vector_mean(vectors(spark, root), "label")
    return cut_lineage(means.withColumnRenamed("label", name), "means")


def text_word_table(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of title words: the word of index i gets embedding i, the rest has none."""
    words = array_rows(titles(spark, root), "id", F.col("words"), "term")
    vocab = vocab_index(count_terms(words))
    found = vocab.join(vectors(spark, root), F.col("idx") == F.col("id"))
    return cut_lineage(found.select(F.col("term").alias("word"), "vector", "idx"), "words")


def article_topics(spark: SparkSession, root: str) -> DataFrame:
    """Orders as articles; the nation of the supplier is a topic, quantity its weight."""
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    suppliers = table(spark, root, "supplier").select("s_suppkey", "s_nationkey")
    weights = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_orderkey", "s_nationkey")
        .agg(F.sum("l_quantity").alias("w"))
    )
    total = F.expr("sum(w) OVER (PARTITION BY l_orderkey)")
    return weights.select(
        F.col("l_orderkey").alias("id"),
        F.col("s_nationkey").alias("topic"),
        (F.col("w") / total).alias("probability"),
    )


def items(spark: SparkSession, root: str) -> DataFrame:
    """Documents as nested stories, with the facts of an order and a web page each."""
    docs = corpus(spark, root)
    pages = table(spark, root, "pages")
    facts = stories(spark, root)
    page_texts = webpage_extract(pages).drop("cleanedText").withColumnRenamed("title", "page_title")
    page_texts = page_texts.join(pages.select("page_id", "url"), "page_id")
    joined = (
        docs.join(facts, F.col("id") == F.col("story_id"))
        .withColumn("_page", F.col("id") % _row_count(pages))
        .join(page_texts, F.col("_page") == F.col("page_id"))
    )
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', created_at)")
    webpage = F.struct(
        F.col("page_title").alias("title"),
        "metaDescription",
        "metaKeywords",
        F.col("text").alias("cleanedText"),
        "finalUrl",
        "topImage",
    )
    post = F.struct(
        F.timestamp_seconds(seconds).alias("created_at"),
        "title",
        "url",
        F.col("author").cast("string").alias("author"),
        F.col("points").cast("int").alias("points"),
        F.lit("").alias("story_text"),
        F.col("num_comments").cast("int").alias("num_comments"),
        seconds.cast("int").alias("created_at_i"),
        F.col("id").cast("string").alias("objectID"),
    )
    return joined.select(
        webpage.alias("webpage"), post.alias("HNItem"), F.to_date("created_at").alias("day")
    )


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Name tables for ad-hoc SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
