"""Tokenized texts, topic words, stop words and word vectors."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_to_words
from ..schema import TOPIC_WORDS


def read_tokenized(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """``id, words`` from parquet, or from text lines ``id, w1 w2 w3``."""
    if format != "text":
        return spark.read.format(format).load(path)
    line = F.col("value")
    comma = F.instr(line, ",")
    return spark.read.text(path).select(
        line.substr(F.lit(1), comma - 1).alias("id"),
        text_to_words(line.substr(comma + 1, F.length(line))).alias("words"),
    )


def read_topic_words(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """``topicId, word, weight`` from parquet or from ``topic, word, weight`` lines."""
    if format == "parquet":
        return spark.read.parquet(path)
    return (
        spark.read.schema(TOPIC_WORDS)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def stop_words(
    spark: SparkSession, path: str | None = None, language: str = "english"
) -> DataFrame:
    """Distinct stop words of a file with one word per line, or of Spark's own lists."""
    if path:
        words = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    else:
        listed = StopWordsRemover.loadDefaultStopWords(language)
        words = spark.createDataFrame([(w,) for w in listed], "word string")
    return words.filter(F.col("word") != "").distinct()


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word, vector`` of a table of word vectors."""
    return spark.read.parquet(path).select("word", F.col("vector").cast("array<double>").alias("vector"))


def load_word2vec(path: str) -> Word2VecModel:
    return Word2VecModel.load(path)


def word_vectors_of(model: Word2VecModel) -> DataFrame:
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))
