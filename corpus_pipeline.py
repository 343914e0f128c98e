"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrends.llm import minhash, packing, quality, repeats, rules
from storytrends.llm.common import table, written


def _aside(docs: DataFrame) -> DataFrame:
    """doc_id and text beside the whole row, so that no column of a row can clash."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(_aside(docs), model).filter("predicted = 1").select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail."""
    ruled = rules.apply_rules(_aside(docs)).filter("kept")
    return repeats.with_text(ruled, docs, F.col("clean_text"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: of the smallest doc_id, a null one being the last.

    Rows are told apart by a number of their own, so each stays or goes by its own text. Of
    rows of one id in one class that of the smallest hash stays. Null and blank texts all stay.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), order.alias("order"), F.struct(*docs.columns).alias("row"))
    rows = written(rows, "numbered")
    found = minhash.near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    classes = found.select(F.col("doc_id").alias("key"), "class_id").join(rows.select("key", "order"), "key")
    kept = classes.groupBy("class_id").agg(F.min(F.struct("order", "key")).alias("m")).select("m.key")
    return rows.join(kept, "key", "left_semi").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that occur earlier."""
    return repeats.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", clean),
    ("near-duplicates", dedup),
    ("repeated strings", cut_repeats),
    ("packing", pack),
]

#: Models, signatures, suffixes and linear programs are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
