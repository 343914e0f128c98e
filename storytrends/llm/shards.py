"""Operator 10: shards by proportional stratified interleaving.

Within each source the rows are ranked in a seeded shuffle; a rank divided by the size of
its source is a fraction, and sorting all rows by it interleaves the sources in
proportion. Cut into equal runs, every shard holds the mixture of the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, rank_within, written

SHARDS = 16
SEED = 17


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``rows``: counts of shards differ by one at most. The shuffle key is a hash of
    seed and text, so equal texts have nearly one fraction in every source and lie side by
    side, apart only where a shard ends. Ties go by doc_id, then by row. A null text is
    empty, a null source is a source of its own, repeated rows are placed each for itself,
    an empty table gives no rows, and other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.sha2(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), 256).substr(1, 16).alias("_source"),
            F.xxhash64(F.lit(seed), text).alias("_key"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "keyed",
    )
    sizes = keyed.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"))
    ranked = written(rank_within(keyed, "_source", ["_key", "doc_id", "_row"]), "ranks")
    mixed = lookup(ranked, sizes, "_source").select(
        "doc_id", "size", "text_crc32", "_source", "_row",
        ((F.col("rank") + 0.5) / F.col("_n")).alias("_fraction"),
        F.lit(0).alias("_all"),
    )
    total = keyed.count()
    order = rank_within(mixed, "_all", ["_fraction", "_source", "doc_id", "_row"])
    shard = F.expr(f"rank * {shards}L div {max(total, 1)}L").cast("int")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return order.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
