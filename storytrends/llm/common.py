"""Written tables, joins that survive hot keys, and connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storytrends.session import cut_lineage as written
from storytrends.session import drop_written

#: A key is hot if it holds more than this share of all rows, so there are at most 2,000 hot keys.
HOT_SHARE = 1 / 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys that hold more than HOT_SHARE of the rows: fewer than 1 / HOT_SHARE by construction."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    hot = counts.filter((F.col("_n") > 1) & (F.col("_n") > total * HOT_SHARE))
    return [r[0] for r in hot.select(key).collect()]


def lookup(df: DataFrame, values: DataFrame, key: str, hot: list | None = None, how: str = "inner") -> DataFrame:
    """``df`` joined with ``values`` (one row per key); rows of hot keys are not shuffled.

    ``df`` is read twice, so give a written table. The hot part of ``values`` has fewer
    than 1 / HOT_SHARE rows and is broadcast; all other keys meet by an ordinary join.
    """
    hot = hot_keys(df, key) if hot is None else hot
    if not hot:
        return df.join(values, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return df.filter(is_hot).join(F.broadcast(values.filter(is_hot)), key, how).unionByName(
        df.filter(~is_hot).join(values.filter(~is_hot), key, how)
    )


def rank_within(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` (a written table) with ``rank`` from 0 within each ``group``; big groups are split.

    Rows are ranged over (group, order), which must tell all rows apart, and keep their
    place in the range. What a range holds of a group is one row of the small table of
    shares; summed up, these give the rank at which each share begins.
    """
    ranged = written(
        df.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")),
        "ranged",
    )
    share = ranged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    starts = share.select(group, "_part", (before - F.col("_low")).alias("_shift"))
    return (
        ranged.join(starts, [group, "_part"])
        .withColumn("rank", F.col("_at") + F.col("_shift"))
        .drop("_part", "_at", "_shift")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all ends of ``edges`` (a, b longs): the smallest node reachable.

    Every round takes the smallest label of the neighbours and then the label of the
    label, so the rounds grow with the logarithm of the longest chain. Labels and edges
    stay in written tables; only a count comes to the driver.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    hot = hot_keys(both, "a")
    labels = written(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")),
        "labels",
    )
    while True:
        heard = (
            lookup(both, labels.select(F.col("node").alias("a"), "label"), "a", hot)
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        near = written(
            labels.join(heard, "node", "left").select("node", "label", F.least("label", "heard").alias("low")), "labels"
        )
        up = near.select(F.col("node").alias("low"), F.col("low").alias("up"))
        before, labels = labels, written(
            lookup(near, up, "low").select("node", F.least("low", "up").alias("label"), (F.col("label") != F.least("low", "up")).alias("moved")),
            "labels",
        )
        drop_written(before)
        drop_written(near)
        if not labels.filter("moved").limit(1).count():
            drop_written(both)
            return labels.select("node", F.col("label").alias("component"))
