"""Operator 5: near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points, nearest first. Inverted lists hold
the vectors by pivot; two vectors become a candidate if they share enough pivots, and
candidates are verified by their cosine in double precision. Of PIVOTS_KEPT pivots, two
that share SHARED must meet in one of the first PIVOTS_KEPT - SHARED + 1, rarest first, so
only those lists are filled, and the first list a pair meets in is the one that counts it.
Lists are cut into blocks and met tile by tile; a tile returns counts and a spanning set
of links, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lookup, written

COSINE = 0.9
PIVOTS_KEPT = 10
SHARED = 2
#: Pivots: four times the square root of the vectors, at most MOST_PIVOTS (4 MB at 64 doubles).
MOST_PIVOTS = 8192
#: Pivots nearer than this to an earlier one are left out, so that copies do not fill the index.
PIVOT_SPREAD = 0.8
BLOCK = 1024


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as unit rows in double precision, shorter ones padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True), 1e-300)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def choose_pivots(heads: DataFrame, count: int, width: int) -> np.ndarray:
    """``count`` vectors by a hash of their id, without those near an earlier one; one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [unit_rows(batch.column(0), width) for batch in batches if batch.num_rows]
        if not rows:
            return
        found = np.concatenate(rows)
        cosine = found @ found.T
        kept: list[int] = []
        for n in range(len(found)):
            if not (cosine[n, kept] >= PIVOT_SPREAD).any():
                kept.append(n)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in found[kept]], pa.binary())], ["pivot"])

    sample = heads.orderBy(F.xxhash64(F.lit(3), "row"), "row").limit(count).select("embedding")
    found = sample.coalesce(1).mapInArrow(run, "pivot binary").collect()
    return np.stack([np.frombuffer(r[0], float) for r in found])


def tile_links(vec: np.ndarray, signature: np.ndarray, prefix: int, side: np.ndarray, pivot: int, weight: np.ndarray, threshold: float, shared: int):  # noqa: ANN201
    """(weight linked to each row, label of each row) for the pairs of one tile owned by ``pivot``.

    Signatures hold places in the global order (rarest first), ascending. ``side`` is 0 or
    1 for a tile of two blocks; all rows have side 0 if a block meets itself.
    """
    _, local = np.unique(signature, return_inverse=True)
    local = local.reshape(signature.shape)
    held = np.zeros((len(vec), local.max() + 1), np.float32)
    np.put_along_axis(held, local, 1, axis=1)
    earlier = np.zeros_like(held)
    early = signature[:, :prefix] < pivot
    at = np.repeat(np.arange(len(vec)), prefix).reshape(early.shape)
    earlier[at[early], local[:, :prefix][early]] = 1
    link = (held @ held.T >= shared) & (earlier @ earlier.T == 0) & (vec @ vec.T >= threshold)
    if side.any():
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, False)
    total = link @ weight
    label = np.arange(len(vec))
    while True:
        heard = np.minimum(label, np.where(link, label[None, :], len(vec)).min(axis=1))
        heard = heard[heard]
        if (heard == label).all():
            return total, label
        label = heard


def links(embeddings: DataFrame, threshold: float = COSINE, kept: int = PIVOTS_KEPT, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``embeddings`` (vec_id, embedding).

    Links are pairs with a cosine of ``threshold`` or more that share ``shared`` of their
    ``kept`` nearest pivots; none is below it. Equal vectors are one vector with a weight
    until the end. Null, zero and non-finite vectors link with nothing; shorter vectors
    count as padded with zeros. Rows that repeat a vec_id count as vectors of their own and
    share a component. Other columns are not read.
    """
    spark = embeddings.sparkSession
    value = F.col("embedding").cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce(~bad & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = written(
        embeddings.select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
            F.when(valid, F.col("embedding")).alias("embedding"),
        ).withColumn("key", F.md5(F.concat_ws(",", F.col("embedding").cast("array<string>")).cast("binary"))),
        "vectors",
    )
    usable = rows.filter("embedding IS NOT NULL")
    classes = usable.groupBy("key").agg(
        F.min("row").alias("head"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight")
    )
    known = written(lookup(usable, classes, "key"), "known")
    heads = known.filter("row = head").select("head", "low", "weight", "embedding", F.col("head").alias("row"))
    stats = heads.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not stats[0]:
        return plain
    width = stats[1]
    pivots = choose_pivots(heads, min(MOST_PIVOTS, math.ceil(4 * math.sqrt(stats[0])) + 16), width)
    kept = min(kept, len(pivots))
    shared = min(shared, kept)
    prefix = kept - shared + 1
    block = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = unit_rows(batch.column(3), width) @ block.value.T
            near = np.argsort(-cosine, axis=1, kind="stable")[:, :kept].astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), kept).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["head", "low", "weight", "embedding", "near"])

    kinds = f"head long, low long, weight long, embedding {embeddings.schema['embedding'].dataType.simpleString()}, near array<int>"
    described = written(heads.select("head", "low", "weight", "embedding").mapInArrow(nearest, kinds), "described")
    # At most MOST_PIVOTS rows: how long each pivot's full list would be, rarest first.
    sizes = described.select(F.explode("near").alias("p")).groupBy("p").count().collect()
    order = {r[0]: n for n, r in enumerate(sorted(sizes, key=lambda r: (r[1], r[0])))}
    places = spark.sparkContext.broadcast(np.array([order.get(p, -1) for p in range(len(pivots))], np.int32))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column(4).flatten().to_numpy().reshape(-1, kept)
            near = np.sort(places.value[near], axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), kept).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], ["head", "low", "weight", "embedding", "near"])

    posted = described.mapInArrow(ordered, kinds).withColumn("pivot", F.explode(F.slice("near", 1, prefix)))
    posted = written(posted, "posted")
    lists = posted.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("pivot >= 0")
    tiles = (
        posted.join(F.broadcast(lists), "pivot")  # one row per pivot
        .withColumn("own", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "pivot", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "head", "low", "weight", "embedding", "near",
        )
    )

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            tile = pa.Table.from_batches(parts).combine_chunks()
            column = {n: tile.column(n).combine_chunks() for n in tile.column_names}
            low, weight = column["low"].to_numpy(), column["weight"].to_numpy().astype(float)
            total, label = tile_links(
                unit_rows(column["embedding"], width), column["near"].flatten().to_numpy().reshape(-1, kept), prefix,
                column["side"].to_numpy(), int(column["pivot"][0].as_py()), weight, threshold, shared,
            )
            use = np.flatnonzero(total > 0)
            out = [column["head"].to_numpy()[use], total[use].astype(np.int64), low[use], low[label[use]]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["head", "n", "a", "b"])

        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end <= start:
                    continue
                key = tuple(keys[start].tolist())
                if at is not None and key != at:
                    yield result(held)
                    held = []
                at = key
                held.append(batch.slice(start, end - start))
        if held:
            yield result(held)

    sorted_tiles = tiles.repartition("pivot", "lo", "hi").sortWithinPartitions("pivot", "lo", "hi")
    found = written(sorted_tiles.mapInArrow(met, "head long, n long, a long, b long"), "found")
    counts = found.groupBy("head").agg(F.sum("n").alias("n"))
    edges = found.filter("a <> b").select("a", "b").unionByName(known.filter("vec_id <> low").select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    parts = components(edges).withColumnsRenamed({"node": "vec_id", "component": "component_id"})
    counted = lookup(known.select("row", "head", "weight"), counts, "head", how="left")
    own = counted.select("row", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("row", "vec_id").join(own, "row", "left").join(parts, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept")
    )
