"""Operator 4: packing token sequences by cutting-stock column generation.

Every document is cut at multiples of the sequence length. Its full pieces fill a
sequence each; the rest, shorter than a sequence, is an item. Items are counted by
length class, a histogram of bounded size whatever the number of documents. On it a
linear program over patterns (which classes share a sequence) is solved: the simplex
method keeps a basis of patterns, and a knapsack dynamic program over the dual prices
finds the next column. Patterns are rounded down, what is left over is placed first-fit,
and the items, ranked within their class, are dealt to the patterns by a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoded, vocabulary_path
from .common import rank_within, written

LENGTH = 2048
#: Width of a length class: an item counts as the next multiple.
GRAIN = 8
END_ID = 1
PIECES = "doc_id long, doc_copy long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece of each document's ids, cut at multiples of ``length``.

    ``doc_copy`` tells rows of the same doc_id apart.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, copies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, tokens in encoded(batch.column(1), path):
                tokens = np.append(tokens, np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(tokens), length):
                    part = tokens[start : start + length]
                    rows.append((ids[row], copies[row], start, len(part), zlib.crc32(part.tobytes()), len(tokens)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            names = ["doc_id", "doc_copy", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("doc_copy"))
    return rows.mapInArrow(run, PIECES)


def best_pattern(prices: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Most valuable filling of ``units`` by classes 1..units, any number of each."""
    value = np.zeros(units + 1)
    taken = np.zeros(units + 1, np.int64)
    for room in range(1, units + 1):
        gains = prices[:room] + value[room - 1 :: -1][:room]
        best = int(np.argmax(gains))
        if gains[best] > value[room - 1]:
            value[room], taken[room] = gains[best], best + 1
        else:
            value[room] = value[room - 1]
    pattern, room = np.zeros(len(prices), np.int64), units
    while room > 0:
        if taken[room]:
            pattern[taken[room] - 1] += 1
            room -= taken[room]
        else:
            room -= 1
    return float(value[units]), pattern


def cutting_stock(demand: np.ndarray, units: int, rounds: int = 2000, gap: float = 1e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns over classes 1..units and how often each is used, covering ``demand`` exactly.

    Column generation on the demanded classes; it ends when no pattern improves the bound
    by more than ``gap`` of the optimum. ``rounds`` bounds the time; any basis is feasible.
    """
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    need = demand[used].astype(float)
    width = used + 1
    basis = np.diag(units // width).astype(float)
    inverse = np.diag(1.0 / (units // width))
    cost = np.ones(len(used))
    level = inverse @ need
    # Prices are drawn towards those of the best bound so far; at first, towards the lengths.
    centre, bound, pull = width / units, 0.0, 0.8
    for _ in range(rounds):
        dual = cost @ inverse
        if cost @ level <= bound * (1 + gap):
            break
        entering = np.zeros(len(used))
        if dual.min() < -1e-9:  # a surplus of this class lowers the cost
            entering[np.argmin(dual)] = -1
            price = 0.0
        else:
            price = 1.0
            for weight in (pull, 0.0):
                tried = weight * centre + (1 - weight) * np.maximum(dual, 0)
                prices = np.zeros(units)
                prices[used] = tried
                worth, pattern = best_pattern(prices, units)
                if need @ tried / worth > bound:
                    bound, centre = need @ tried / worth, tried / worth
                entering = pattern[used].astype(float)
                if dual @ entering > 1 + 1e-9:
                    break
            else:
                break
        column = inverse @ entering
        up = column > 1e-9
        ratio = np.where(up, level / np.where(up, column, 1), np.inf)
        leave = int(np.argmin(ratio))
        basis[:, leave], cost[leave] = entering, price
        row = inverse[leave] / column[leave]
        inverse -= np.outer(column, row)
        inverse[leave] = row
        level = np.maximum(inverse @ need, 0)
    left = demand.copy()
    plan = []
    for j in np.argsort(-level * cost, kind="stable"):
        if not cost[j]:
            continue
        pattern = np.zeros(units, np.int64)
        pattern[used] = np.rint(basis[:, j]).astype(np.int64)
        fits = min((int(left[c] // pattern[c]) for c in np.flatnonzero(pattern)), default=0)
        count = min(int(level[j] + 1e-9), fits)
        if count:
            plan.append((pattern, count))
            left -= count * pattern
    return plan + first_fit(left, units)


def first_fit(left: np.ndarray, units: int) -> list[tuple[np.ndarray, int]]:
    """Fill sequences one pattern at a time, longest class first; equal patterns are used at once."""
    left, plan = left.copy(), []
    while left.any():
        pattern, room = np.zeros(units, np.int64), units
        for c in np.flatnonzero(left)[::-1]:
            take = min(int(left[c]), room // (int(c) + 1))
            pattern[c] += take
            room -= take * (int(c) + 1)
        count = min(int(left[c] // pattern[c]) for c in np.flatnonzero(pattern))
        plan.append((pattern, count))
        left -= count * pattern
    return plan


def pack(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end token alone. Repeated rows are packed each for itself.
    Equal lengths are ranked by doc_id, start and row. An empty table gives no rows. Extra
    columns are not read.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, length, path), "pieces")
    units = length // grain
    item = F.col("length") < length
    cls = F.ceil(F.col("length") / grain).cast("int")
    items = pieces.filter(item).withColumn("class", cls)
    counts = {r[0]: r[1] for r in items.groupBy("class").count().collect()}
    demand = np.array([counts.get(c + 1, 0) for c in range(units)], np.int64)
    plan = cutting_stock(demand, units)
    slots, first, given = [], 0, np.zeros(units, np.int64)
    for pattern, count in plan:
        before = 0
        for c in np.flatnonzero(pattern):
            each = int(pattern[c])
            slots.append((int(c) + 1, int(given[c]), int(given[c] + each * count), each, first, before))
            given[c] += each * count
            before += each
        first += count
    schema = "class int, low long, high long, each long, first long, place long"
    dealt = F.broadcast(spark.createDataFrame(slots, schema))  # at most a few patterns per class
    ranked = rank_within(items, "class", ["length", "doc_id", "start", "doc_copy"])
    inside = F.col("rank") - F.col("low")
    placed = ranked.join(dealt, "class").filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(inside / F.col("each"))).withColumn(
        "place", F.col("place") + inside % F.col("each")
    )
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = number(pieces.filter(~item), first)
    return placed.select(*out).unionByName(full.withColumn("offset", F.lit(0).cast("long")).select(*out))


def number(pieces: DataFrame, first: int) -> DataFrame:
    """Full pieces numbered gaplessly from ``first``: partitions, their sizes, and a place in each."""
    whole = written(
        pieces.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "full"
    )
    starts, at = [], first
    for part, size in sorted((r[0], r[1]) for r in whole.groupBy("_part").count().collect()):  # a row per partition
        starts.append((part, at))
        at += size
    before = F.broadcast(whole.sparkSession.createDataFrame(starts, "_part int, _before long"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return whole.join(before, "_part").withColumn("sequence_id", F.col("_before") + place)
