"""Stop words from a table of any size.

A short list is a literal set. A longer one stays a table: its Bloom filter goes to every
task and marks the words that may be stop words, and only those meet the table in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import collect_bounded, cut_lineage
from .rows import row_keyed

# Words of a literal set.
LITERAL_WORDS = 10_000
# Bits of the largest filter, 16 MB; a longer list only lets more words through to the join.
MAX_BITS = 1 << 27
BITS_A_WORD, PROBES = 12, 5


def _hashes(word: Column) -> tuple[Column, Column]:
    """Two numbers of 52 bits, so that the sums of a probe stay exact."""
    return F.shiftrightunsigned(F.xxhash64(word), 12), F.shiftrightunsigned(F.xxhash64(word, F.lit(1)), 12)


def bloom_filter(words: DataFrame, bits: int) -> np.ndarray:
    """The filter of the column ``word`` in 64-bit cells; ``bits`` is a power of two.

    Bits are joined by cell before the shuffle, and no more than ``bits`` / 64 rows, those
    that hold a bit, come to the driver.
    """
    first, second = _hashes(F.col("word"))
    places = F.array(*(F.pmod(first + F.lit(i) * second, F.lit(bits)) for i in range(PROBES)))
    rows = words.select(F.explode(places).alias("at"))
    bit = F.expr("shiftleft(1L, CAST(at % 64 AS INT))")
    cells = rows.groupBy(F.expr("at div 64").alias("cell")).agg(F.bit_or(bit).alias("held")).toArrow()
    out = np.zeros(max(bits // 64, 1), np.int64)
    out[cells["cell"].to_numpy()] = cells["held"].to_numpy()
    return out.view(np.uint64)


def may_contain(cells: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether each word, given by its two hashes, may be in the filter."""
    found = np.ones(len(first), bool)
    for i in range(PROBES):
        at = (first + i * second) % (len(cells) * 64)
        found &= (cells[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return found


def without_stop_words(
    df: DataFrame, id: str, words: str, stop: DataFrame, max_words: int = LITERAL_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """``id, words``: the lists without the words of ``stop`` (column ``word``), in their order.

    Null words are left out, null lists stay null, words that repeat stay, and rows stay
    rows, also if ids repeat. The number of stop words chooses the way, not the result.
    """
    stop = cut_lineage(stop.filter(F.col("word").isNotNull()).select("word").distinct(), "stop")
    small = collect_bounded(stop, max_words)
    if small is not None:
        listed = small["word"].to_pylist()
        kept = F.filter(words, lambda w: w.isNotNull() & (~w.isin(listed) if listed else F.lit(True)))
        return df.select(id, kept.alias("words"))
    bits = min(max_bits, 1 << (BITS_A_WORD * stop.count()).bit_length())
    marked = cut_lineage(_marked(row_keyed(df, id, words), words, bloom_filter(stop, bits)), "marked")
    suspect = marked.filter(F.size("doubt") > 0).select("_key", F.explode("doubt").alias("at"), F.col("words"))
    suspect = suspect.select("_key", "at", F.get("words", F.col("at")).alias("word"))
    # A stop word that fills the texts is one row here, so no task gets all of its uses.
    used = cut_lineage(suspect.select("word").distinct().join(stop, "word", "left_semi"), "used")
    hits = suspect.join(used, "word").groupBy("_key").agg(F.collect_set("at").alias("gone"))
    joined = marked.join(hits, "_key", "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    places = F.array_except(F.sequence(F.lit(0), F.size("words") - 1), gone)
    left = F.filter(F.transform(places, lambda i: F.get("words", i)), lambda w: w.isNotNull())
    kept = F.when(F.size("words") == 0, F.col("words")).when(F.col("words").isNotNull(), left)
    return joined.select(F.col("_key.id").alias(id), kept.alias("words"))


def _marked(rows: DataFrame, words: str, cells: np.ndarray) -> DataFrame:
    """``_key, words, doubt``: the places of the words that may be stop words."""
    shipped = rows.sparkSession.sparkContext.broadcast(cells)
    none = F.array().cast("array<long>")
    first = F.coalesce(F.transform(words, lambda w: _hashes(w)[0]), none)
    second = F.coalesce(F.transform(words, lambda w: _hashes(w)[1]), none)
    ready = rows.select("_key", F.col(words).alias("words"), first.alias("a"), second.alias("b"))
    key = rows.schema["_key"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a", "b"))
            found = may_contain(shipped.value, first, second)
            sizes = batch.column("a").value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            at = (np.arange(len(found)) - np.repeat(ends - sizes, sizes))[found].astype(np.int32)
            counted = np.append(0, np.cumsum(found))
            bounds = pa.array(np.append(0, counted[ends]).astype(np.int32))
            doubt = pa.ListArray.from_arrays(bounds, pa.array(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), doubt], ["_key", "words", "doubt"])

    return ready.mapInArrow(mark, f"_key {key}, words array<string>, doubt array<int>")
