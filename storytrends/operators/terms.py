"""Terms: counts, vocabulary, bags of words and normalization by dictionary."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import suffix_base, token_filter
from ..session import collect_bounded, cut_lineage
from .rows import array_rows, row_keyed

# Rows of the vocabulary that may go to every task: some tens of megabytes.
HOT_TERMS = 500_000
# Dictionary entries that may be shipped to every task: some 100 MB of short strings.
DICTIONARY_ROWS = 4_000_000

_ROW_BITS = 33  # monotonically_increasing_id holds the row number in its low 33 bits


def term_rows(
    df: DataFrame,
    id: str,
    words: Column,
    stop: Iterable[str] = (),
    min_len: int = 4,
    letters_only: bool = True,
) -> DataFrame:
    """One row ``id, term`` per kept word; the rest is dropped inside the word list."""
    return array_rows(df, id, token_filter(words, stop, min_len, letters_only), "term")


def count_terms(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count("*").alias("n"))


def term_counts(terms: DataFrame) -> DataFrame:
    """Terms by falling count; equal counts by term."""
    return count_terms(terms).orderBy(F.desc("n"), "term")


def vocab_trimmed(counts: DataFrame, drop_top: int = 100, min_count: int = 1) -> DataFrame:
    """Counts without the ``drop_top`` most frequent terms."""
    return vocabulary(counts, drop_top, min_count).select("term", "n")


def vocabulary(counts: DataFrame, drop_top: int = 100, min_count: int = 1) -> DataFrame:
    """``term, n, idx`` of the kept terms: all are numbered once, then cut by number.

    The terms before ``drop_top`` are the most frequent ones, and those below
    ``min_count`` are the last, so the rest stays dense, and the texts are read once.
    """
    kept = vocab_index(counts).filter((F.col("idx") >= drop_top) & (F.col("n") >= min_count))
    return kept.select("term", "n", (F.col("idx") - drop_top).alias("idx"))


def vocab_index(vocab: DataFrame, partitions: int | None = None) -> DataFrame:
    """``term, n, idx`` with ``idx`` dense from 0 in order of falling count, then term.

    Terms are sorted in ranges; the index of a term is its row number within its
    range plus the size of the ranges before. The sorted table is written first, so
    that both steps see the same ranges. Only one row per range meets in one task.
    """
    spark = vocab.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        vocab.select("term", "n")
        .repartitionByRange(partitions, F.desc("n"), F.col("term"))
        .sortWithinPartitions(F.desc("n"), "term")
        .select("term", "n", F.monotonically_increasing_id().alias("_row"))
    )
    ordered = cut_lineage(ordered, "vocabulary").withColumn(
        "_range", F.shiftright("_row", _ROW_BITS)
    )
    sizes = ordered.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select(
        "_range",
        F.expr("sum(_size) OVER (ORDER BY _range) - _size").alias("_before"),
    )
    local = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return ordered.join(F.broadcast(before), "_range").select(
        "term", "n", (local + F.col("_before")).alias("idx")
    )


def bag_of_words(
    df: DataFrame, id: str, words: str, vocab: DataFrame, hot_terms: int = HOT_TERMS
) -> DataFrame:
    """``id, idx, n``: the count of each vocabulary term in each document.

    Every row of ``df`` is a document, also if ids repeat.
    The vocabulary is ordered by count, so its first ``hot_terms`` rows hold every
    term that could make a join key hot. They go to every task and are counted in
    place, without a shuffle. Only the rare terms behind them are joined by shuffle,
    and none of these has more than 1/``hot_terms`` of all words.
    """
    vocab = vocab.select("term", "idx")
    hot = vocab.filter(F.col("idx") < hot_terms)
    counted = count_in_place(df.select(id, words), hot.toArrow())
    pairs = F.arrays_zip(F.col("indices").alias("idx"), F.col("values").alias("n"))
    bag = counted.select(id, F.inline(pairs)).select(
        id, F.col("idx").cast("bigint").alias("idx"), F.col("n").cast("bigint").alias("n")
    )
    cold = vocab.filter(F.col("idx") >= hot_terms)
    if cold.isEmpty():
        return bag
    rows = array_rows(row_keyed(df, id, words), "_key", F.col(words), "term")
    rare = rows.join(F.broadcast(hot.select("term")), "term", "left_anti").join(cold, "term")
    rare = rare.groupBy("_key", "idx").agg(F.count("*").alias("n"))
    return bag.unionByName(rare.select(F.col("_key.id").alias(id), "idx", "n"))


def count_in_place(texts: DataFrame, vocab: pa.Table) -> DataFrame:
    """``id, indices, values``: per text the terms of ``vocab`` it has, and how often.

    Texts are ``id, words``; those without such a term are left out.
    """
    listed = vocab.sort_by("idx")
    shipped = texts.sparkSession.sparkContext.broadcast(listed.column("term").combine_chunks())
    id, words = texts.columns
    kind = texts.schema[id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shipped.value
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            found = pc.index_in(lists.flatten(), value_set=terms)
            known = pc.is_valid(found).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(lists)), sizes)[known]
            pairs = rows * max(len(terms), 1) + found.drop_null().to_numpy().astype(np.int64)
            pairs, counts = np.unique(pairs, return_counts=True)
            rows, indices = np.divmod(pairs, max(len(terms), 1))
            kept, starts = np.unique(rows, return_index=True)
            ends = pa.array(np.append(starts, len(rows)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(kept)),
                    pa.ListArray.from_arrays(ends, pa.array(indices.astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.float64))),
                ],
                [id, "indices", "values"],
            )

    return texts.mapInArrow(count, f"{id} {kind}, indices array<int>, values array<double>")


def article_word_counts(df: DataFrame, id: str = "id", words: str = "words") -> DataFrame:
    return df.select(id, F.size(words).alias("n_words"))


def term_normalize(
    df: DataFrame,
    id: str,
    words: str,
    dictionary: DataFrame,
    rules: Callable[[Column], Column] | None = suffix_base,
    max_rows: int = DICTIONARY_ROWS,
) -> DataFrame:
    """``id, words`` with every word replaced by its base form, order kept.

    ``dictionary`` holds ``form, base``; of a form that repeats the least base counts.
    Words it lacks go through ``rules``; null lists and words stay null, and rows stay
    rows, also if ids repeat. A dictionary of at most ``max_rows`` goes to every task and replaces
    words in place, without a shuffle; a bigger one is joined.
    """
    fallback = rules or (lambda w: w)
    dictionary = dictionary.groupBy("form").agg(F.min("base").alias("base"))
    small = collect_bounded(dictionary.select("form", "base"), max_rows)
    if small is None:
        return _normalize_by_join(df, id, words, dictionary, fallback)
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(
        (small["form"].combine_chunks(), small["base"].combine_chunks())
    )
    ready = df.select(
        F.col(id), F.col(words).alias("words"), F.transform(words, lambda w: fallback(w)).alias("_plain")
    )
    out = df.select(id, F.col(words).alias("words")).schema

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, bases = shipped.value
        for batch in batches:
            lists, plain = batch.column(1), batch.column(2)
            flat = pc.coalesce(
                based(lists.flatten(), forms, bases).cast(pa.string()), plain.flatten().cast(pa.string())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), rebuild_lists(lists, flat)], [id, "words"]
            )

    return ready.mapInArrow(replace, out)


def based(words: pa.Array, forms: pa.Array, bases: pa.Array) -> pa.Array:
    """The base of each word, null if it is no form.

    The forms look into the different words of a batch, which are fewer: no table of
    the whole dictionary is built for every batch.
    """
    coded = words.dictionary_encode()
    at = pc.index_in(forms, value_set=coded.dictionary)
    entry = np.full(len(coded.dictionary), -1)
    entry[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return bases.take(pa.array(entry, mask=entry < 0)).take(coded.indices)


def rebuild_lists(lists: pa.ListArray, flat: pa.Array) -> pa.ListArray:
    """Cut ``flat`` into lists of the lengths of ``lists``; nulls stay null."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    offsets = pa.array(np.concatenate([[0], ends]), type=pa.int32())
    mask = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(offsets, flat, mask=mask)


def _normalize_by_join(
    df: DataFrame, id: str, words: str, dictionary: DataFrame, fallback: Callable[[Column], Column]
) -> DataFrame:
    # Adaptive splitting of hot words needs a side without an aggregate behind its
    # shuffle, so the dictionary, often the result of one, is written first.
    entries = cut_lineage(dictionary.select(F.col("form").alias("word"), "base"), "dictionary")
    keyed = row_keyed(df, id, words).withColumn("_null", F.col(words).isNull())
    rows = keyed.select("_key", "_null", F.posexplode_outer(words).alias("pos", "word"))
    based = rows.join(entries, "word", "left").select(
        "_key", "_null", "pos", F.coalesce("base", fallback(F.col("word"))).alias("base")
    )
    # One list holds the words of one document, which came as one row.
    kept = F.when(F.col("pos").isNotNull(), F.struct("pos", "base"))
    ordered = F.array_sort(F.collect_list(kept))
    lists = based.groupBy("_key", "_null").agg(F.transform(ordered, lambda x: x["base"]).alias("words"))
    return lists.select(F.col("_key.id").alias(id), F.when(~F.col("_null"), F.col("words")).alias("words"))
