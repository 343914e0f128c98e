"""Word vectors by skip-gram with negative samples, trained in parts that hold only their own words.

Sentences are dealt to parts of a bounded number of words. A part gets its sentences and the
words of them that are in the vocabulary, trains on vectors of just these, and passes them on;
the vectors of a word are averaged over its parts, by its uses there. First vectors come from a
hash of the word, so no part needs to be sent any in the first round; later rounds cut them out
of the table of the round before. The vocabulary and the vectors are tables throughout: only
the number of words comes to the driver.

Within a part, a batch of neighbouring positions is one pair of matrices: the vectors of all
words around, and those of the words in the middle with the negative samples, which the batch shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_written, settings

# Words of the sentences of one part; a part holds two vectors per different word of them.
PART_WORDS = 8_000_000
# As in Spark's Word2Vec: words to each side, the first step, and words that a sentence is cut at.
WINDOW, RATE, SENTENCE = 5, 0.025, 1000
# Negative samples per pair; positions and samples of a batch.
NEGATIVES, BATCH, SHARED = 5, 128, 64
DRAWS = 256
# Rows of vectors that a task passes on at a time.
ROWS = 4096
# Words that are looked up at a time; every look-up hashes the vocabulary of the part.
LOOKED_UP = 500_000
# Spark goes over the empty lists at the end of a batch once more with every row that it adds, so batches that have such lists stay short.
SHORT = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """All words of the sentences of a batch, and how many each has, from joined texts and sizes in bytes."""
    joined, lists = (pa.concat_arrays([batch.column(c)]) for c in ("text", "sizes"))
    sizes = lists.flatten().to_numpy(zero_copy_only=False)
    first = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset]
    ends = pa.array((first + np.append(0, np.cumsum(sizes))).astype(np.int32))
    flat = pa.StringArray.from_buffers(len(sizes), ends.buffers()[1], joined.buffers()[2])
    return flat, lists.value_lengths().to_numpy(zero_copy_only=False)


def _first_vectors(hashes: np.ndarray, dim: int) -> np.ndarray:
    """Uniform numbers within 1 / (2 ``dim``) of 0, by mixing the hash of the word with the dimension."""
    out = np.empty((len(hashes), dim), np.float32)
    seeds = hashes.astype(np.int64).view(np.uint64)
    for d in range(dim):
        x = seeds + np.uint64((d + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, d] = ((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32)
    return (out / np.float32(2**24) - np.float32(0.5)) / np.float32(dim)


def _move(table: np.ndarray, at: np.ndarray, steps: np.ndarray, pairs: np.ndarray, rate: np.float32) -> None:
    """Add the steps of each word; one of many pairs moves by the mean of them, so it cannot overshoot."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = order[new]
    if len(first) < len(at):
        # The sum of a word that stands several times goes to its first place.
        again = at[order[~new]]
        again.sort()
        names = again[np.append(True, again[1:] != again[:-1])]
        place = order[np.searchsorted(ordered, names)]
        same = (at == names[:, None]).astype(np.float32)
        steps[place] = same @ steps
        pairs[place] = same @ pairs
    table[at[first]] += steps[first] / np.maximum(1, pairs[first] * rate)[:, None]


def train(ids: np.ndarray, sentence: np.ndarray, vector: np.ndarray, out: np.ndarray, rates: tuple[float, float], rng: np.random.Generator) -> None:
    """One pass over the words ``ids`` of numbered sentences; moves ``vector`` and ``out`` in place."""
    size = len(ids)
    # Positions of no sentence around, so that all batches have one shape.
    last = -size % BATCH + WINDOW
    ids, sentence = np.pad(ids, (WINDOW, last)), np.pad(sentence, (WINDOW, last), constant_values=-1)
    sums = np.cumsum(np.bincount(ids[WINDOW : WINDOW + size], minlength=len(vector)) ** 0.75)
    away = np.abs(np.arange(-WINDOW, BATCH + WINDOW)[:, None] - np.arange(BATCH))
    away[away == 0] = WINDOW + 1
    for number, start in enumerate(range(0, size, BATCH)):
        # Random numbers of many batches are drawn at a time.
        if number % DRAWS == 0:
            widths = rng.integers(1, WINDOW + 1, (DRAWS, BATCH))
            samples = np.minimum(np.searchsorted(sums, rng.random((DRAWS, SHARED)) * sums[-1], side="right"), len(sums) - 1)
        rate = np.float32(rates[0] + (rates[1] - rates[0]) * start / size)
        around, middle = slice(start, start + BATCH + 2 * WINDOW), slice(start + WINDOW, start + WINDOW + BATCH)
        width = widths[number % DRAWS] * (sentence[middle] >= 0)
        near = (away <= width) & (sentence[around][:, None] == sentence[middle])
        targets = np.append(ids[middle], samples[number % DRAWS])
        x, y = vector[ids[around]], out[targets]
        pairs = np.empty((len(away), len(targets)), np.float32)
        pairs[:, :BATCH] = near
        pairs[:, BATCH:] = near.sum(axis=1, dtype=np.float32)[:, None] * np.float32(NEGATIVES / SHARED)
        # The part of a step that is common to both vectors: towards 1 for pairs, towards 0 for samples.
        score = x @ y.T
        score[:, BATCH:] *= -1
        step = pairs * rate / (1 + np.exp(np.minimum(score, 80)))
        step[:, BATCH:] *= -1
        _move(vector, ids[around], step @ y, pairs.sum(axis=1), rate)
        _move(out, targets, step.T @ x, pairs.sum(axis=0), rate)


def _part(dim: int, seed: int, rates: tuple[float, float], passed: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The training of one part, whose rows come in any order; the vectors ``passed`` go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held, words, part = [], [], [], 0

        def encode() -> None:
            flats, sizes = zip(*held, strict=True)
            texts.append((pa.concat_arrays(flats).dictionary_encode(), np.concatenate(sizes)))
            held.clear()

        for batch in batches:
            known = pc.is_valid(batch.column("word"))
            some = pc.sum(known).as_py() or 0
            if some < len(batch):
                held.append(_words(batch.filter(pc.invert(known))))
                if sum(len(flat) for flat, _ in held) >= LOOKED_UP:
                    encode()
            if some:
                part = batch.column("part")[0].as_py()
                words.append(batch.filter(known).select([c for c in ("word", "hash", "vector", "out") if c in batch.schema.names]))
        if held:
            encode()
        if not words:
            return
        known = pa.Table.from_batches(words).combine_chunks()
        del words
        names = known.column("word").combine_chunks()
        if "vector" not in known.column_names:
            vector = _first_vectors(known.column("hash").to_numpy(), dim)
            out = np.zeros_like(vector)
        else:
            vector, out = (_matrix(known.column(c).combine_chunks(), dim).copy() for c in ("vector", "out"))
        del known
        ids, sentence, number = [], [], 0
        for flat, sizes in texts:
            own = pc.fill_null(pc.index_in(flat.dictionary, value_set=names), -1).to_numpy(zero_copy_only=False)
            found = own[flat.indices.to_numpy(zero_copy_only=False)]
            of, kept = np.repeat(np.arange(len(sizes)), sizes), found >= 0
            found, of = found[kept], of[kept]
            # Sentences are cut by their known words; pieces are numbered in order.
            place = np.arange(len(of)) - np.searchsorted(of, of)
            new = (place % SENTENCE == 0).astype(np.int64)
            ids.append(found)
            sentence.append((number + np.cumsum(new) - 1).astype(np.int32))
            number += new.sum()
        del texts
        ids, sentence = np.concatenate(ids), np.concatenate(sentence)
        train(ids, sentence, vector, out, rates, np.random.default_rng([seed, part]))
        uses = np.bincount(ids, minlength=len(names))
        for at in range(0, len(names), ROWS):
            rows = slice(at, at + ROWS)
            moved = {"vector": vector[rows], "out": out[rows]}
            columns = [names[rows], pa.array(uses[rows]), *(_lists(moved[name]) for name in passed)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", *passed])

    return run


def _mean(dim: int, passed: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per word from those of its parts, which all lie in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        words = table.column("word").combine_chunks().dictionary_encode()
        names, at = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(names)))
        uses = table.column("n").to_numpy()[order]
        total = np.add.reduceat(uses, starts)
        share = (uses / total[at[order]]).astype(np.float32)[:, None]
        means = [np.add.reduceat(_matrix(table.column(c).combine_chunks(), dim)[order] * share, starts, axis=0) for c in passed]
        for first in range(0, len(names), ROWS):
            rows = slice(first, first + ROWS)
            columns = [names[rows], *(_lists(v[rows]) for v in means)]
            yield pa.RecordBatch.from_arrays(columns, ["word", *passed])

    return run


def vectors_fit(
    df: DataFrame,
    dim: int = 100,
    min_count: int = 5,
    max_iter: int = 1,
    partitions: int | None = None,
    seed: int = 1,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """``word, vector`` of the words that occur ``min_count`` times in ``words``, as a written table.

    There are ``partitions`` parts, or more if a part would have over ``part_words`` words.
    """
    # Numbers by which sentences are dealt are written with them, so that all later steps see the same.
    deal = F.xxhash64(F.monotonically_increasing_id())
    sentences = cut_lineage(df.select("words", F.size("words").alias("n"), deal.alias("deal")), "sentences")
    total = sentences.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(partitions or 1, -(-total // part_words))
    part = F.pmod("deal", F.lit(parts)).cast("int").alias("part")
    dealt = sentences.filter("n > 0").select(part, F.array_compact("words").alias("words"))

    uses = dealt.select("part", F.explode("words").alias("word")).groupBy("part", "word").agg(F.count("*").alias("n"))
    uses = cut_lineage(uses, "uses")
    kept = uses.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    listed = cut_lineage(uses.join(kept, "word", "left_semi").select("part", "word"), "listed")
    drop_written(uses)

    # A row is a sentence of a part (``word`` is null), or a word of it, with the vectors that it starts from after the first round.
    # The words of a sentence move as one text, with the bytes of each.
    joined = (F.array_join("words", "").alias("text"), F.transform("words", F.octet_length).alias("sizes"))
    texts = dealt.select("part", *joined, F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("hash"))
    state = None
    for turn in range(max_iter):
        words = listed if state is None else listed.join(state, "word")
        wordy = (F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<int>").alias("sizes"))
        words = words.select("part", *wordy, "word", F.xxhash64("word", F.lit(seed)).alias("hash"), *(state.columns[1:] if state else []))
        rates = tuple(max(RATE * (1 - done / max_iter), RATE * 1e-4) for done in (turn, turn + 1))
        # Only a further round needs the second vectors.
        passed = ["vector", "out"] if turn + 1 < max_iter else ["vector"]
        moved = ", ".join(f"{name} array<float>" for name in passed)
        rows = texts.unionByName(words, allowMissingColumns=True).repartitionById(parts, "part")
        trained = rows.mapInArrow(_part(dim, seed + turn, rates, passed), f"word string, n long, {moved}")
        merged = trained.repartition(2 * parts, "word").mapInArrow(_mean(dim, passed), f"word string, {moved}")
        with settings(df.sparkSession, SHORT):
            before, state = state, cut_lineage(merged, "vectors")
        if before is not None:
            drop_written(before)
    drop_written(listed)
    drop_written(sentences)
    return state
