"""Topics by expectation maximization on the graph of texts and terms, in parts.

Every text and every term has a weight per topic. A round shares each count of a term in
a text out to the topics by the product of both weights, and the sums of the shares are the
new weights. Terms are dealt to parts, one task each, and texts are cut into blocks of a bounded
size; the counts between a block of texts and a part of the terms are a cell, which lists the texts
of the block that use the part. Texts have far fewer weights than terms, so in a round the weights
of just these texts are cut out of every block and go to the part, which holds the weights of its terms
and reads cell by cell; its sums of the texts go back to the blocks. Shares are made in whole
arrays: texts, and terms, of as many counts in a cell stand side by side, so a product of stacked
matrices gives their sums. Weights are written tables from round to round, which cuts the
lineage, as plain bytes: between rounds those of the terms, by far the most, are rounded to single
precision, while all sums, and the weights of the model, are doubles. Only one number per topic
comes to the driver, after the last round.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import SHUFFLES_DROPPED, cut_lineage, drop_written, scratch_path, settings

# Weights of one block of terms: 2 MB. A block of texts has up to twice as many.
BLOCK_NUMBERS = 250_000
# Weights of the terms of a part, 80 MB, if that takes more parts than the cluster has cores; a task holds them twice.
PART_NUMBERS = 10_000_000
# Counts that a block of texts takes on before it is closed.
BLOCK_COUNTS = 2_000_000
# Shares computed at a time: as many as stay in a core's cache.
SHARE_NUMBERS = 30_000
# The files that a round reads have one row group each, so no smaller splits are tried, and the numbers of its partitions are set.
ROUNDS = SHUFFLES_DROPPED | {"spark.sql.files.maxPartitionBytes": "128m", "spark.sql.adaptive.enabled": "false"}
TEXTS, TERMS, TOTALS = 0, 1, 2
START, ROUND, LIKELIHOOD = "start", "round", "likelihood"

# ``used`` lists the texts of the cell by rising number of counts, which are in ``sizes``; their counts follow in ``n``, of the
# rows ``term`` of the part. ``terms`` and ``uses`` list its terms the same way; their counts are of the texts ``text`` (places
# in ``used``) and stand at ``place``.
PACKED = ["sizes", "term", "n", "terms", "uses", "text", "place"]
CELL = f"block long, part int, texts int, used array<int>, {', '.join(f'{c} binary' for c in PACKED)}"
# Sums of a round as bytes, in a column each, so that a scan reads one kind: of the texts of a cell, of a block of terms, of a part.
NUMBERS = "totals array<double>, terms long, k int, alpha double, eta double, rows int, parts int"
SUMS = "block long, part int, texts binary, terms binary, totals binary"


class TopicModel(NamedTuple):
    """Fitted weights: ``weights`` (kind, block, w), ``ids`` of the blocks of texts, and the sums per topic."""

    weights: DataFrame
    ids: DataFrame
    cells: DataFrame
    totals: list[float]
    terms: int
    k: int
    alpha: float
    eta: float
    rows: int
    parts: int

    def block_weights(self, kind: int) -> DataFrame:
        return self.weights.filter(F.col("kind") == kind).select("block", "w")


def _by_size(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different ``names`` by how often they occur, how often, the order that puts them so, and the rank of each."""
    found, at, sizes = np.unique(names, return_inverse=True, return_counts=True)
    order = np.argsort(sizes, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    ranks = rank[at]
    return found[order], sizes[order], np.argsort(ranks, kind="stable"), ranks


def _narrow(values: np.ndarray) -> np.ndarray:
    """Numbers in one or two bytes where that changes none of them; ``_wide`` tells by the width."""
    for kind in (np.uint8, np.uint16):
        if len(values) and 0 <= values.min() and values.max() <= np.iinfo(kind).max and (values == np.floor(values)).all():
            return values.astype(kind)
    return values


def _wide(data: pa.Scalar, entries: int, widest: type) -> np.ndarray:
    width = data.as_buffer().size // max(1, entries)
    return np.frombuffer(data.as_buffer(), {1: np.uint8, 2: np.uint16}.get(width, widest))


def _cells(vectors: DataFrame, id: str, rows: int, stripes: int, parts: int, texts: int) -> DataFrame:
    """Cells of the counts, and for each block of texts a row with its ids (``part`` is null).

    Terms are numbered by falling count, so they are dealt to the blocks in turn, and these to
    the parts: none has all the frequent ones.
    """
    kind = vectors.schema[id].dataType.simpleString()
    names = ["block", "part", "texts", "used", *PACKED, "ids"]

    def cell(text: np.ndarray, term: np.ndarray, n: np.ndarray) -> list:
        used, sizes, order, rank = _by_size(text)
        term, n = term[order], n[order]
        terms, uses, place, _ = _by_size(term)
        of_term = rank[order][place]
        packed = (sizes.astype(np.int32), term.astype(np.int32), _narrow(n), terms.astype(np.int32), uses.astype(np.int32), _narrow(of_term), place.astype(np.int32))
        return [used.astype(np.int32), *(c.tobytes() for c in packed)]

    def block_rows(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        text = np.repeat(np.arange(len(held)), [len(i) for _, i, _ in held])
        term, n = (np.concatenate([t[c] for t in held]) for c in (1, 2))
        part = term % stripes % parts
        order = np.argsort(part, kind="stable")
        text, term, n, part = text[order], term[order], n[order], part[order]
        local = term % stripes // parts * rows + term // stripes
        ends = np.searchsorted(part, np.arange(parts + 1))

        def row(part: int | None, packed: list, used: np.ndarray | None, ids: list | None) -> pa.RecordBatch:
            columns = [pa.array([number]), pa.array([part], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([used], pa.list_(pa.int32()))]
            columns += [pa.array([c], pa.binary()) for c in packed] + [pa.array([ids], pa.list_(id_type[0]))]
            return pa.RecordBatch.from_arrays(columns, names)

        for p in np.flatnonzero(np.diff(ends)).tolist():
            of = slice(ends[p], ends[p + 1])
            used, *packed = cell(text[of], local[of], n[of])
            yield row(p, packed, used, None)
        yield row(None, [None] * len(PACKED), None, [t[0] for t in held])

    id_type: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, counts = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            id_type[:] = [batch.column(0).type]
            features = batch.column(1)
            indices, values = (features.field(c) for c in ("indices", "values"))
            for row, name in enumerate(batch.column(0).to_pylist()):
                held.append((name, np.asarray(indices[row].values), np.asarray(values[row].values)))
                counts += len(held[-1][1])
                if len(held) == texts or counts >= BLOCK_COUNTS:
                    yield from block_rows(number, held)
                    number, held, counts = number + 1, [], 0
        if held:
            yield from block_rows(number, held)

    return vectors.select(id, "features").mapInArrow(run, f"{CELL}, ids array<{kind}>")


def _numbers(w: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    """Weights of a row, which are bytes between rounds and a list in a model."""
    return np.frombuffer(w.as_buffer(), kind) if pa.types.is_binary(w.type) else np.asarray(w.values)


def _null(kind: str, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)


def _meet(cells: DataFrame, texts: DataFrame, k: int, parts: int, whole: bool = False, packed: bool = False) -> DataFrame:
    """Sums of each block of texts, ``block, part, w``: as the cells of the parts use them, or ``whole`` (``part`` is null).

    ``texts`` has sums of the texts that a cell uses, or of whole blocks (``part`` is null). ``packed`` ones are bytes.
    """
    kind = texts.schema["w"].dataType.simpleString()
    wants = cells.select("block", "part", "texts", "used", _null(kind, "w"))
    rows = wants.unionByName(texts.select("block", "part", _null("int", "texts"), _null("array<int>", "used"), "w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total, of_part = None, np.zeros((0, k)), {}

        def out(part: int | None, w: np.ndarray) -> pa.RecordBatch:
            data = pa.array([w.tobytes()]) if packed else pa.ListArray.from_arrays(pa.array([0, w.size], pa.int32()), pa.array(w.ravel()))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part], pa.int32()), data], ["block", "part", "w"])

        def done() -> Iterator[pa.RecordBatch]:
            if whole and number is not None:
                yield out(None, total)
            elif number is not None:
                yield from (out(part, total[used]) for part, used in of_part.items())

        for batch in batches:
            for block, part, texts, used, w in zip(*batch.columns, strict=True):
                if block.as_py() != number:
                    yield from done()
                    number, total, of_part = block.as_py(), np.zeros((texts.as_py(), k)), {}
                if not w.is_valid:  # comes first
                    of_part[part.as_py()] = np.array(used.values)
                elif part.is_valid:
                    total[of_part[part.as_py()]] += _numbers(w).reshape(-1, k)
                else:
                    total += _numbers(w).reshape(-1, k)
        yield from done()

    ordered = rows.repartition(parts, "block").sortWithinPartitions("block", F.col("w").isNotNull(), "part")
    return ordered.mapInArrow(run, f"block long, part int, w {'binary' if packed else 'array<double>'}")


def _cut(model: TopicModel) -> DataFrame:
    """``block, part, w``: the weights of the texts that each cell uses, cut out where a block of texts lies."""
    texts = model.block_weights(TEXTS).select("block", _null("int", "part"), "w")
    return _meet(model.cells, texts, model.k, model.parts)


def _groups(sizes: np.ndarray, k: int) -> Iterator[tuple[int, slice, slice]]:
    """Stretches of equal ``sizes`` (which rise) of few enough numbers: the size, the places, and those of the counts."""
    each, first = np.unique(sizes, return_index=True)
    end = 0
    for size, low, high in zip(each.tolist(), first.tolist(), [*first[1:].tolist(), len(sizes)], strict=True):
        step = max(1, SHARE_NUMBERS // (size * k))
        for at in range(low, high, step):
            of = slice(at, min(at + step, high))
            start, end = end, end + (of.stop - at) * size
            yield size, of, slice(start, end)


class _Cell:
    """The counts between a block of texts and a part of the terms."""

    def __init__(self, sizes: pa.Scalar, term: pa.Scalar, n: pa.Scalar, terms: pa.Scalar, uses: pa.Scalar, text: pa.Scalar, place: pa.Scalar):
        self.sizes, self.term, self.terms, self.uses, self.place = (np.frombuffer(c.as_buffer(), np.int32) for c in (sizes, term, terms, uses, place))
        self.n, self.text = _wide(n, len(self.term), np.float64), _wide(text, len(self.term), np.int32)

    def start(self, sums: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A random share of every count, added to the ``sums`` of the terms; gives those of the texts."""
        k = sums.shape[1]
        of_text, text = np.zeros((len(self.sizes), k)), np.repeat(np.arange(len(self.sizes)), self.sizes)
        for low in range(0, len(self.n), max(1, SHARE_NUMBERS // k)):
            part = slice(low, low + max(1, SHARE_NUMBERS // k))
            shares = rng.random((len(self.n[part]), k))
            shares *= (self.n[part] / shares.sum(axis=1))[:, None]
            _add(of_text, text[part], shares)
            _add(sums, self.term[part], shares)
        return of_text

    def share(self, of_text: np.ndarray, of_term: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Sums of the shares, without the own weight of each side: those of the terms are added to ``sums``."""
        k = of_term.shape[1]
        text_sums, share = np.empty_like(of_text), np.empty(len(self.n))
        # A share is the product of both weights over their sum over the topics.
        for size, of, counts in _groups(self.sizes, k):
            other = of_term.take(self.term[counts], axis=0).reshape(-1, size, k)
            shares = self.n[counts].reshape(-1, size) / np.matmul(other, of_text[of, :, None])[:, :, 0]
            text_sums[of] = np.matmul(shares[:, None, :], other)[:, 0]
            share[counts] = shares.ravel()
        for size, of, counts in _groups(self.uses, k):
            other = of_text.take(self.text[counts], axis=0)
            shares = share[self.place[counts]]
            if size == 1:
                sums[self.terms[of]] += other * shares[:, None]
            else:
                sums[self.terms[of]] += np.matmul(shares.reshape(-1, 1, size), other.reshape(-1, size, k))[:, 0]
        return text_sums

    def log(self, of_text: np.ndarray, of_term: np.ndarray) -> float:
        """Log likelihood of the counts."""
        k, logs = of_term.shape[1], 0.0
        for size, of, counts in _groups(self.sizes, k):
            other = of_term.take(self.term[counts], axis=0).reshape(-1, size, k)
            logs += (self.n[counts] * np.log(np.matmul(other, of_text[of, :, None]).ravel())).sum()
        return logs


def _add(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add the rows of ``values`` to those of ``out`` at their places."""
    if (np.diff(at) < 0).any():
        order = np.argsort(at, kind="stable")
        at, values = at[order], values[order]
    starts = np.flatnonzero(np.append(True, np.diff(at) > 0))
    out[at[starts]] += np.add.reduceat(values, starts, axis=0)


def _sums(step: str, model: TopicModel, cut: DataFrame | None = None, given: DataFrame | None = None, seed: int = 0, kind: type = np.float32) -> DataFrame:
    """Sums of a ``step`` over all cells: of random shares, of the shares by the weights given, or of the log likelihood.

    ``cut`` (block, part, w) has the weights of the texts of each cell, and ``given`` (block, w) those of the
    blocks of terms, with rows without a block that add up to the sums per topic. New ones are stored as numbers of ``kind``.
    """
    k, rows, parts, stripes = model.k, model.rows, model.parts, _stripes(model.terms, model.rows)
    eta, alpha, terms_eta = model.eta - 1, model.alpha - 1, model.terms * (model.eta - 1)
    form = "binary" if given is None else given.schema["w"].dataType.simpleString()
    moved = "binary" if cut is None else cut.schema["w"].dataType.simpleString()
    none = [_null("binary", c) for c in PACKED]
    # In a part the sums per topic come first, then its blocks of terms, then each cell, followed by the weights of its texts.
    all_rows = model.cells.select("part", F.lit(2).alias("stage"), "block", *PACKED, _null(form, "w"), _null(moved, "cut"))
    if step != START:
        every, total = F.sequence(F.lit(0), F.lit(parts - 1)), F.col("block").isNull()
        goes = F.when(total, every).otherwise(F.array((F.col("block") % parts).cast("int")))
        own = given.select(F.explode(goes).alias("part"), F.when(total, 0).otherwise(1).alias("stage"), "block", *none, "w", _null(moved, "cut"))
        texts = cut.select("part", F.lit(2).alias("stage"), "block", *none, _null(form, "w"), F.col("w").alias("cut"))
        all_rows = all_rows.unionByName(own).unionByName(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, weights, sums, cell, logs = None, np.zeros(k), None, None, None, 0.0

        def row(block: int | None, texts: np.ndarray | None = None, terms: np.ndarray | None = None, totals: np.ndarray | None = None) -> pa.RecordBatch:
            data = (pa.array([None if v is None else v.tobytes()], pa.binary()) for v in (texts, terms, totals))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), *data], ["block", "part", "texts", "terms", "totals"])

        for batch in batches:
            for of_part, stage, block, *packed, w, cut in zip(*batch.columns, strict=True):
                if part is None:
                    part = of_part.as_py()
                    blocks = range(part, stripes, parts)
                    weights, sums = (np.zeros((len(blocks) * rows, k)) for _ in range(2))
                if stage.as_py() == 0:
                    total += _numbers(w)
                elif stage.as_py() == 1:
                    low = block.as_py() // parts * rows
                    weights[low : low + rows] = _numbers(w, np.float32).reshape(-1, k)
                elif not cut.is_valid:
                    if cell is None and step != START:
                        weights += eta
                        weights /= total + terms_eta
                    cell = _Cell(*packed)
                    if step == START:
                        yield row(block.as_py(), cell.start(sums, np.random.default_rng([seed, block.as_py(), part])))
                else:
                    of_text = _numbers(cut).reshape(-1, k) + alpha
                    if step == LIKELIHOOD:
                        of_text /= of_text.sum(axis=1, keepdims=True)
                        logs += cell.log(of_text, weights)
                    else:
                        yield row(block.as_py(), cell.share(of_text, weights, sums) * of_text)
        if part is None:
            return
        if step == LIKELIHOOD:
            yield row(None, totals=np.array([logs]))
            return
        if step == ROUND:
            sums *= weights
        for place, block in enumerate(blocks):
            yield row(block, terms=sums[place * rows : (place + 1) * rows].astype(kind))
        yield row(None, totals=sums.sum(axis=0))

    ordered = all_rows.repartitionById(parts, "part").sortWithinPartitions("stage", "block", F.col("cut").isNotNull())
    return ordered.mapInArrow(run, SUMS)


def _kept(sums: DataFrame) -> DataFrame:
    """The sums of a step as a written table. Weights hardly repeat, so a dictionary of them is no use."""
    return cut_lineage(sums, "sums", **{"parquet.enable.dictionary": "false", "compression": "none"})


def _texts(sums: DataFrame) -> DataFrame:
    return sums.filter(F.col("texts").isNotNull()).select("block", "part", F.col("texts").alias("w"))


def _given(sums: DataFrame) -> DataFrame:
    """Weights of the blocks of terms, and without a block the sums per topic of each part."""
    w = F.coalesce("terms", "totals")
    return sums.filter(w.isNotNull()).select("block", "part", w.alias("w"))


def _model_weights(model: TopicModel, sums: DataFrame) -> TopicModel:
    """The model with the sums of its last round: lists of numbers in folders by kind, a row per block."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, w in zip(*batch.columns, strict=True):
                numbers = pa.array(_numbers(w))
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), numbers)], ["block", "w"])

    spark, given = sums.sparkSession, _given(sums)
    # One row per part, in order, so that the sums are the same each time.
    totals = sum(np.frombuffer(bytes(r.w)) for r in sorted(given.filter("block IS NULL").collect(), key=lambda r: r.part)).tolist()
    kinds = {
        TEXTS: _meet(model.cells, _texts(sums), model.k, model.parts, whole=True).select("block", "w"),
        TERMS: given.filter("block IS NOT NULL").select("block", "w").mapInArrow(lists, "block long, w array<double>"),
        TOTALS: spark.createDataFrame([(0, totals)], "block long, w array<double>"),
    }
    path = scratch_path(spark, "weights")
    for kind, frame in kinds.items():
        frame.write.options(**{"parquet.enable.dictionary": "false", "compression": "none"}).parquet(f"{path}/kind={kind}")
    weights = spark.read.schema("block long, w array<double>, kind int").parquet(path).select("kind", "block", "w")
    return model._replace(weights=weights, totals=totals)


def _stripes(terms: int, rows: int) -> int:
    return max(1, -(-terms // rows))


def em_fit(
    vectors: DataFrame,
    id: str = "id",
    k: int = 50,
    max_iter: int = 50,
    seed: int = 1,
    alpha: float | None = None,
    eta: float = 1.1,
    block_numbers: int = BLOCK_NUMBERS,
) -> TopicModel:
    """Topics of the counts ``id, features``, read by every round.

    ``alpha`` (default 50 / k + 1) and ``eta`` above 1 draw the topics of a text and the
    terms of a topic together. The random start depends on ``seed`` and on how texts and terms
    are dealt. Texts need a term each, as ``count_vectors`` gives them.
    """
    first = vectors.select("features").first()
    if first is None:
        raise ValueError("there are no texts")
    spark, terms, rows = vectors.sparkSession, first[0].size, max(1, block_numbers // k)
    stripes, cores = _stripes(terms, rows), spark.sparkContext.defaultParallelism
    # As few parts as keep the cluster busy, since the weights of a text go to every part that uses it.
    parts = min(stripes, max(cores, -(-stripes * rows * k // PART_NUMBERS)))
    dealt = vectors.coalesce(max(cores, -(-vectors.count() // (2 * rows))))
    table = cut_lineage(_cells(dealt, id, rows, stripes, parts, 2 * rows), "cells")
    cells = table.filter(F.col("part").isNotNull()).drop("ids")
    ids = table.filter(F.col("part").isNull()).select("block", "ids")
    model = TopicModel(table, ids, cells, [], terms, k, 50 / k + 1 if alpha is None else alpha, eta, rows, parts)
    with settings(spark, ROUNDS):
        # The last sums become the weights of the model as they are.
        kinds = [*[np.float32] * max_iter, np.float64]
        sums = _kept(_sums(START, model, seed=seed, kind=kinds[0]))
        for kind in kinds[1:]:
            cut = _meet(cells, _texts(sums), k, parts, packed=True)
            before, sums = sums, _kept(_sums(ROUND, model, cut, _given(sums), kind=kind))
            drop_written(before)
        model = _model_weights(model, sums)
    drop_written(sums)
    return model


def em_topics(model: TopicModel, vocab: DataFrame, n: int = 20) -> DataFrame:
    """``topic, rank, word, weight``: the heaviest terms of each topic, the best of every block first."""
    k, size, totals, stripes = model.k, model.terms, np.array(model.totals), _stripes(model.terms, model.rows)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, w in zip(*batch.columns, strict=True):
                number = block.as_py()
                weights = (np.asarray(w.values).reshape(-1, k) / totals)[: len(range(number, size, stripes))]
                at = np.argsort(-weights, axis=0, kind="stable")[:n]
                columns = [np.tile(np.arange(k, dtype=np.int32), len(at)), at.ravel() * stripes + number, np.take_along_axis(weights, at, 0).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["topic", "idx", "weight"])

    top = model.block_weights(TERMS).mapInArrow(best, "topic int, idx long, weight double")
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "idx")
    top = top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    words = vocab.select("idx", F.col("term").alias("word"))
    return words.join(F.broadcast(top), "idx").select("topic", "rank", "word", "weight")  # topics x n rows


def em_distributions(model: TopicModel, id: str = "id") -> DataFrame:
    """``id, topicDistribution`` (an array) of every text that was fitted."""
    k = model.k
    kind = model.ids.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, w in zip(*batch.columns, strict=True):
                weights = np.asarray(w.values).reshape(-1, k)
                shares = weights / weights.sum(axis=1, keepdims=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(shares) + 1, dtype=np.int32) * k), pa.array(shares.ravel()))
                yield pa.RecordBatch.from_arrays([ids.values, lists], [id, "topicDistribution"])

    both = model.ids.join(model.block_weights(TEXTS), "block").select("ids", "w")
    return both.mapInArrow(run, f"{id} {kind}, topicDistribution array<double>")


def em_likelihood(model: TopicModel) -> float:
    """Mean log likelihood of a text's counts under its topics."""
    given = model.weights.filter(F.col("kind") != TEXTS).select(F.when(F.col("kind") == TERMS, F.col("block")).alias("block"), "w")
    logs = _sums(LIKELIHOOD, model, _cut(model), given).select("part", "totals").collect()
    whole = sum(np.frombuffer(bytes(r.totals))[0] for r in sorted(logs, key=lambda r: r.part))
    return float(whole) / model.ids.agg(F.sum(F.size("ids"))).first()[0]


def save_topics(model: TopicModel, path: str) -> None:
    """The model in a folder: weights, ids, cells, and one row of numbers."""
    for name in ("weights", "ids", "cells"):
        getattr(model, name).write.mode("errorifexists").parquet(f"{path}/{name}")
    numbers = [(model.totals, model.terms, model.k, model.alpha, model.eta, model.rows, model.parts)]
    model.weights.sparkSession.createDataFrame(numbers, NUMBERS).write.mode("errorifexists").json(f"{path}/numbers")


def load_topics(spark: SparkSession, path: str) -> TopicModel:
    numbers = spark.read.schema(NUMBERS).json(f"{path}/numbers").first()
    return TopicModel(*(spark.read.parquet(f"{path}/{name}") for name in ("weights", "ids", "cells")), *numbers)
