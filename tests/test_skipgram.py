"""Word vectors trained in parts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import Word2Vec

from storytrends.operators import skipgram
from storytrends.plans import queries_topics

THEMES, WORDS = 12, 6


def themed(n: int, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    draw = lambda t: "all" if rng.random() < 0.2 else f"t{t}w{rng.randrange(WORDS)}"
    return [([draw(i % THEMES) for _ in range(12)],) for i in range(n)]


@pytest.mark.parametrize(("part_words", "rounds"), [(10**6, 1), (30_000, 1), (30_000, 3)])
def test_words_of_a_theme_are_near(spark, part_words, rounds):
    texts = spark.createDataFrame(themed(12_000), "words array<string>")
    rows = skipgram.vectors_fit(texts, dim=20, max_iter=rounds, part_words=part_words).collect()
    names = [r.word for r in rows]
    assert sorted(names) == sorted(["all", *(f"t{t}w{w}" for t in range(THEMES) for w in range(WORDS))])
    themes = np.array([n.split("w")[0] for n in names])
    vectors = np.array([r.vector for r in rows])
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    cosines = vectors @ vectors.T - 2 * np.eye(len(names))
    near = themes[np.argsort(-cosines, axis=1)[:, : WORDS - 1]] == themes[:, None]
    assert near[themes != "all"].mean() > 0.95


def test_vocabulary_is_that_of_all_parts(spark):
    """A word counts over all parts, and has a vector even where it stands alone."""
    rows = [(["rare", f"once{i}", "often"],) for i in range(4)] + [(["lone"],), ([],), ([None],), (None,)] * 5 + [(["often"] * 2500,)]
    texts = spark.createDataFrame(rows, "words array<string>")
    counts = Counter(w for (words,) in rows for w in words or () if w)
    for least in (1, 4, 5):
        found = skipgram.vectors_fit(texts, dim=8, min_count=least, partitions=7).collect()
        assert sorted(r.word for r in found) == sorted(w for w, n in counts.items() if n >= least)
        assert all(len(r.vector) == 8 and np.isfinite(r.vector).all() and any(r.vector) for r in found)
    assert skipgram.vectors_fit(texts, dim=8, min_count=10_000).count() == 0
    assert skipgram.vectors_fit(texts.limit(0), dim=8).count() == 0


def test_one_seed_gives_one_start():
    hashes = np.array([3, -7, 2**62])
    first = skipgram._first_vectors(hashes, 100)
    assert (first == skipgram._first_vectors(hashes, 100)).all() and len(np.unique(first)) > 290
    assert np.abs(first).max() <= 0.005 and abs(first.mean()) < 0.001


def test_steps_of_one_word_add_up():
    at = np.array([4, 2, 4, 9, 4, 2])
    steps = np.arange(12, dtype=np.float32).reshape(6, 2)
    pairs = np.array([1, 1, 1, 1, 100, 2], np.float32)
    expected = np.zeros((10, 2), np.float32)
    for word in (2, 4, 9):
        expected[word] = steps[at == word].sum(axis=0) / max(1, pairs[at == word].sum() * 0.05)
    table = np.zeros((10, 2), np.float32)
    skipgram._move(table, at, steps.copy(), pairs.copy(), np.float32(0.05))
    assert np.allclose(table, expected)


def test_very_frequent_words_stay_finite():
    rng = np.random.default_rng(1)
    vector = skipgram._first_vectors(np.array([1, 2]), 10)
    out = np.zeros_like(vector)
    ids = (rng.random(50_000) < 0.01).astype(np.int32)
    skipgram.train(ids, np.arange(50_000, dtype=np.int32) // 1000, vector, out, (0.025, 0.0), rng)
    assert np.isfinite(vector).all() and np.abs(vector).max() < 10


def test_a_word_is_the_mean_of_its_parts_by_uses():
    def batch(words, n, vectors):
        vectors = pa.array(vectors, pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n, pa.int64()), vectors], ["word", "n", "vector"])

    parts = [batch(["a", "b"], [1, 5], [[1.0, 0.0], [2.0, 2.0]]), batch(["a"], [3], [[5.0, 4.0]])]
    merged = {r["word"]: r["vector"] for b in skipgram._mean(2, ["vector"])(iter(parts)) for r in b.to_pylist()}
    assert merged == {"a": [4.0, 3.0], "b": [2.0, 2.0]}


def test_registered_fits_keep_no_model_on_the_driver(spark, tables, monkeypatch):
    """Spark's own Word2Vec holds all vectors on the driver; neither query may call it."""

    def refuse(*_):
        raise AssertionError("all vectors on the driver")

    monkeypatch.setattr(Word2Vec, "fit", refuse)
    fitted = queries_topics.word2vec_fit(spark, tables)
    again = queries_topics.word2vec_roundtrip(spark, tables)
    assert fitted.filter("trained").count() == again.filter("trained").count() == fitted.count() > 100
    assert fitted.join(again, "word", "left_anti").count() == 0


def test_rows_of_a_part_are_cheap_to_pass(spark, monkeypatch):
    """Empty lists cost Spark a pass over the batch per row: first vectors are no columns, and batches are short."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(name), skipgram.cut_lineage

    def cut(df, table, **options):
        if table == "vectors":
            inputs = df._jdf.queryExecution().analyzed().toString().split("MapInArrow")[-1].splitlines()[0]
            seen.append((spark.conf.get(name), "vector" in inputs.split("[")[0]))
        return write(df, table, **options)

    monkeypatch.setattr(skipgram, "cut_lineage", cut)
    texts = spark.createDataFrame(themed(300), "words array<string>")
    assert skipgram.vectors_fit(texts, dim=8, max_iter=2).count() == THEMES * WORDS + 1
    assert seen == [("500", False), ("500", True)] and spark.conf.get(name) == before


def test_words_are_looked_up_over_batches():
    """Sentences of several short batches, and the words of the part between them, train as those of one batch."""

    def rows(sentences, names):
        words = [None] * len(sentences) + names
        sizes = [[len(w) for w in s] for s in sentences] + [None] * len(names)
        columns = {"part": [0] * len(words), "text": ["".join(s) for s in sentences] + [None] * len(names), "sizes": pa.array(sizes, pa.list_(pa.int32()))}
        columns |= {"word": pa.array(words, pa.string()), "hash": pa.array([None] * len(sentences) + [hash(w) % 2**31 for w in names], pa.int64())}
        return pa.RecordBatch.from_pydict(columns)

    sentences = [list("abcab"), list("cabde"), list("edc"), list("aabb")] * 30
    split = [rows(sentences[:50], ["c"]), rows(sentences[50:51], []), rows(sentences[51:], ["a", "b", "d"])]
    whole = [rows([], ["c", "a", "b", "d"]), rows(sentences, [])]
    run = skipgram._part(8, 1, (0.025, 0.0), ["vector"])
    first, second = ({r["word"]: (r["n"], r["vector"]) for b in run(iter(batches)) for r in b.to_pylist()} for batches in (split, whole))
    assert first == second and first["a"][0] == 150 and len(first) == 4
