from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storytrends.functions import vectors as vx
from storytrends.operators import lsh
from storytrends.operators import similarity as si


def brute_nearest(queries, words, n, exclude_self=False):
    """Nearest words by plain loops: (score falling, word)."""
    out = {}
    for q, a in queries:
        found = []
        for w, b in words:
            den = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
            if den == 0 or (exclude_self and q == w):
                continue
            found.append((-round(sum(x * y for x, y in zip(a, b)) / den, 9), w))
        out[q] = [w for _, w in sorted(found)[:n]]
    return out


def named(spark, rows, name, kind="string"):
    return spark.createDataFrame(rows, f"{name} {kind}, vector array<double>")


@pytest.fixture(scope="module")
def words():
    rng = random.Random(7)
    rows = [(f"w{i:03d}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    # A third of all words are copies of one vector, and one word has none.
    rows += [(f"copy{i:03d}", rows[5][1]) for i in range(60)]
    return rows + [("zero", [0.0] * 6)]


def test_column_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(
        vx.vec_sum(a, b), vx.vec_dot(a, b), vx.vec_div(a, F.lit(2.0)), vx.vec_norm(a), vx.scaled_dot(a, b),
        vx.cosine(a, b), vx.cosine(a, F.array(F.lit(0.0), F.lit(0.0))),
    ).first()
    assert list(row)[:5] == [[4.0, 6.0], 11.0, [1.5, 2.0], 5.0, 2.75]
    assert row[5] == pytest.approx(11 / (5 * math.sqrt(5))) and row[6] is None


def test_cosine_of_unequal_sizes_is_an_error(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="unequal size"):
        df.select(vx.cosine(F.col("a"), F.col("b"))).collect()


def test_candidates_in_small_slices(monkeypatch, words):
    queries = words[3:20]
    names, points = pa.array([w for w, _ in words]), np.array([v for _, v in words])
    labels, targets = pa.array([w for w, _ in queries]), np.array([v for _, v in queries])
    for numbers in (10**6, 17 * 30, 5):
        monkeypatch.setattr(si, "SCORE_NUMBERS", numbers)
        kept = si._candidates(names[:70], points[:70], labels, targets, 7, True)
        for at, found, _ in (
            si._candidates(names, points, labels, targets, 7, True),
            si._candidates(names[70:], points[70:], labels, targets, 7, True, kept),
        ):
            found = np.array(found.to_pylist())
            got = {q: found[at == i].tolist() for i, (q, _) in enumerate(queries)}
            assert got == brute_nearest(queries, words, 7, True)


def test_candidates_with_one_very_long_name():
    """Names stay in Arrow: one long name does not widen all others."""
    names = pa.array(["x" * 2_000_000, *(f"w{i}" for i in range(2000))])
    rng = np.random.default_rng(1)
    points, targets = rng.standard_normal((2001, 4)), rng.standard_normal((5, 4))
    tracemalloc.start()
    at, found, _ = si._candidates(names, points, pa.array(list("abcde")), targets, 3, False)
    assert len(at) == len(found) == 15 and tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("block_numbers", [10**6, 60])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_nearest_words_equals_brute_force(spark, words, block_numbers, exclude_self):
    queries = words[:40] + [("far", [1.0] + [0.0] * 5)]
    found = si.nearest_words(
        named(spark, queries, "query"), named(spark, words, "word").repartition(5), 7,
        exclude_self, block_numbers=block_numbers,
    )
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append(r["word"])
    assert got == brute_nearest(queries, words, 7, exclude_self)


def test_nearest_words_checks_sizes(spark, words):
    with pytest.raises(Exception, match="unequal size"):
        si.nearest_words(named(spark, [("q", [1.0])], "query"), named(spark, words, "word")).collect()


@pytest.mark.parametrize("block_numbers", [10**6, 60])
def test_nearest_centre_equals_brute_force(spark, words, block_numbers):
    rng = random.Random(3)
    centres = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(25)]
    centres.append((30, centres[4][1]))  # a tie goes to the lower number
    found = si.nearest_centre(
        named(spark, words, "id").repartition(4), named(spark, centres, "cluster", "int"),
        block_numbers=block_numbers,
    )
    got = {r.id: r.cluster for r in found.collect()}
    expected = {}
    for name, v in words:
        distance = [(sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in centres]
        expected[name] = min(distance)[1]
    assert got == expected


@pytest.mark.parametrize("block_numbers", [10**6, 60])
def test_classify_nearest_label(spark, words, block_numbers):
    labels = [("b", words[5][1]), ("a", words[5][1])] + [(f"l{i}", words[i][1]) for i in range(10, 30)]
    found = si.classify_nearest_label(
        named(spark, words, "id"), named(spark, labels, "label"), block_numbers=block_numbers
    )
    got = {r.id: r.label for r in found.collect()}
    expected = brute_nearest(words, labels, 1)
    assert got == {k: v[0] if v else None for k, v in expected.items()}
    assert got["copy001"] == "a" and got["zero"] is None


@pytest.mark.parametrize("block_numbers", [10**6, 2])
def test_nearest_centre_of_small_and_missing_vectors(spark, block_numbers):
    points = named(spark, [("a", [1e-5, 0.0]), ("b", [1e6 + 0.25, 1.0]), ("none", None)], "id")
    centres = named(spark, [(0, [0.0, 0.0]), (1, [1e-5, 0.0]), (2, [1e6, 1.0]), (3, [1e6 + 0.5, 1.0])], "cluster", "int")
    found = si.nearest_centre(points, centres, block_numbers=block_numbers).collect()
    assert {r.id: r.cluster for r in found} == {"a": 1, "b": 2, "none": None}


def test_unknown_labels_are_named(spark, words):
    table = named(spark, words, "word")
    assert si.unknown_labels(table, [words[0][0], "no such word"]) == ["no such word"]


@pytest.mark.parametrize("block_numbers", [10**6, 1])
def test_title_vectors_shipped_and_joined(spark, words, block_numbers):
    table = dict(words)
    rng = random.Random(1)
    texts = [(i, [rng.choice([*table, "unknown"]) for _ in range(rng.randint(1, 9))]) for i in range(50)]
    texts += [(90, ["unknown"]), (91, [])]
    df = spark.createDataFrame(texts, "id int, words array<string>")
    found = si.title_vectors(df, named(spark, words, "word"), block_numbers=block_numbers)
    got = {r.id: r.vector for r in found.collect()}
    assert set(got) == {i for i, w in texts if w}
    for i, tokens in texts:
        if tokens:
            mean = np.sum([table.get(t, [0.0] * 6) for t in tokens], axis=0) / len(tokens)
            assert got[i] == pytest.approx(list(mean))


def test_segment_sums_in_small_pieces(monkeypatch):
    monkeypatch.setattr(si, "GATHER_NUMBERS", 6)
    matrix = np.arange(12.0).reshape(6, 2)
    rows, sizes = np.array([0, 1, 2, 3, 4, 5, 5, 0]), np.array([3, 1, 4])
    sums = si._segment_sums(matrix, rows, sizes)
    assert sums.tolist() == [matrix[:3].sum(0).tolist(), matrix[3].tolist(), matrix[[4, 5, 5, 0]].sum(0).tolist()]


def test_group_means_and_unknown_words(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "k string, vector array<double>")
    assert {r.k: r.vector for r in si.group_vector_mean(df, "k").collect()} == {"a": [2.0, 3.0], "b": [5.0, 6.0]}
    tokens = spark.createDataFrame([("x",), ("y",)], "word string")
    vectors = named(spark, [("x", [1.0, 1.0])], "word")
    assert {r.word: r.vector for r in si.word_vectors(tokens, vectors).collect()} == {"x": [1.0, 1.0], "y": [0.0, 0.0]}


def test_label_vectors(spark, words):
    found = si.label_vectors(named(spark, words, "word"), ["w001", "missing"]).collect()
    assert [(r.label, r.vector) for r in found] == [words[1]]


@pytest.mark.parametrize("block_numbers", [10**6, 1])
def test_title_vectors_of_nulls_and_repeats(spark, block_numbers):
    table = named(spark, [("a", [2.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 4.0])], "word")
    rows = spark.createDataFrame([(1, ["a", None, "b"]), (1, ["a"]), (2, None), (3, [None])], "id int, words array<string>")
    found = si.title_vectors(rows, table, block_numbers=block_numbers).collect()
    assert sorted((r.id, tuple(r.vector)) for r in found) == [(1, (0.5, 2.0)), (1, (1.0, 0.0))]


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_of_many_dimensions_are_one_aggregate(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: (i * F.col("id")).cast("double")).alias("vector"))
    summed = si.group_vector_sum(rows, "k", dim=100)
    text = executed(summed)
    assert text.count("partial_aggregate_metrics(") == 1 and text.count("partial_sum(") == 1
    found = {r.k: r for r in summed.collect()}
    for k in range(3):
        ids = range(k, 1000, 3)
        assert found[k].n == len(ids) and found[k].vector == pytest.approx([i * sum(ids) for i in range(1, 101)])


def test_sums_of_null_vectors_count_rows(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", None), ("b", None)], "k string, vector array<double>")
    found = {r.k: (r.vector, r.n) for r in si.group_vector_sum(rows, "k").collect()}
    assert found == {"a": ([1.0, 2.0], 2), "b": ([0.0, 0.0], 1)}


@pytest.fixture(scope="module")
def planted():
    """900 random words in 32 dimensions, and five near ones of each of 30 queries."""
    rng = np.random.default_rng(11)
    words = [(f"r{i:04d}", v.tolist()) for i, v in enumerate(rng.standard_normal((900, 32)))]
    queries = []
    for q in range(30):
        base = rng.standard_normal(32)
        queries.append((f"q{q:02d}", base.tolist()))
        words += [(f"near{q:02d}_{i}", (base + rng.standard_normal(32) * s).tolist()) for i, s in enumerate((0.2, 0.4, 0.6, 0.8, 1.0))]
    return queries, words


@pytest.mark.parametrize("tile_rows", [4096, 10])
def test_hash_tables_find_planted_words(spark, planted, tile_rows):
    queries, words = planted
    found = lsh.nearest_words_lsh(named(spark, queries, "query"), named(spark, words, "word"), 5, min_cosine=0.6, tile_rows=tile_rows).collect()
    exact = si.nearest_words(named(spark, queries, "query"), named(spark, words, "word"), 5).filter("score >= 0.6").collect()
    scores = {(r.query, r.word): r.score for r in found}
    hits = [(r.query, r.word) for r in exact if (r.query, r.word) in scores]
    assert len(exact) > 130 and len(hits) >= 0.95 * len(exact)
    assert all(scores[r.query, r.word] == pytest.approx(r.score, abs=1e-9) for r in exact if (r.query, r.word) in scores)


def test_hash_tables_with_copies_zeros_and_ties(spark, words):
    """With one bucket a table everything is met, so the result is the exact one, also among many copies."""
    rows = words + [("none", None)]
    queries = words[:30] + [("nil", None), ("zero", [0.0] * 6)]
    for exclude_self in (False, True):
        found = lsh.nearest_words_lsh(named(spark, queries, "query"), named(spark, rows, "word"), 7, exclude_self, min_cosine=-1.0, recall=1 - 1e-9, tile_rows=40)
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query, []).append(r.word)
        assert got == {q: w for q, w in brute_nearest(words[:30], words, 7, exclude_self).items() if w}


def test_planned_tables_follow_size_and_similarity():
    small, large = lsh.plan_tables(1000, 0.6), lsh.plan_tables(1_000_000, 0.6)
    assert large.bits > small.bits and large.count > small.count
    assert lsh.plan_tables(1000, 0.9).count < small.count
    assert lsh.plan_tables(0, 0.5).bits == 1 and lsh.plan_tables(10**12, 0.5).bits == lsh.MAX_BITS


def test_hash_tables_do_not_copy_vectors(spark, monkeypatch):
    """No table is written with a row per bucket, however many buckets a vector lies in."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1500, 16)))]
    words = spark.createDataFrame(rows, "word long, vector array<double>")
    written = []
    monkeypatch.setattr(lsh, "cut_lineage", lambda df, name="table", **o: (written.append(df.count()), df.cache())[1])
    found = lsh.nearest_words_lsh(words.filter("word % 4 = 0").withColumnRenamed("word", "query"), words, 3, True, min_cosine=0.35)
    assert found.select("query").distinct().count() == 375
    assert sum(written) <= 1500


def test_big_word_tables_move_sums_not_vectors(spark, words):
    """Past one block a text gets at most a sum per block of words, not a vector per word."""
    texts = [(i, [words[(i + j) % 20][0] for j in range(60)]) for i in range(40)]
    df = spark.createDataFrame(texts, "id int, words array<string>")
    found = si.title_vectors(df, named(spark, words, "word"), block_numbers=len(words) * 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(words" not in plan and "CoGroup" in plan
    table = dict(words)
    for r in found.collect():
        assert r.vector == pytest.approx(np.mean([table[w] for w in dict(texts)[r.id]], axis=0).tolist())


def test_mean_vectors_sum_known_words_only(spark):
    """Unknown words and null ids count; no row of an unknown word carries a vector."""
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "x"), (2, "x"), (None, "b"), (None, None)], "id int, word string")
    table = spark.createDataFrame([("a", [3.0, 6.0]), ("b", [2.0, 4.0])], "word string, vector array<double>")
    means = si.mean_vectors(rows, table, "id", "word")
    assert {r.id: r.vector for r in means.collect()} == {1: [2.0, 4.0], 2: [0.0, 0.0], None: [1.0, 2.0]}
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (word" in plan
