"""Merkle manifests against a plain Python version, and whole results against SQL."""

from __future__ import annotations

import zlib
from collections import Counter
from hashlib import sha256

import pytest
from brute import DOCS, awkward_texts, doc_rows
from pyspark.sql import functions as F

from storytrends.llm import merkle


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(doc, source, lang, n_chars, text) -> str:
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)]
    return digest("".join(fields))


def tree(items: list[str]) -> list[list[str]]:
    levels = [items]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def walk(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    steps = []
    for level in levels[:-1]:
        low = at - at % 3
        steps.append(("".join(level[low:at]), "".join(level[at + 1 : low + 3])))
        at //= 3
    return steps


def expected(rows: list[tuple]) -> Counter:
    """rows of doc_id, source, lang, n_chars, text."""
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[source] = tree([leaf(*r) for r in groups[source]])
    top = tree([trees[s][-1][0] for s in order])
    out = Counter()
    for n, source in enumerate(order):
        for at, row in enumerate(groups[source]):
            steps = walk(trees[source], at) + walk(top, n)
            doc, text = row[0], row[4]
            if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            end = leaf(*row[:4], text)
            for before, after in steps:
                end = digest(before + end + after)
            proof = digest("".join(b + a for b, a in steps))
            out[doc, leaf(*row), trees[source][-1][0], top[-1][0], proof, end, end == top[-1][0]] += 1
    return out


def found(frame) -> Counter:
    return Counter(tuple(r) for r in merkle.manifest(frame).collect())


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_awkward_rows_and_small_superblocks(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 3**height)
    rows = doc_rows(awkward_texts()) + doc_rows(awkward_texts())[3:5]
    rows += [(None, "a\nb", "en", None, 3, "x", "y", 7), (-5, "c\nd\n", None, "é", None, "x", "y", 7), (None, None, None, None, None, None, None, None)]
    rows += [(1000 + i, f"line {i}\nnext", "en", "hot", i, "x", "y", 7) for i in range(100)]
    frame = spark.createDataFrame(rows, DOCS).withColumns({"g": F.lit(1), "place": F.lit(2), "leaf": F.lit("l"), "digest": F.lit("d")})
    want = expected([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert found(frame) == want
    assert {k[-1] for k in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_sizes_around_runs(spark, n):
    rows = [(i, "one", "en", 1, f"t{i}\n") for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(frame) == expected(rows)


def test_real_table_with_many_superblocks(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.lit("hot")).otherwise(F.col("source")))
    rows = [tuple(r) for r in frame.select(*COLUMNS).collect()]
    assert found(frame) == expected(rows)
