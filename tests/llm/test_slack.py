"""Packing by minimum bin slack against plain token ids and exhaustive search."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import DOCS, awkward_texts, doc_rows
from tokenizers import Tokenizer

from storytrends.llm import queries, slack
from storytrends.llm.bpe import vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")


def expected_pieces(rows, length):
    tokenizer, out = Tokenizer.from_file(PATH), Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, slack.END_ID]
        first = len(ids) % length or length
        starts = [0, *range(first, len(ids), length)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            out[doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


def check_packing(found, length):
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(itertools.accumulate([0, *(n for _, n in pieces)]))[:-1]
        assert sum(n for _, n in pieces) <= length
    return len(bins)


@pytest.mark.parametrize("length", [64, 1024])
def test_pieces_and_places(spark, length):
    texts = [*awkward_texts(), "<|endoftext|> and 'tis　x\x85", "\n" * 400_000]
    rows = doc_rows(texts) + doc_rows(texts)[3:6] + [(None, "no id", "en", None, 5, "x", "y", 7)]
    found = slack.pack(spark.createDataFrame(rows, DOCS), length).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected_pieces([r[:2] for r in rows], length)
    least = -(-sum(r.length for r in found) // length)
    assert check_packing(found, length) <= least * 1.1 + 1


def test_query_fills_sequences(spark, tables):
    found = queries.op13_slack_packing(spark, tables).collect()
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected_pieces([(r.doc_id, r.text) for r in docs], 1024)
    assert check_packing(found, 1024) <= 1.02 * sum(r.length for r in found) / 1024 + 1


def test_one_hot_length_and_empty_table(spark):
    many = spark.range(5000).selectExpr("id AS doc_id", "'' AS text")
    found = slack.pack(many).collect()
    assert len(found) == 5000 and check_packing(found, 1024) == 5
    assert slack.pack(many.limit(0)).collect() == []


def test_fullest_combination_equals_exhaustive_search():
    rng = np.random.default_rng(5)
    for _ in range(60):
        items = rng.integers(1, 40, 9).tolist()
        room = int(rng.integers(1, 90))
        best = max(s for n in range(10) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)
        taken = slack.fullest(Counter(items), room)
        assert sum(w * n for w, n in taken.items()) == best and not taken - Counter(items)


def test_plan_uses_every_piece_and_beats_neither_bound():
    rng = np.random.default_rng(6)
    for low, high in ((1, 1025), (1, 30), (300, 800), (513, 1025)):
        counts = Counter(rng.integers(low, high, 20_000).tolist())
        used, bins = Counter(), 0
        for taken, times in slack.minimum_slack(counts, 1024):
            assert sum(w * n for w, n in taken.items()) <= 1024
            bins += times
            for w, n in taken.items():
                used[w] += n * times
        assert used == counts
        least = max(-(-sum(w * n for w, n in counts.items()) // 1024), sum(n for w, n in counts.items() if w > 512))
        assert bins <= least * 1.1
