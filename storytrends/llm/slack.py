"""Operator 13: packing of token sequences by minimum bin slack.

A document longer than a sequence is cut into full pieces, of which the first may be
shorter. Pieces are counted by length, a histogram of as many classes as a sequence has
tokens. On it one bin after another is filled: the longest length left is put in, and a
subset-sum dynamic program over bitsets finds the fullest combination of the lengths left
for the rest of the bin. The combination is taken as often as the counts allow, so the
number of steps follows the number of classes and not that of the documents. A piece's
rank within its length, which is its place in its task plus what earlier tasks hold, tells
its bin and place.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_characters, vocabulary_path
from .common import written

LENGTH = 1024
END_ID = 2
#: The pattern of byte-level vocabularies that splits text into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, at long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file; its ids rise with the rank of their merge."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    value = {sign: byte for byte, sign in enumerate(byte_characters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(value[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def plain(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of one text; runs of white space too long for the fast library go to the plain one."""
    try:
        return encoding(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(plain(path).encode(text, add_special_tokens=False).ids, np.uint32)


def token_pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece, with its task ``part`` and its place ``at`` among those of its length there."""
    path = path or vocabulary_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py() or "", path), END_ID).astype("<u4")
                first = len(ids) % length or length
                cuts = [0, *range(min(first, len(ids)), len(ids) + 1, length)]
                for piece, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), part, seen[end - start]))
                    seen[end - start] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            names = [f.split()[0] for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often each length is taken in the combination that leaves the least of ``room``.

    Bit s of a set tells whether some combination sums to s. Longer lengths come first, and
    of equally full combinations that with the longer ones is found.
    """
    bits, mask, steps = 1, (1 << room + 1) - 1, []
    for width in sorted((w for w in counts if w <= room), reverse=True):
        left, lot = min(counts[width], room // width), 1
        while left:
            lot = min(lot, left)
            steps.append((width, lot, bits))
            bits |= bits << width * lot & mask
            left, lot = left - lot, 2 * lot
        if bits >> room & 1:
            break
    total, taken = bits.bit_length() - 1, Counter()
    for width, lot, before in reversed(steps):
        if not before >> total & 1:
            taken[width] += lot
            total -= width * lot
    return taken


def minimum_slack(counts: dict[int, int], length: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how often each is packed, using up ``counts`` exactly.

    Bins are filled around the longest length left, and in a second plan freely; the plan
    of fewer bins counts.
    """
    plans = [filled(counts, length, seeded) for seeded in (True, False)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def filled(counts: dict[int, int], length: int, seeded: bool) -> list[tuple[dict[int, int], int]]:
    left, plan = {w: n for w, n in counts.items() if n}, []
    while left:
        if seeded:
            seed = max(left)
            left[seed] -= 1
            taken = Counter({seed: 1})
            taken.update(fullest(left, length - seed))
            left[seed] += 1
        else:
            taken = fullest(left, length)
        times = min(left[w] // n for w, n in taken.items())
        plan.append((dict(taken), times))
        for w, n in taken.items():
            left[w] -= n * times
            if not left[w]:
                del left[w]
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: first rank, pieces a sequence, first sequence and offset of each combination, in rank order."""
    given, first, rows = Counter(), 0, {}
    for taken, times in plan:
        offset = 0
        for width in sorted(taken, reverse=True):
            rows.setdefault(width, []).append((given[width], taken[width], first, offset))
            given[width] += taken[width] * times
            offset += width * taken[width]
        first += times
    return {w: np.array(r, np.int64) for w, r in rows.items()}


def place(ranked: DataFrame, by_length: dict[int, np.ndarray]) -> DataFrame:
    """Sequence and offset of every piece from its rank within its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    width = int(length[own[0]])
                    low, each, first, before = by_length[width].T
                    at = np.searchsorted(low, rank[own], "right") - 1
                    inside = rank[own] - low[at]
                    sequence[own] = first[at] + inside // each[at]
                    offset[own] = before[at] + inside % each[at] * width
            kept = [batch.column(n) for n in ("doc_id", "piece", "start")]
            columns = [*kept, pa.array(length.astype(np.int64)), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PLACED.split(", ")])

    return ranked.mapInArrow(run, PLACED)


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end token alone; a null doc_id stays null. Repeated rows are
    packed each for itself, and pieces of one length are taken in the order of the input. A
    special token written out in a text is that token. An empty table gives no rows. Extra
    columns are not read. The driver holds a count per length and the combinations, never
    more of them than the lengths allow.
    """
    pieces = written(token_pieces(docs, length, path), "pieces")
    held = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.join(held.select("length", "part", earlier.alias("before")), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("rank"))
    return place(ranked, slots(minimum_slack(counts, length)))
