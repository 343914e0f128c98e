"""Operator 7: byte-pair encoding and decoding by batched merge rounds on flat numpy arrays.

White space never lies inside a piece of this vocabulary, so a text is the sequence of
its white-space-separated chunks. Each distinct chunk of a batch is encoded once: it is
normalized and split into words, and the symbols of all new words lie in one flat array.
A round looks every adjacent pair up by binary search over the sorted pair keys, takes
each word's lowest rank, and merges it from left to right; words without a pair leave.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pattern of the vocabulary file that splits normalized text into words (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Chunks that one worker remembers; beyond it starts anew, which changes no result.
REMEMBERED = 600_000
NO_RANK = np.iinfo(np.int64).max


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte value, by the usual rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in signs):
        signs[b] = chr(256 + n)
    return [signs[b] for b in range(256)]


class Vocabulary:
    """Merge table and tokens of a vocabulary file with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, ids = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        signs = byte_characters()
        self.inner = np.array([ids[c] for c in signs], np.int64)
        self.last = np.array([ids[c + end] for c in signs], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([ids[p[side]] for p in pairs], np.int64) for side in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.sizes, self.flat, self.ends = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and the number of ids of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        finals = np.cumsum(size) - 1
        symbols[finals] = self.last[data[finals]]
        owner = np.repeat(np.arange(len(words)), size)
        done_owner, done_symbols, done_place = [], [], []
        place = np.arange(len(symbols))
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(found, self.ranks[at], NO_RANK), NO_RANK)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(owner)))
            low = np.repeat(least, lengths)
            hit = (rank == low) & (low != NO_RANK)
            # of overlapping hits (aaa) every second one counts, from the left
            if (hit[1:] & hit[:-1]).any():
                first = hit & ~np.append(False, hit[:-1])
                spot = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(first, spot, -1))
                hit &= (spot - run) % 2 == 0
            where = np.flatnonzero(hit)
            symbols[where] = self.made[at[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            over = np.repeat(least == NO_RANK, lengths)
            done_owner.append(owner[over])
            done_symbols.append(symbols[over])
            done_place.append(place[over])
            keep &= ~over
            symbols, owner, place = symbols[keep], owner[keep], place[keep]
        owner, symbols, place = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (done_owner, done_symbols, done_place))
        order = np.argsort(place, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(owner, minlength=len(words))

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks not seen so far and remember them."""
        # One capital sigma maps to one small sigma, whatever follows.
        small = [unicodedata.normalize("NFC", c).replace("Σ", "σ").lower() for c in chunks]
        words = [[c.encode()] if c.isalpha() else [w.encode() for w in WORDS.findall(c)] for c in small]
        distinct = list(dict.fromkeys(w for ws in words for w in ws))
        ids, counts = self.merge_words(distinct) if distinct else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        starts = np.cumsum(counts) - counts
        number = {w: i for i, w in enumerate(distinct)}
        use = np.fromiter((number[w] for ws in words for w in ws), np.int64)
        per_chunk = np.fromiter(map(len, words), np.int64, len(words))
        flat = ids[spans(starts[use], counts[use])]
        running = np.append(0, np.cumsum(counts[use]))
        bounds = np.append(0, np.cumsum(per_chunk))
        sizes = running[bounds[1:]] - running[bounds[:-1]]
        base = len(self.number)
        self.number.update((c, base + i) for i, c in enumerate(chunks))
        self.sizes = np.append(self.sizes, sizes)
        self.flat = np.append(self.flat, flat)
        self.ends = np.cumsum(self.sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and the number of ids of each text."""
        if len(self.number) > REMEMBERED:
            self.forget()
        chunks: list[str] = []
        per_text = np.empty(len(texts), np.int64)
        for n, text in enumerate(texts):
            before = len(chunks)
            if "<|" in text:
                for part in self.at_special.split(text):
                    if part in self.special:
                        chunks.append(part)
                    else:
                        chunks += split_space(part)
            else:
                chunks += split_space(text)
            per_text[n] = len(chunks) - before
        distinct = pa.array(chunks, pa.large_string()).dictionary_encode()
        number = self.number
        for name, i in self.special.items():
            if name not in number:
                number[name] = len(number)
                self.sizes, self.flat = np.append(self.sizes, 1), np.append(self.flat, np.uint32(i))
                self.ends = np.cumsum(self.sizes)
        values = distinct.dictionary.to_pylist()
        new = [c for c in values if c not in number]
        if new:
            self.learn(new)
        use = np.fromiter(map(number.__getitem__, values), np.int64, len(values))[distinct.indices.to_numpy()]
        sizes = self.sizes[use]
        flat = self.flat[spans(self.ends[use] - sizes, sizes)]
        running = np.append(0, np.cumsum(sizes))
        bounds = np.append(0, np.cumsum(per_text))
        return flat, running[bounds[1:]] - running[bounds[:-1]]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def split_space(text: str) -> list[str]:
    """Chunks between white space; the four separators 1C to 1F are not white space here."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return regex.split(r"[\s--[\x1c-\x1f]]+", text.strip(" \t\n\r"), flags=regex.V1)
    return text.split()


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all ranges [start, start + size), one after another."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(batch_texts: pa.ChunkedArray | pa.Array, path: str, text_bytes: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of every text of a column, encoded in groups of about ``text_bytes``."""
    vocab, group, first, held = vocabulary(path), [], 0, 0
    for row, text in enumerate(batch_texts):
        value = text.as_py() or ""
        group.append(value)
        held += len(value)
        if held >= text_bytes or row == len(batch_texts) - 1:
            flat, counts = vocab.encode(group)
            ends = np.cumsum(counts)
            for n, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                yield first + n, flat[end - count : end]
            group, first, held = [], row + 1, 0


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text.

    A null or empty text has no ids and decodes to the empty text. Rows are independent:
    repeated rows and ids give repeated rows; only doc_id and text are read.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            rows = []
            for _, ids in encoded(batch.column(1), path):
                text = vocab.decode(ids).encode()
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
