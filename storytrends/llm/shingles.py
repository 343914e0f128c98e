"""Word hashes and word shingles of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np

WORDS = 5
PRIME = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word (bytes between white space) of a text."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.flatnonzero(~blank)
    if not len(inside):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.append(True, np.diff(inside) > 1))
    place = (np.arange(len(inside)) - np.repeat(starts, np.diff(np.append(starts, len(inside))))).astype(np.uint64)
    mixed = (data[inside].astype(np.uint64) + np.uint64(1)) * PRIME ^ (place + np.uint64(1)) * OTHER
    mixed = (mixed ^ (mixed >> np.uint64(29))) * PRIME
    return np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``words`` words, in order; a shorter text is one run, a blank one none."""
    hashes = word_hashes(np.frombuffer((text or "").encode(), np.uint8))
    if not len(hashes):
        return hashes
    words = min(words, len(hashes))
    total = np.full(len(hashes) - words + 1, words, np.uint64)
    for n in range(words):
        total = mix(total * PRIME + hashes[n : len(hashes) - words + 1 + n])
    return total


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets without repeats."""
    if not len(a) or not len(b):
        return 0.0
    small, big = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(big, small), len(big) - 1)
    common = int(np.count_nonzero(big[at] == small))
    return common / (len(a) + len(b) - common)
