"""Anchors of fixed-length byte strings: content-chosen places that equal strings share.

The anchor of a string of LENGTH bytes is the place of its smallest GRAM-byte hash, the
leftmost of equal ones. Equal strings have equal anchors, so strings need to be compared
only with those around equal anchors. Neighbouring strings mostly share one anchor.
"""

from __future__ import annotations

import numpy as np

from .shingles import OTHER, PRIME, mix

LENGTH = 100
GRAM = 24
#: Bytes handled at once; a place within them fits the low bits of a key.
SEGMENT = 1 << 19
PLACE_BITS = np.uint64(20)
PLACE = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all ``gram``-byte strings, built from those of half the length."""
    parts: dict[int, np.ndarray] = {1: (data.astype(np.uint64) + np.uint64(1)) * PRIME}
    size = 1
    while size * 2 <= gram:
        half = parts[size]
        joined = half[:-size] * OTHER + (half[size:] ^ (half[size:] >> np.uint64(31)))
        parts[size * 2] = joined * PRIME
        size *= 2
    out, at = None, 0
    for size in sorted(parts, reverse=True):
        if gram & size:
            count = len(data) - gram + 1
            piece = parts[size][at : at + count]
            out = piece if out is None else mix(out * OTHER + piece)
            at += size
    return mix(out)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every ``width`` neighbours."""
    least, size = keys, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last): each anchor, where it lies, and the starts of its strings.

    A start belongs to one entry; entries come in order of their starts. Texts shorter
    than ``length`` have none.
    """
    hashes, places, firsts, lasts = [], [], [], []
    for base in range(0, max(len(data) - length + 1, 0), SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        found = gram_hashes(part, gram)
        keys = (found & ~PLACE) | np.arange(len(found), dtype=np.uint64)
        place = (sliding_least(keys, length - gram + 1) & PLACE).astype(np.int64)
        cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        hashes.append(found[place[cut]])
        places.append(place[cut] + base)
        firsts.append(cut + base)
        lasts.append(np.append(cut[1:], len(place)) - 1 + base)
    if not hashes:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in (hashes, places, firsts, lasts))
