"""Suffix sorting of many short groups at once by the deep-shallow method.

Suffixes are compared on their first LENGTH bytes. A multikey quicksort, eight bytes to a
character, runs to a shallow depth; suffixes left alone there are done. The groups that
still hold long common prefixes go to blind tries: of each group only the depth of its
first branching is found, its members split by the byte there, and the bytes before are
never sorted. All groups take a step together, so the work is done in numpy.
"""

from __future__ import annotations

import numpy as np

from .anchors import LENGTH

#: Characters of eight bytes that the multikey quicksort looks at.
SHALLOW = 4


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for n in range(8):
        out = out << np.uint64(8) | padded[n : n + len(data)]
    return out


def regroup(group: np.ndarray, character: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split groups by a character: (new group, members) sorted, without those left alone."""
    if not len(members):
        return group, members
    order = np.lexsort((character, group))
    group, character, members = group[order], character[order], members[order]
    new = np.append(True, (group[1:] != group[:-1]) | (character[1:] != character[:-1]))
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    return number[shared], members[shared]


def equal_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(group, index into ``starts``) of the suffixes that equal another one of their group.

    Every suffix must have ``length`` bytes in ``data``. Suffixes of one returned group have
    equal first ``length`` bytes.
    """
    word = words_of(data)
    members = np.arange(len(starts))
    for depth in range(min(SHALLOW, length // 8)):
        group, members = regroup(group, word[starts[members] + 8 * depth], members)
    done_group, done_members, found = [], [], 0
    depths = [*range(8 * SHALLOW, length - 7, 8), length - 8]
    while len(members):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(first, len(group)))
        head = np.repeat(members[first], sizes)
        common = np.full(len(members), length)
        open_rows = np.arange(len(members))
        for depth in depths:
            a, b = word[starts[members[open_rows]] + depth], word[starts[head[open_rows]] + depth]
            apart = a != b
            if apart.any():
                rows = open_rows[apart]
                differ = a[apart] ^ b[apart]
                zeros = np.zeros(len(differ), np.int64)
                for shift in (32, 16, 8):  # leading zero bytes
                    small = differ >> np.uint64(64 - shift) == 0
                    zeros += np.where(small, shift // 8, 0)
                    differ = np.where(small, differ << np.uint64(shift), differ)
                common[rows] = np.minimum(depth + zeros, length)
                open_rows = open_rows[~apart]
            if not len(open_rows):
                break
        branch = np.minimum.reduceat(common, first)
        equal = branch >= length
        rows = np.repeat(equal, sizes)
        done_group.append(np.repeat(np.arange(len(first)), sizes)[rows] + found)
        done_members.append(members[rows])
        found += len(first)
        rows = ~rows
        at = np.repeat(branch, sizes)[rows]
        group, members = regroup(group[rows], data[starts[members[rows]] + at], members[rows]) if rows.any() else (group[rows], members[rows])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *done_group]), np.concatenate([none, *done_members])
