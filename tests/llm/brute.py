"""Plain Python versions of the operators, and small tables with awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, tie int"


def doc_rows(texts: list) -> list[tuple]:
    return [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "x", "y", 7) for i, t in enumerate(texts)]


def awkward_texts() -> list:
    words = [f"word{i % 97}{chr(97 + i % 26)}" for i in range(400)]
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
    line = "The same line of text stands here, and it is repeated as often as one likes to read it, and then again."
    return [
        None,
        "",
        "   \n\t ",
        "one",
        " ".join(words),
        " ".join(words),
        " ".join(words[:390] + ["changed"] + words[391:]),
        "\n".join([line] * 60),
        long,
        "word " * 3000,
        "é" * 130 + " ß 😀 " + "é" * 130,
        f"{line} {' '.join(words[50:90])} end.",
    ]


def components(nodes, edges) -> dict:
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text) -> set:
    w = WORD.findall(text or "")
    k = min(5, len(w))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()


def near_classes(rows, threshold=0.8) -> dict:
    sets = {i: shingle_set(t) for i, t in rows}
    holders = defaultdict(list)
    edges = []
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x])
        edges += [(i, j) for j, n in shared.items() if n / (len(s) + len(sets[j]) - n) >= threshold]
        for x in s:
            holders[x].append(i)
    return components(sets, edges)


def cut_repeats(rows, length=100) -> dict:
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            piece = data[s : s + length]
            if piece in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(piece)
        runs = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(data)))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def rule_counts(text) -> tuple:
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed
