"""Text and word-list functions, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_BREAK = "~~"
# The characters of the pattern \s.
WHITE_SPACE = " \t\n\x0b\f\r"

# Every run outside a-z, 0-9 and the dot. The ranges are listed, since Java takes several times
# as long to test the same class as ``[^a-z0-9.]``.
NOT_PLAIN = r"[\x00-\x2d/\x3a-\x60\x7b-\x{10FFFF}]+"

# Marks around the page part of a raw story line.
PAGE_START = '"webpage":"'
PAGE_END = '","HNItem"'

# Our own short suffix rules: plural, -ing, -ed.
SUFFIX_RULES = (
    (r"ies\z", "y"),
    (r"sses\z", "ss"),
    (r"([^s])s\z", "$1"),
    (r"(.{3})ing\z", "$1"),
    (r"(.{3})ed\z", "$1"),
)


def text_clean(c: Column) -> Column:
    """Spell out escaped white space as blanks, squeeze runs, drop ``\\u`` and quotes."""
    c = F.regexp_replace(c, r"\\(?:n+|r+|t+)", " ")
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.replace(c, F.lit("\\u"), F.lit(""))
    return F.regexp_replace(c, r'\\?"', "")


def article_cut(c: Column) -> Column:
    """The cleaned page part of a raw line, or the cleaned line if it has none."""
    start = F.instr(c, PAGE_START)
    rest = c.substr(start + len(PAGE_START), F.length(c))
    page = F.substring_index(F.substring_index(rest, PAGE_START, 1), PAGE_END, 1)
    return text_clean(F.when((start > 0) & (rest != ""), page).otherwise(c))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _split_text(text: Column, pattern: str) -> Column:
    """``text`` cut at a white-space pattern without trailing empty parts."""
    kept = F.rtrim(text, F.lit(WHITE_SPACE))
    blank = (kept == "") & (text != "")
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(kept, pattern))


def split_words(c: Column) -> Column:
    """Lower-case words cut at every single white-space character.

    Runs of white space give inner empty words; trailing ones are dropped.
    """
    return _let(F.lower(c), lambda text: _split_text(text, r"\s"))


def _drop_trailing_empty(parts: Column) -> Column:
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return F.when(F.size(parts) == 1, parts).otherwise(F.slice(parts, F.lit(1), last))


def _sentence_words(sentence: Column) -> Column:
    bare = F.regexp_replace(sentence, r'[\[\]“”():,‘’"]', "")
    words = _let(bare, lambda text: _split_text(text, r"\s+"))
    return F.filter(words, lambda w: w.rlike(r"\p{L}|^\p{Nd}*\z"))


def sentences(c: Column) -> Column:
    """Sentences as word lists: words with a letter, whole numbers and empty words stay."""
    marked = F.regexp_replace(F.lower(c), r"[.?!]\s+", SENTENCE_BREAK)
    marked = F.regexp_replace(marked, r"[.?!]\z", "")
    parts = _let(F.split(marked, SENTENCE_BREAK), _drop_trailing_empty)
    return F.transform(parts, _sentence_words)


def title_tokens(c: Column) -> Column:
    return F.flatten(sentences(c))


def ascii_normalize(c: Column) -> Column:
    """Lower case; every run outside a-z, 0-9 and the dot becomes one blank."""
    return F.regexp_replace(F.lower(c), NOT_PLAIN, " ")


def _kept_word(word: Column, stop: list[str], min_len: int, letters_only: bool) -> Column:
    keep = F.length(word) >= min_len
    if letters_only:
        keep = keep & word.rlike(r"^\p{L}+\z")
    return keep & ~word.isin(stop) if stop else keep


def token_filter(
    words: Column, stop: Iterable[str] = (), min_len: int = 4, letters_only: bool = True
) -> Column:
    """Drop short words, words with non-letters and stop words.

    The stop list becomes a literal set, so each word costs one hash lookup.
    """
    stop = sorted({s.lower() for s in stop})
    return F.filter(
        F.transform(words, F.lower), lambda w: _kept_word(w, stop, min_len, letters_only)
    )


def suffix_base(word: Column) -> Column:
    """``word`` without the ending that the suffix rules take off."""
    base = word
    for pattern, replacement in SUFFIX_RULES:
        base = F.regexp_replace(base, pattern, replacement)
    return F.when(word.rlike(r"(?:s|ing|ed)\z"), base).otherwise(word)


def words_to_text(words: Column) -> Column:
    return F.array_join(words, " ")


def text_to_words(c: Column) -> Column:
    """Words of blank-separated text; a blank text has none."""
    text = F.trim(c)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\s+"))
