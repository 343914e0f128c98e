"""Operator 3: line-first cleaning rules, by column functions only.

Rules look at one line at a time: does it hold a sentence, is it a menu, is it a
boilerplate notice, is it mostly marks, shouting or one word over and over. Lines that
fail are removed, and a document that loses too much of its text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storytrends.operators.rows import with_computed

#: White space of the word rule, and the marks that count as symbols (fixed values).
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Notices by their usual wording.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|licensed under|released under the|is licensed|copyright \(c\)|privacy policy"
    r"|terms of (use|service)|cookie (policy|settings)|accept cookies|enable javascript|subscribe to our|sign up for)\b|©"
)
MENU = r"\|[^|]*\||\s[»›>]\s.*\s[»›>]\s|^\s*(home|menu|next|previous|back|share|login|log in)\s*$|\|\s*$"
#: Doubled marks, or five words in capitals in a row.
SHOUT = r"!!|\?\?|(^|\s)(\p{Lu}{2,}[^\p{Ll}\s]*\s+){4}\p{Lu}{2,}"
SENTENCE = r"[.!?…。](\s|$|[\"'”’»)\]])|[:;]\s*$"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A document goes if more than this share of its line characters is removed.
LOST_SHARE = 0.5

ADDED = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "clean_text", "kept",
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def line_fails(line: Column) -> Column:
    """True if the line breaks one of the rules; a line without a word never does."""
    words = F.split(F.trim(line), r"[\x20\x09-\x0D]+")
    n, long = F.size(words), F.length(line)
    symbols = long - F.length(F.translate(line, SYMBOLS, ""))
    return (
        # punctuation: several words and no end of a sentence anywhere
        ((n >= 8) & ~line.rlike(SENTENCE))
        | (symbols * 10 > long)
        | line.rlike(SHOUT)
        # navigation
        | line.rlike(MENU)
        # boilerplate: notices, and one word over and over
        | line.rlike(BOILERPLATE)
        | ((n >= 10) & (F.size(F.array_distinct(words)) * 4 < n))
    )


def apply_rules(docs: DataFrame, lost_share: float = LOST_SHARE) -> DataFrame:
    """``docs`` with the counts, base_failed, kept, lost_chars and clean_text.

    A null or blank text has no words, fails the base rules and is not kept. Rows are
    independent, so ids may repeat; other columns pass through unread, and those named like
    an added one are replaced. Every step that is used twice is a column of its own, so
    that Spark evaluates it once.
    """
    docs = docs.drop(*ADDED, *[c for c in docs.columns if c.startswith("_r_")])
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_r_words", words_of(text)).withColumn("_r_lines", F.split(text, "\n", -1))
    i = F.col("_r_words")
    out = out.withColumn("n_words", F.size(i).cast("long"))
    # A window's hash and place in one long: sorting brings equal windows together.
    out = out.withColumn(
        "_r_packed",
        F.when(
            F.col("n_words") >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
                    lambda p: F.shiftleft(F.hash(F.get(i, p), F.get(i, p + 1), F.get(i, p + 2)).cast("long"), 32)
                    + p.cast("long"),
                )
            ),
        ).otherwise(F.array().cast("array<long>")),
    )
    packed = F.col("_r_packed")

    def hash_at(p: Column) -> Column:
        return F.shiftright(F.get(packed, p), 32)

    same = F.filter(
        packed,
        lambda x, p: F.coalesce(F.shiftright(x, 32) == hash_at(p - 1), F.lit(False))
        | F.coalesce(F.shiftright(x, 32) == hash_at(p + 1), F.lit(False)),
    )
    out = out.withColumn("_r_same", same)
    # Equal hashes are only candidates: the words themselves decide.
    place = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    out = out.withColumn(
        "_r_grams",
        F.sort_array(
            F.transform(
                F.col("_r_same"),
                lambda x: F.struct(
                    F.concat_ws(" ", F.get(i, place(x)), F.get(i, place(x) + 1), F.get(i, place(x) + 2)).alias("g"),
                    place(x).alias("p"),
                ),
            )
        ),
    )
    grams = F.col("_r_grams")
    twice = F.filter(
        grams,
        lambda x, p: F.coalesce(x["g"] == F.get(grams, p - 1)["g"], F.lit(False))
        | F.coalesce(x["g"] == F.get(grams, p + 1)["g"], F.lit(False)),
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))
    worded = F.filter(F.col("_r_lines"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_r_worded", worded).withColumn("n_repeat_words", F.size(covered).cast("long"))
    out = out.withColumn("_r_clean", F.filter(F.col("_r_lines"), lambda line: ~line_fails(line)))
    size = lambda lines: F.aggregate(lines, F.lit(0), lambda n, line: n + F.length(line))
    out = out.select(
        *docs.columns,
        "n_words",
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_r_worded") - F.size(F.array_distinct("_r_worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)).alias(
            "base_failed"
        ),
        size(F.col("_r_lines")).cast("long").alias("_r_all"),
        (size(F.col("_r_lines")) - size(F.col("_r_clean"))).cast("long").alias("lost_chars"),
        F.array_join("_r_clean", "\n").alias("clean_text"),
    )
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= F.col("_r_all") * lost_share)
    out = out.withColumn("kept", kept)
    # A filter on a verdict must not be pushed below the steps: it would repeat them all.
    whole = with_computed(out.select(*docs.columns, F.struct(*ADDED).alias("_r_found")), "_r_row", F.col("_r_found"))
    return whole.select(*docs.columns, "_r_row.*")
