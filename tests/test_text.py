from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from storytrends.functions import text as tx
from storytrends.functions import web
from storytrends.operators import filters as fl
from storytrends.operators import terms as te
from storytrends.sources import stop_words


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    rows = df.select("i", fn(F.col("c")).alias("r")).orderBy("i").collect()
    return [row["r"] for row in rows]


def test_split_words_keeps_inner_and_drops_trailing_empty_words(spark):
    given = ["A  b\tC ", "", "   ", " x", "one\n\n"]
    assert apply(spark, given, tx.split_words) == [["a", "", "b", "c"], [""], [], ["", "x"], ["one"]]


def test_sentences(spark):
    given = [
        'He said: "Hi, you!" Then (he) left.',
        "",
        "... ",
        "Version 2.0 is out! 42 + 1",
        " lead. next",
        "Why?  Because.",
        "a.  b? ",
        "x~~~y",
    ]
    assert apply(spark, given, tx.sentences) == [
        [["he", "said", "hi", "you!", "then", "he", "left"]],
        [[""]],
        # The break swallows the last dot, and only the two dots before it are left.
        [[]],
        [["version", "is", "out"], ["42", "1"]],
        [["", "lead"], ["next"]],
        [["why"], ["because"]],
        [["a"], ["b"]],
        [["x"], ["~y"]],
    ]


def test_title_tokens_are_flat(spark):
    assert apply(spark, ["Farewell Node.js. Hello?"], tx.title_tokens) == [
        ["farewell", "node.js", "hello"]
    ]


def test_text_clean(spark):
    given = ['a\\nnb\\r\\tc  d\n e \\u201c "q" \\"r\\"', "plain"]
    assert apply(spark, given, tx.text_clean) == ["a b c d e 201c q r", "plain"]


def test_article_cut(spark):
    given = [
        '{"webpage":"Some \\"text\\"","HNItem":{"objectID":1}}',
        "no marks here",
        'x"webpage":"tail',
        'x"webpage":"',
    ]
    expected = ["Some text", "no marks here", "tail", "xwebpage:"]
    assert apply(spark, given, tx.article_cut) == expected


def test_ascii_normalize_breaks_accents(spark):
    assert apply(spark, ["Éa-b.c  D!"], tx.ascii_normalize) == [" a b.c d "]


def test_ascii_normalize_replaces_every_other_character(spark):
    points = [p for p in [*range(0x3000), *range(0xD7F0, 0xE010), *range(0xFFF0, 0x10010), 0x1F600, 0x10FFFF] if not 0xD800 <= p < 0xE000]
    texts = [f"x{chr(p)}{chr(p)}y" for p in points]
    lowered = apply(spark, texts, F.lower)
    assert apply(spark, texts, tx.ascii_normalize) == [re.sub(r"[^a-z0-9.]+", " ", text) for text in lowered]


def test_ascii_normalize_is_faster_than_a_negated_class(spark):
    """Seconds of the pattern against those of the same class written as a negation (a quarter or less)."""
    text = F.repeat(F.lit("Some words, and a few more: 12.5 of them\n"), 1000)
    texts = spark.range(0, 400, 1, 4).select(F.concat(F.col("id").cast("string"), text).alias("text"))

    def seconds(plain):
        start = time.monotonic()
        texts.select(F.sum(F.length(plain))).collect()
        return time.monotonic() - start

    negated = F.regexp_replace(F.lower("text"), r"[^a-z0-9.]+", " ")
    best = [min(seconds(plain) for _ in range(3)) for plain in (tx.ascii_normalize(F.col("text")), negated)]
    assert best[0] < 0.7 * best[1]


def test_token_filter(spark):
    df = spark.createDataFrame([(["The", "WOULD", "tree", "b2b4", "über", "abc", "é1234", ""],)], "w array<string>")
    strict = tx.token_filter(F.col("w"), ["would"])
    loose = tx.token_filter(F.col("w"), ["would"], letters_only=False)
    row = df.select(strict.alias("s"), loose.alias("l")).first()
    assert row["s"] == ["tree", "über"]
    assert row["l"] == ["tree", "b2b4", "über", "é1234"]


def test_text_to_words_has_no_leading_empty_word(spark):
    assert apply(spark, [" a b ", "  ", ""], tx.text_to_words) == [["a", "b"], [], []]


def test_stop_words_of_a_file_and_of_spark(spark, tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text("would\nthe\nWould\n\n it's \n")
    assert {r.word for r in stop_words(spark, str(path)).collect()} == {"would", "the", "it's"}
    assert stop_words(spark).filter("word = 'the'").count() == 1


def test_hosts(spark):
    given = ["http://www.a.com/x", "https://en.b.org:80/?q=1", "ftp://c", "", "not a url", "http://WWW2.d.de"]
    found = apply(spark, given, web.host)
    assert found[:3] == ["a.com", "en.b.org", "c"] and found[3] is None


def test_url_eligible_is_case_sensitive(spark):
    given = ["http://a/x.pdf", "http://a/x.PDF", "", "http://a/x.pdf?y"]
    assert apply(spark, given, web.url_eligible) == [False, True, False, True]


PAGE = """<html><head><title>A &amp; B</title>
<meta name="description" content="Short &quot;text&quot;"><meta name='keywords' content='k1, k2'>
<meta property="og:image" content="http://i/1.png"><link rel="canonical" href="http://c/">
<script>var p = "<p>never shown in the text at all</p>";</script></head>
<body><nav><p>one two three four five six</p></nav><p>This block has <b>enough</b> words.</p>
<p>Too short.</p><div>And this block &lt;too&gt; has enough.</div><!-- <p>a b c d e f</p> --></body></html>"""


def test_webpage_extract(spark):
    pages = spark.createDataFrame(
        [(1, "http://x/", PAGE), (2, "http://x/a.pdf", PAGE), (3, "http://y/", None)],
        "page_id int, url string, html string",
    )
    one, two, three = (r.asDict() for r in fl.webpage_extract(pages).orderBy("page_id").collect())
    assert one == {
        "page_id": 1,
        "title": "A & B",
        "metaDescription": 'Short "text"',
        "metaKeywords": "k1, k2",
        "cleanedText": "This block has enough words.\nAnd this block <too> has enough.",
        "finalUrl": "http://c/",
        "topImage": "http://i/1.png",
    }
    assert set(two.values()) == {2, ""} and set(three.values()) == {3, ""}


def test_extract_outcomes(spark):
    rows = [("http://x", PAGE), ("", PAGE), ("a.pdf", PAGE), ("http://x", None), ("http://x", ""), ("http://x", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "url string, html string")
    found = {r.outcome: r.n for r in fl.extract_outcomes(pages).collect()}
    assert found == {"success": 1, "skipped_url": 2, "failed_get": 1, "failed_read": 1, "empty_extract": 1}


def test_titles_nonempty(spark):
    df = spark.createDataFrame([(1, "Hello you"), (2, ""), (3, "+ -")], "id int, title string")
    assert [(r.id, r.words) for r in fl.titles_nonempty(df).collect()] == [(1, ["hello", "you"])]


def test_day_window_ends(spark):
    times = ["2024-01-09 23:59:59", "2024-01-10 00:00:00", "2024-01-10 00:00:01", "2024-01-10 23:59:58",
             "2024-01-10 23:59:59", "2024-01-11 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    at = lambda d: sorted(str(r.ts) for r in d.collect())
    assert at(fl.day_window(df, "ts", "2024-01-10")) == times[1:5]
    assert at(fl.day_window(df, "ts", "2024-01-10", open_ends=True)) == times[2:4]


def test_post_kinds(spark):
    df = spark.createDataFrame([("t", "u"), ("", "u"), ("", "")], "story_text string, url string")
    assert {r.kind: r.n for r in fl.post_kind_counts(df).collect()} == {"text": 1, "link": 1, "none": 1}


def words_frame(spark):
    rows = [(1, ["running", "cats", "node"]), (2, []), (3, None), (4, ["node", "node", "buses"])]
    return spark.createDataFrame(rows, "id int, words array<string>")


@pytest.mark.parametrize("max_rows", [100, 0])
@pytest.mark.parametrize("rules", [tx.suffix_base, None])
def test_term_normalize_in_place_and_joined(spark, max_rows, rules):
    dictionary = spark.createDataFrame([("node", "knot"), ("cats", "feline")], "form string, base string")
    done = te.term_normalize(words_frame(spark), "id", "words", dictionary, rules, max_rows)
    found = {r.id: r.words for r in done.collect()}
    run, bus = ("runn", "buse") if rules else ("running", "buses")
    empty = {r.id: r.words for r in words_frame(spark).collect() if not r.words}
    assert found == {1: [run, "feline", "knot"], 4: ["knot", "knot", bus], **empty}


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_term_normalize_of_nulls_and_repeats(spark, max_rows):
    dictionary = spark.createDataFrame([("a", "x"), ("a", "b")], "form string, base string")
    rows = [(1, ["a", None]), (1, ["a"]), (2, None), (3, [])]
    done = te.term_normalize(spark.createDataFrame(rows, "id int, words array<string>"), "id", "words", dictionary, None, max_rows)
    assert sorted(((r.id, r.words) for r in done.collect()), key=str) == sorted([(1, ["b", None]), (1, ["b"]), (2, None), (3, [])], key=str)


@pytest.mark.parametrize("hot_terms", [0, 1, 1000])
def test_bag_of_words_of_repeated_ids(spark, hot_terms):
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "term string, idx long")
    rows = spark.createDataFrame([(1, ["a", "b", "b"]), (1, ["b"]), (2, None)], "id int, words array<string>")
    found = sorted(map(tuple, te.bag_of_words(rows, "id", "words", vocab, hot_terms).collect()))
    assert found == [(1, 0, 1), (1, 1, 1), (1, 1, 2)]


def terms_frame(spark):
    text = "b b b a a c c d e e e e"
    rows = [(i % 3, t) for i, t in enumerate(text.split())]
    return spark.createDataFrame(rows, "id int, term string"), text.split()


def test_vocabulary_order_and_trim(spark):
    terms, words = terms_frame(spark)
    counts = te.count_terms(terms)
    order = sorted(set(words), key=lambda w: (-words.count(w), w))
    assert [r.term for r in te.term_counts(terms).collect()] == order
    for drop in (0, 2, 5, 9):
        vocab = te.vocab_index(te.vocab_trimmed(counts, drop), partitions=3)
        found = [r.term for r in vocab.orderBy("idx").collect()]
        assert found == order[drop:]
        assert [r.idx for r in vocab.orderBy("idx").collect()] == list(range(len(found)))
    assert {r.term for r in te.vocab_trimmed(counts, 0, min_count=3).collect()} == {"b", "e"}


@pytest.mark.parametrize("hot_terms", [0, 2, 100])
def test_bag_of_words_with_hot_and_rare_terms(spark, hot_terms):
    terms, _ = terms_frame(spark)
    vocab = te.vocab_index(te.vocab_trimmed(te.count_terms(terms), 1))
    names = {r.idx: r.term for r in vocab.collect()}
    texts = terms.groupBy("id").agg(F.collect_list("term").alias("words"))
    bag = te.bag_of_words(texts, "id", "words", vocab, hot_terms)
    found = {(r.id, names[r.idx]): r.n for r in bag.collect()}
    expected = {(r.id, r.term): r["count"] for r in terms.groupBy("id", "term").count().collect() if r.term != "e"}
    assert found == expected


def test_suffix_rules(spark):
    given = ["cities", "classes", "cats", "glass", "running", "ring", "walked", "red", "tree"]
    expected = ["city", "class", "cat", "glass", "runn", "ring", "walk", "red", "tree"]
    assert apply(spark, given, tx.suffix_base) == expected


def test_white_space_matches_the_pattern():
    assert all(re.fullmatch(r"\s", c, re.ASCII) for c in tx.WHITE_SPACE)


def test_meta_tags_in_either_order_and_entities(spark):

    rows = [
        ("<meta name='description' content=\"it's &#233;t&#xE9; &amp;#39;\">",),
        ('<meta content="it\'s &#233;t&#xE9; &amp;#39;" data-x="1" name="description"/>',),
        ("<meta content='other' name='else'><p>",),
    ]
    page = spark.createDataFrame(rows, "html string")
    found = [r[0] for r in page.select(web.meta_content(F.col("html"), "name", "description")).collect()]
    assert found == ["it's été &#39;", "it's été &#39;", ""]
    link = spark.createDataFrame([("<link href='http://a/?x=1&amp;y=2' rel='canonical'>",)], "html string")
    assert link.select(web.canonical_url(F.col("html"))).first()[0] == "http://a/?x=1&y=2"
    odd = spark.createDataFrame([("&#1114112; &#xD800; &#0; &#128512; &mdash;",)], "t string")
    assert odd.select(web.unescape(F.col("t"))).first()[0] == "&#1114112; &#xD800; &#0; 😀 —"


def test_vocabulary_reads_the_texts_once(spark):
    counts = spark.createDataFrame([(f"t{i}", i % 7 + 1) for i in range(50)], "term string, n long")
    found = te.vocabulary(counts, 5, 3).orderBy("idx").collect()
    every = sorted(counts.collect(), key=lambda r: (-r.n, r.term))[5:]
    assert [(r.term, r.n, r.idx) for r in found] == [(r.term, r.n, i) for i, r in enumerate(r for r in every if r.n >= 3)]
    plan = te.vocab_trimmed(counts, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" not in plan


def test_dictionary_of_many_forms_stays_in_place(spark):
    """A dictionary larger than a batch, as titles of a large table give it, needs no shuffle of the words."""
    forms = spark.range(600_000).select(F.concat(F.lit("form"), "id").alias("form"), F.concat(F.lit("b"), "id").alias("base"))
    rows = [(1, ["form7", None, "other", "form7", "form599999"]), (2, None), (3, [])]
    texts = spark.createDataFrame(rows, "id int, words array<string>")
    done = te.term_normalize(texts, "id", "words", forms, None)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.words for r in done.collect()} == {1: ["b7", None, "other", "b7", "b599999"], 2: None, 3: []}
