"""Rules, byte-pair encoding, page text and quality votes."""

from __future__ import annotations

import hashlib
import time
import zlib

import numpy as np
import pytest
from brute import DOCS, awkward_texts, doc_rows, rule_counts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storytrends.llm import bpe, html, quality, queries, rules

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = awkward_texts()
    return spark.createDataFrame(doc_rows(texts) + doc_rows(texts)[3:5], DOCS)


def test_rules_equal_brute_force(spark, docs, tables):
    for frame in (docs, spark.read.parquet(f"{tables}/documents.parquet")):
        texts = {r.doc_id: r.text for r in frame.collect()}
        found = rules.apply_rules(frame).select("doc_id", *COUNTS).collect()
        assert len(found) == frame.count()
        for row in found:
            assert tuple(row[1:]) == rule_counts(texts[row.doc_id])


def test_rules_judge_lines(spark):
    good = "\n".join(" ".join(f"{w}{i}" for w in "This sentence of a text reads quite well, and ends as it should".split()) + "." for i in range(8))
    menu = "\n".join(f"home{i} | news{i} | shop{i} | about us and more pages to see |" for i in range(8))
    rows = [
        (0, good),
        (1, menu),
        (2, f"{good}\nAll rights reserved."),
        (3, "\n".join(f"BUY!! THIS!! THING{i}!! NOW!! FOR!! LESS!! MONEY!!" for i in range(9))),
        (4, "\n".join(["again " * 30 + "."] * 3)),
    ]
    found = {r.doc_id: r for r in rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i].kept for i in range(5)] == [True, False, True, False, False]
    assert found[2].clean_text == good and found[2].lost_chars == len("All rights reserved.")


def test_rules_agree_with_labels_and_use_no_python(spark, tables):
    ruled = queries.op3_quality_rules(spark, tables)
    plan = ruled._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    labelled = ruled.join(spark.read.parquet(f"{tables}/labels.parquet"), "doc_id").filter("quality = 1 AND NOT base_failed")
    assert labelled.filter("NOT kept").count() == 0


def test_rules_filter_keeps_its_plan_small(spark, docs):
    plan = rules.apply_rules(docs).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000


def test_encoding_equals_the_library(spark, docs, tables):
    vocabulary = Tokenizer.from_file(bpe.vocabulary_path())
    odd = ["a\x1cb  ΣΑΣ <|endoftext|> x<|startoftext|>Y it's we'LL İstanbul ́ 12½Ⅷ 😀😀 aaaaaaa", " <|endoftext|", "  \x1c ", "don't'sx 's"]
    extra = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for frame in (docs, extra, spark.read.parquet(f"{tables}/documents.parquet").limit(60)):
        texts = {r.doc_id: r.text or "" for r in frame.collect()}
        found = bpe.encode_decode(frame).collect()
        assert len(found) == frame.count()
        for row in found:
            ids = vocabulary.encode(texts[row.doc_id], add_special_tokens=False).ids
            assert row.n_tokens == len(ids)
            assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            text = vocabulary.decode(ids, skip_special_tokens=False)
            assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encoding_forgets_without_changing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Vocabulary(bpe.vocabulary_path())
    first = [own.encode([t])[0].tolist() for t in ("hello there world", "other words here now", "hello there world")]
    assert first[0] == first[2]


PAGE = """<html><head><title>T</title><script>var a="</p><p>no";</script></head><body><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies, dear reader, on every page of this site.</div>
<article><header class="post-header"><h1>The &amp; title</h1></header><p>First&nbsp;part <b>bold<br>next.<p>Second
 part.<ul><li>one<li>two</ul><form>name <input></form><div class="share"><a>x</a></div>
<!-- gone --></article><section id="comments"><p>I read this with much interest, thank you very much.</p></section>
<aside>Other things</aside><footer>All rights</footer></body></html>"""


def test_page_text(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "plain words only", "x"), (4, "u", "<nav>menu</nav>", "x"), (5, "u", "<p>" * 3000 + "deep", "x"), (6, "u", "<p>cut <b", "x")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    texts = [(r.page_id, r.text) for r in found]
    assert texts[0][1] == "The & title\n\nFirst part bold next.\n\nSecond part.\n\none\n\ntwo"
    assert texts[1:] == [(2, ""), (3, ""), (4, "plain words only"), (4, ""), (5, "deep"), (6, "cut")]
    assert all(r.n_chars == len(r.text) for r in found)


def test_densest_subtree_without_names():
    links = "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(30))
    body = "".join(f"<p>Paragraph {i} has quite some words, so that its density is high enough.</p>" for i in range(9))
    page = f"<body><div><ul>{links}</ul></div><div><div>{body}<ul>{links}</ul></div></div></body>"
    assert html.main_text(page) == "\n\n".join(f"Paragraph {i} has quite some words, so that its density is high enough." for i in range(9))


@pytest.mark.parametrize("menu", ["", "<nav><a href=/a>Start</a> <a href=/b>Topics</a></nav>"])
@pytest.mark.parametrize("side", ["<p>Sunny today, with a light wind.</p>", "Sunny today, <p>with a light wind.</p> More at noon."])
def test_densest_subtree_of_link_free_content(menu, side):
    parts = [f"Paragraph {i} has quite some words, so that its density is high enough." for i in range(9)]
    block = f"<div>{side}</div>"
    body = "".join(f"<p>{p}</p>" for p in parts)
    assert html.main_text(f"<body>{menu}{block}<div>{body}</div>{block}</body>") == "\n\n".join(parts)
    direct = html.main_text(f"<body>{menu}{block}<div>{parts[0]}{body}</div>{block}</body>")
    assert direct == "\n\n".join([parts[0], *parts])


def test_page_query_equals_the_articles(spark, tables):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    for row in queries.op1_html_extraction(spark, tables).collect():
        inner = re.search(r"<article>(.*)</article>", pages[row.page_id], re.S).group(1)
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in re.split(r"</?p>|</?h1>", inner)]
        assert row.text == "\n\n".join(p for p in parts if p)


def test_quality_held_out_accuracy(spark, tables):
    root = tables.replace("sf0.001", "sf0.01")
    found = queries.op2_quality_classifier(spark, root).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").collect()
    fold = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert len(fold) > 50 and np.mean([r.predicted == r.quality for r in fold]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_quality_of_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert scored.count() == docs.count() and scored.filter("score IS NULL OR isnan(score)").count() == 0
    assert scored.drop("score", "predicted").columns == [c for c in docs.columns if c != "score"]
    empty = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}


def test_quality_brute_force_votes():
    rng = np.random.default_rng(0)
    rows = np.stack([quality.terms(" ".join(rng.choice(["ab", "C!!", "d.", "| e"], 30))) for _ in range(60)])
    labels = rng.integers(0, 2, 60)
    model = quality.fit_rows(rows, labels, 8)
    latent = model.latent(rows)
    for row, score in zip(latent[:20], model.score(rows[:20]), strict=True):
        cosine = latent @ row
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0) ** quality.SHARPNESS
        assert score == pytest.approx((weight * labels[near]).sum() / weight.sum(), rel=1e-3)


@pytest.mark.parametrize("run", [rules.apply_rules, bpe.encode_decode])
def test_empty_tables(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_fold_needs_no_label(docs):
    assert docs.select(quality.held_out().alias("h")).filter(F.col("h").isNull()).count() == 0


def test_hostile_pages_are_parsed_in_linear_time():
    """Half a megabyte of unmatched, unclosed or alternating tags each."""
    n = 60_000
    pages = ["<div>" * n + "text", "</b>" * n + "<div>" * n + "</i>" * n, "<b>" * n + "<p>x</p>" * n, "<b>" * n + "<li>x</li>" * n, "<div id=a>" * n]
    start = time.time()
    for page in pages:
        html.parse(page)
    assert time.time() - start < 20
