"""Article text by scored blocks, and outcomes counted while pages are written."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from storytrends.functions.web import MAX_DEPTH, main_text
from storytrends.operators import filters as fl

TEXT = "This paragraph has some words that are worth reading"


def texts(spark, pages, min_words=5):
    frame = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    rows = frame.select("id", main_text(F.col("html"), min_words).alias("text")).collect()
    return [r.text for r in sorted(rows)]


def paragraphs(n, name="p"):
    return "".join(f"<p>{TEXT} {name}{i}.</p>" for i in range(n))


def lines(n, name="p"):
    return "\n".join(f"{TEXT} {name}{i}." for i in range(n))


def test_best_container_is_kept(spark):
    pages = [
        f"<div>{paragraphs(1, 'side')}</div><div>{paragraphs(4)}</div><div>{paragraphs(2, 'low')}</div>",
        f"<body>{paragraphs(1, 'out')}<article><h1>A title of five words</h1>{paragraphs(3)}</article></body>",
        f"<div><div>{paragraphs(2)}</div><div>{paragraphs(2, 'q')}</div></div>",
        paragraphs(2),
    ]
    found = texts(spark, pages)
    assert found[0] == lines(4)
    assert found[1] == f"A title of five words\n{lines(3)}"
    assert found[2] == f"{lines(2)}\n{lines(2, 'q')}"  # equal halves go to the container of both
    assert found[3] == lines(2)


def test_nested_equal_tags_close_rightly(spark):
    menu = "<ul><li><ul><li>one entry of this menu here</li></ul></li><li>two entry of this menu here</li></ul>"
    pages = [
        f"<nav>{menu}<nav>{menu}</nav>{menu}</nav><div>{paragraphs(2)}</div>",
        f"<div class=a><div class=b><div>{paragraphs(1)}</div></div>{paragraphs(2, 'x')}</div><div>{paragraphs(1, 'far')}</div>",
        f"<DIV>{paragraphs(2)}</Div ><aside><div><div>{paragraphs(5, 'note')}</div></div>{paragraphs(1, 'note')}</aside>",
        f"<div>{paragraphs(2)}<ul><li>an item of the list here<ul><li>an inner item of the list</li></ul></li></ul></div>",
    ]
    found = texts(spark, pages)
    assert found[0] == lines(2)
    assert found[1] == f"{lines(1)}\n{lines(2, 'x')}"
    assert found[2] == lines(2)
    assert found[3] == f"{lines(2)}\nan item of the list here\nan inner item of the list"


def test_unclosed_and_unmatched_tags(spark):
    pages = [
        f"<div></section></article></div></div><div>{paragraphs(2)}",
        f"<div><section>{paragraphs(2)}</div><div>{paragraphs(1, 'after')}</div>",
        f"<div><p>{TEXT} a<p>{TEXT} b<br>{TEXT} c</div>",
        f"<footer>{paragraphs(3)}",
    ]
    found = texts(spark, pages)
    assert found[0] == lines(2)
    assert found[1] == lines(2)
    assert found[2] == f"{TEXT} a\n{TEXT} b\n{TEXT} c"
    assert found[3] == ""


def test_links_raw_parts_entities_and_odd_pages(spark):
    links = "".join(f"<a href=x>{TEXT} link{i}</a> " for i in range(9))
    pages = [
        f"<div><p>{links}</p>{paragraphs(1)}</div>",
        f"<head><title>{TEXT}</title></head><script>if (a<b) '<div>{TEXT}'</script><!-- <div>{TEXT} -->{paragraphs(1)}",
        "<p>Tom &amp; &lt;Jerry&gt; &#65;&#x42; are &eacute; here now</p>",
        "<p>too few words</p>",
        "",
        None,
        "\x01\x02 \x03 control \x04 signs do no harm here \x01div\x02",
    ]
    found = texts(spark, pages)
    assert found[0] == lines(1) and found[1] == lines(1)
    assert found[2] == "Tom & <Jerry> AB are &eacute; here now"
    assert found[3:6] == ["", "", None]
    assert found[6] == "control signs do no harm here div"


def test_hostile_pages_take_time_in_proportion(spark):
    n = 30_000
    pages = ["<div>" * n + TEXT, "</div>" * n + TEXT, "<ul><li>" * (n // 2) + paragraphs(3), paragraphs(5_000), "<a " * n + '"', "<div" * n, "<!--" * n, "<title" * n]
    start = time.time()
    found = texts(spark, pages)
    assert time.time() - start < 40
    assert found[0] == found[1] == TEXT and found[2] == lines(3) and found[3] == lines(5_000)


def test_containers_beyond_the_depth_limit(spark):
    deep = "<div>" * (MAX_DEPTH + 20) + paragraphs(2) + "</div>" * (MAX_DEPTH + 20)
    assert texts(spark, [f"<body>{deep}<div>{paragraphs(1, 'far')}</div></body>"]) == [lines(2)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://x/1", f"<p>{TEXT}</p>"), (2, "http://x/2", "<p>short</p>"), (3, "http://x/3", None),
        (4, "http://x/4", ""), (5, "http://x/5.pdf", f"<p>{TEXT}</p>"), (6, "", None), (7, "http://x/7", f"<p>{TEXT}</p>"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_outcomes_are_observed_by_the_write(spark, pages, tmp_path):
    expected = {r.outcome: r.n for r in fl.extract_outcomes(pages).collect()}
    assert expected == {"success": 2, "empty_extract": 1, "failed_get": 1, "failed_read": 1, "skipped_url": 2}
    texts = fl.webpage_extract(pages, more=("url", "html"))
    seen = Observation("pages")
    marked = texts.select("page_id", "cleanedText", fl.page_outcome(F.col("url"), F.col("html"), F.col("cleanedText")).alias("outcome"))
    fl.observe_outcomes(marked, "outcome", seen).write.parquet(str(tmp_path / "texts"))
    assert {r.outcome: r.n for r in fl.observed_outcomes(spark, seen).collect()} == expected
