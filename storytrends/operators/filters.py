"""Row filters and splits of stories, posts and pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import title_tokens
from ..functions.web import canonical_url, main_text, meta_content, page_title, url_eligible
from ..sources.stories import timestamp_like
from .rows import with_computed


def flatten_items(stories: DataFrame) -> DataFrame:
    """Nested stories as flat rows; the title of the page is ``page_title``."""
    page = ("metaDescription", "metaKeywords", "cleanedText", "finalUrl", "topImage")
    post = (
        "title", "url", "author", "points", "story_text", "num_comments", "created_at_i", "objectID",
    )
    return stories.select(
        F.col("webpage.title").alias("page_title"),
        *(F.col(f"webpage.{c}") for c in page),
        *(F.col(f"HNItem.{c}") for c in post),
    )


def nonempty_text(df: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    return df.filter(F.col(text) != "").select(id, text)


def titles_nonempty(df: DataFrame, id: str = "id", title: str = "title") -> DataFrame:
    """``id, words`` of titles that leave at least one token."""
    titled = with_computed(df.filter(F.col(title) != ""), "words", title_tokens(F.col(title)))
    return titled.filter(F.size("words") > 0).select(id, "words")


def stories_only(df: DataFrame, col: str = "type", keep: str = "story") -> DataFrame:
    return df.filter(F.col(col) == keep)


def day_window(
    df: DataFrame, ts: str, start: str, end: str | None = None, open_ends: bool = False
) -> DataFrame:
    """Rows of the days ``start`` to ``end``, as a range on ``ts`` that reaches the scan.

    With ``open_ends`` the bounds count in whole seconds and are left out themselves:
    rows in the first and in the last second of the window are lost.
    """
    first = dt.datetime.fromisoformat(start)
    after = dt.datetime.fromisoformat(end or start) + dt.timedelta(days=1)
    if open_ends:
        first += dt.timedelta(seconds=1)
        after -= dt.timedelta(seconds=1)
    return df.filter(
        (F.col(ts) >= timestamp_like(df, ts, str(first)))
        & (F.col(ts) < timestamp_like(df, ts, str(after)))
    )


def post_kind_counts(
    df: DataFrame, story_text: str = "story_text", url: str = "url"
) -> DataFrame:
    kind = F.when(F.col(story_text) != "", "text").when(F.col(url) != "", "link")
    return df.groupBy(kind.otherwise("none").alias("kind")).agg(F.count("*").alias("n"))


def webpage_extract(
    pages: DataFrame,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_words: int = 5,
    more: tuple[str, ...] = (),
) -> DataFrame:
    """The six text columns of a page, all empty where the page was not fetched, and columns ``more``."""
    source = F.when(url_eligible(F.col(url)), F.coalesce(F.col(html), F.lit(""))).otherwise("")
    final = F.coalesce(F.nullif(canonical_url(source), F.lit("")), F.col(url))
    return pages.select(
        id,
        page_title(source).alias("title"),
        meta_content(source, "name", "description").alias("metaDescription"),
        meta_content(source, "name", "keywords").alias("metaKeywords"),
        main_text(source, min_words).alias("cleanedText"),
        F.when(source != "", final).otherwise("").alias("finalUrl"),
        meta_content(source, "property", "og:image").alias("topImage"),
        *more,
    )


OUTCOMES = ("skipped_url", "failed_get", "failed_read", "empty_extract", "success")


def page_outcome(url: Column, html: Column, text: Column) -> Column:
    """What became of a page: a null page was not got, an empty one not read."""
    return (
        F.when(~url_eligible(url), "skipped_url")
        .when(html.isNull(), "failed_get")
        .when(html == "", "failed_read")
        .when(text == "", "empty_extract")
        .otherwise("success")
    )


def extract_outcomes(
    pages: DataFrame, url: str = "url", html: str = "html", min_words: int = 5
) -> DataFrame:
    """Pages by outcome."""
    outcome = page_outcome(F.col(url), F.col(html), main_text(F.col(html), min_words))
    return pages.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def observe_outcomes(df: DataFrame, outcome: str, observation: Observation) -> DataFrame:
    """``df`` as it is; the first action on it also counts the outcomes, nulls aside."""
    counts = (F.count(F.when(F.col(outcome) == name, 1)).alias(name) for name in OUTCOMES)
    return df.observe(observation, *counts)


def observed_outcomes(spark: SparkSession, observation: Observation) -> DataFrame:
    """``outcome, n`` of an observation, outcomes that did not occur left out."""
    rows = [(name, n) for name, n in observation.get.items() if n]
    return spark.createDataFrame(rows, "outcome string, n long")
