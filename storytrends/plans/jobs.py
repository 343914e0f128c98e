"""The jobs end to end: story files in, topics, clusters and scores out.

Every job writes new folders below ``out`` and reads them back for its next step, so
that a later step never repeats the text work of an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import sinks, sources
from ..functions.text import ascii_normalize, split_words, token_filter
from ..operators import em
from ..operators import models as mo
from ..operators import popularity as pop
from ..operators import similarity as si
from ..operators import skipgram
from ..operators import terms as te
from ..operators import topics as tp
from ..operators import explore as ex
from ..operators.explore import monthly_totals
from ..operators.filters import nonempty_text, observe_outcomes, observed_outcomes, page_outcome, titles_nonempty, webpage_extract
from ..operators.rows import array_rows
from ..schema import WEBPAGE
from ..sinks.page import keywords_json, scores_json

# The label words texts are classified by unless others are given.
LABELS = (
    "python", "golang", "ruby", "javascript", "c++", "scala", "java", "clojure", ".net", "php",
    "node.js", "hadoop",
)


def story_facts(stories: DataFrame) -> DataFrame:
    """The flat columns of the exploratory and popularity operators."""
    fields = ("created_at", "author", "points", "num_comments", "url", "title")
    return stories.select(
        F.col("HNItem.objectID").alias("story_id"), *(F.col(f"HNItem.{f}") for f in fields)
    )


def _titles(stories: DataFrame) -> DataFrame:
    posts = stories.select(F.col("HNItem.objectID").alias("id"), F.col("HNItem.title").alias("title"))
    return titles_nonempty(posts)


def _texts(stories: DataFrame) -> DataFrame:
    posts = stories.select(
        F.col("HNItem.objectID").alias("id"), F.col("webpage.cleanedText").alias("text")
    )
    return nonempty_text(posts)


def tokenize_job(
    spark: SparkSession,
    path: str,
    out: str,
    stop: Iterable[str] = (),
    dictionary: DataFrame | None = None,
    loose: bool = False,
) -> DataFrame:
    """Filtered words of all story texts, in base form if a dictionary is given.

    ``loose`` cuts the texts down to ASCII first and keeps words with other signs than letters.
    """
    text = ascii_normalize(F.col("text")) if loose else F.col("text")
    words = _texts(sources.read_stories(spark, path)).select("id", split_words(text).alias("words"))
    if dictionary is not None:
        words = te.term_normalize(words, "id", "words", dictionary)
    kept = words.select("id", token_filter(F.col("words"), stop, letters_only=not loose).alias("words"))
    sinks.write_tokenized(kept, f"{out}/tokenized")
    return sources.read_tokenized(spark, f"{out}/tokenized")


def lda_job(
    spark: SparkSession,
    tokens: DataFrame,
    out: str,
    k: int = 50,
    max_iter: int = 50,
    drop_top: int = 100,
    words_per_topic: int = 20,
    optimizer: str = "em",
    seed: int = 1,
    info: dict | None = None,
    min_count: int = 1,
) -> None:
    """Topics of tokenized texts: ``topics``, ``clustering``, ``info`` and the model.

    ``info`` counts the texts fitted, the terms, and the texts left out since they have no
    term. ``em`` keeps all weights on the executors; ``online`` keeps the vocabulary on the
    driver once per topic, and ``min_count`` leaves rare terms out of it.
    """
    counts = te.count_terms(array_rows(tokens, "id", F.col("words"), "term"))
    vocab = te.vocabulary(counts, drop_top, min_count)
    vectors = mo.count_vectors(tokens, "id", "words", vocab)
    if optimizer == "em":
        fitted = em.em_fit(vectors, "id", k, max_iter, seed)
        topics, terms = em.em_topics(fitted, vocab, words_per_topic), fitted.terms
        distributions = em.em_distributions(fitted)
        em.save_topics(fitted, f"{out}/model")
    else:
        model = mo.lda_fit(vectors, k, max_iter, optimizer, seed)
        topics, terms = mo.lda_topics(model, vocab, words_per_topic), model.vocabSize()
        distributions = model.transform(vectors)
        sinks.save_model(model, f"{out}/model")
    sinks.write_topics(topics.select(F.col("topic").alias("topicId"), "word", "weight"), f"{out}/topics")
    kept = tp.topic_rows(tp.article_topics(distributions, "id", "topicDistribution", k))
    columns = (F.col("id").alias("objectID"), F.col("topic").alias("topicId"), "probability")
    sinks.write_clustering(kept.select(*columns), f"{out}/clustering")
    about = {"jobId": 1, "jobName": "lda", "description": "", **(info or {})}
    sinks.write_job_info(spark, about | mo.fit_info(tokens, vectors, "id", k, terms, max_iter), f"{out}/info")


def word2vec_job(spark: SparkSession, path: str, model_path: str, **options) -> None:
    """Word vectors trained on all titles and all sentences of the texts."""
    stories = sources.read_stories(spark, path)
    sentences = mo.training_sentences(_titles(stories), _texts(stories))
    sinks.write_word_vectors(skipgram.vectors_fit(sentences, **options), model_path)


def kmeans_job(
    spark: SparkSession,
    path: str,
    model_path: str,
    out: str,
    k: int = 1000,
    max_iter: int = 25,
    words_per_topic: int = 10,
    seed: int = 1,
) -> None:
    """Clusters of title vectors: ``clustering`` and ``topics``, their nearest words."""
    words = sources.read_word_vectors(spark, model_path)
    vectors = si.title_vectors(_titles(sources.read_stories(spark, path)), words)
    vectors.write.mode("errorifexists").parquet(f"{out}/vectors")
    vectors = spark.read.parquet(f"{out}/vectors")
    model = mo.kmeans_fit(vectors, k, max_iter, seed)
    members = mo.cluster_members(model, vectors)
    columns = (F.col("id").alias("objectID"), F.col("cluster").alias("topicId"))
    sinks.write_clustering(members.select(*columns), f"{out}/clustering")
    centres = mo.cluster_centres(model, spark)
    near = si.nearest_words(centres, words, words_per_topic, query="cluster")
    columns = (F.col("query").alias("topicId"), "word", F.col("score").alias("weight"))
    sinks.write_topics(near.select(*columns), f"{out}/topics")


def classify_job(
    spark: SparkSession,
    path: str,
    model_path: str,
    out: str,
    labels: Iterable[str] = LABELS,
    synonyms: int = 20,
) -> list[str]:
    """The nearest label word of each title, and ``synonyms`` of each label below ``out``_synonyms.

    Titles without a known word have no label. Returns the labels that the model lacks.
    """
    labels = list(labels)
    words = sources.read_word_vectors(spark, model_path)
    known = si.label_vectors(words, labels)
    vectors = si.title_vectors(_titles(sources.read_stories(spark, path)), words)
    si.classify_nearest_label(vectors, known).write.mode("errorifexists").parquet(out)
    near = si.nearest_words(known.withColumnRenamed("label", "query"), words, synonyms, exclude_self=True)
    near.write.mode("errorifexists").parquet(f"{out}_synonyms")
    return si.unknown_labels(words, labels)


def topic_report_job(spark: SparkSession, path: str, topics: str, clustering: str, out: str, words: int = 10) -> None:
    """The two reports of a topic job: the topic matrix, and each title with its topics."""
    listed = sources.read_topic_words(spark, topics).withColumnRenamed("topicId", "topic")
    sinks.write_lines(tp.topic_matrix(listed, words).select("block"), f"{out}/matrix")
    given = spark.read.parquet(clustering).select(
        F.col("objectID").alias("id"), F.col("topicId").alias("topic"), "probability"
    )
    stories = sources.read_stories(spark, path)
    posts = stories.select(F.col("HNItem.objectID").alias("id"), F.col("HNItem.title").alias("title"))
    lines = tp.article_topic_lines(posts, given, listed.select("topic").distinct().count())
    sinks.write_lines(lines.select("line"), f"{out}/titles")


def export_job(spark: SparkSession, path: str, url: str, table: str, **options) -> None:
    """All stories as rows of a relational table."""
    sinks.write_jdbc(sinks.article_export(sources.read_stories(spark, path)), url, table, **options)


def pages_job(spark: SparkSession, posts: DataFrame, pages: DataFrame, out: str) -> None:
    """Day files of ``posts`` (objectID and the other post columns) with the text of their pages.

    ``pages`` has one row ``objectID, html`` per page that was asked for; a post without
    one has empty page columns. The outcomes of the pages are counted in ``outcomes``.
    """
    asked = pages.select("objectID", "html", F.lit(True).alias("asked"))
    both = posts.select("objectID", "url", F.struct(*posts.columns).alias("HNItem")).join(asked, "objectID", "left")
    texts = webpage_extract(both, "objectID", more=("HNItem", "asked", "html", "url"))
    outcome = F.when(F.col("asked"), page_outcome(F.col("url"), F.col("html"), F.col("cleanedText"))).alias("outcome")
    page = F.struct(*(F.coalesce(f.name, F.lit("")).alias(f.name) for f in WEBPAGE.fields)).alias("webpage")
    # The writer runs this part of the plan once, so every page is parsed once and counted there.
    seen = Observation("outcomes")
    counted = observe_outcomes(texts.select(page, "HNItem", outcome), "outcome", seen)
    sinks.write_daily(counted.select("webpage", "HNItem"), f"{out}/days")
    observed_outcomes(spark, seen).write.mode("errorifexists").parquet(f"{out}/outcomes")


def explore_job(spark: SparkSession, path: str, out: str, n: int = 10) -> None:
    """The exploratory tables: totals, histograms and rankings of authors, domains and stories."""
    story_facts(sources.read_stories(spark, path)).write.parquet(f"{out}/facts")
    facts = spark.read.parquet(f"{out}/facts")
    tables = {
        "totals": ex.overall_totals(facts),
        "months": ex.monthly_totals(facts),
        "days_without_stories": ex.days_without_stories(facts),
        "upvotes": ex.upvote_hist(facts),
        "top_stories": ex.top_stories(facts, min_points=0, n=n),
        "submitters": ex.top_submitters(facts, n=n),
        "domains": ex.domain_rank_table(facts, n),
    }
    for name, found in tables.items():
        found.write.mode("errorifexists").parquet(f"{out}/{name}")


def popularity_job(spark: SparkSession, path: str, clustering: str, topics: str, out: str) -> None:
    """Monthly scores of clusters: ``popularity`` and the two documents of the page."""
    story_facts(sources.read_stories(spark, path)).write.parquet(f"{out}/facts")
    facts = spark.read.parquet(f"{out}/facts")
    assigned = spark.read.parquet(clustering).select(
        F.col("objectID").alias("story_id"), F.col("topicId").alias("topic")
    )
    totals = monthly_totals(facts)
    found = pop.topic_popularity(facts, assigned, totals)
    found.write.mode("errorifexists").parquet(f"{out}/popularity")
    # The arrays are matched by month, so all have the months of all stories.
    months = pop.calendar(totals).join(totals, "month", "left").na.fill(0)
    dense = pop.topic_month_dense(spark.read.parquet(f"{out}/popularity"), totals)
    sinks.write_lines(scores_json(months, dense), f"{out}/scores")
    words = sources.read_topic_words(spark, topics).withColumnRenamed("topicId", "topic")
    sinks.write_lines(keywords_json(words), f"{out}/keywords")
