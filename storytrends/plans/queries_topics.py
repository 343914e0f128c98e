"""Topic words, topics of articles and fitted models."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sinks
from ..functions.vectors import vec_norm
from ..operators import em
from ..operators import models as mo
from ..operators import skipgram
from ..operators import topics as tp
from ..operators.filters import titles_nonempty
from ..operators.terms import term_rows
from ..operators.similarity import nearest_centre
from ..schema import JOB_INFO
from ..session import SHUFFLES_DROPPED, scratch_path, settings
from ..sources import read_word_vectors, stop_words
from .queries_text import TITLES, TOKENIZED, VOCAB, sentences_sql, vocabulary
from .registry import on_corpus, query
from .views import STOP, article_topics, corpus, filtered_words, table, tokenized, vectors
from ..functions.text import split_words

_TOPIC_WORDS = f"""{TOKENIZED},
topic_words AS (SELECT lang AS topic, word, CAST(count(*) AS DOUBLE) AS weight FROM (
  SELECT lang, unnest(words) AS word FROM tokenized JOIN corpus USING (id)) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS rank
           FROM topic_words)"""


def _topic_words(spark, root):
    """Languages as topics, with the counts of their words as weights."""
    rows = term_rows(corpus(spark, root), "lang", split_words(F.col("text")), STOP)
    counted = rows.groupBy(F.col("lang").alias("topic"), F.col("term").alias("word"))
    return counted.agg(F.count("*").cast("double").alias("weight"))


@query(
    "topic_strings",
    f"WITH {_TOPIC_WORDS} SELECT topic, string_agg(word, ' ' ORDER BY rank) AS words "
    "FROM ranked WHERE rank <= 20 GROUP BY 1",
)
def topic_strings(spark, root):
    return tp.topic_strings(_topic_words(spark, root))


@query(
    "topic_matrix",
    f"""WITH {_TOPIC_WORDS} SELECT topic, 'TOPIC ' || topic || ':' || chr(10) ||
        string_agg(word || chr(9) || printf('%.6f', weight), chr(10) ORDER BY rank) || chr(10) AS block
        FROM ranked WHERE rank <= 10 GROUP BY 1""",
)
def topic_matrix(spark, root):
    return tp.topic_matrix(_topic_words(spark, root), 10, digits=6)


@query(
    "topic_keywords",
    f"""WITH {_TOPIC_WORDS} SELECT topic, CAST(to_json(list({{'w': word, 's': weight}} ORDER BY rank)) AS VARCHAR)
        AS kw FROM ranked WHERE rank <= 10 GROUP BY 1""",
)
def topic_keywords(spark, root):
    words = tp.topic_keywords(_topic_words(spark, root))
    return words.select("topic", F.to_json("kw").alias("kw"))


_K = 25
DISTRIBUTION = """
lines AS (SELECT l_orderkey AS id, s_nationkey AS topic, sum(l_quantity) AS w
          FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
dist AS (SELECT id, topic, w / sum(w) OVER (PARTITION BY id) AS probability FROM lines)"""
_KEPT = f"""{DISTRIBUTION},
kept AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY probability DESC, topic) AS rank
         FROM dist WHERE probability >= 1.0::DOUBLE / {_K})"""


@query(
    "top_topics",
    f"WITH {_KEPT} SELECT id, topic, probability, CAST(rank AS INTEGER) AS rank FROM kept",
)
def top_topics(spark, root):
    return tp.top_topics(article_topics(spark, root), _K)


@query(
    "best_topic",
    f"WITH {DISTRIBUTION} SELECT id, topic, probability FROM dist "
    "QUALIFY row_number() OVER (PARTITION BY id ORDER BY probability DESC, topic) = 1",
)
def best_topic(spark, root):
    return tp.best_topic(article_topics(spark, root))


@query(
    "article_topic_lines",
    on_corpus(
        f""", {_KEPT}, listed AS (
          SELECT id, string_agg(CAST(topic AS VARCHAR), ', ' ORDER BY rank) AS topics FROM kept GROUP BY 1)
        SELECT id, title || coalesce(', ' || topics, '') AS line FROM corpus LEFT JOIN listed USING (id)"""
    ),
)
def article_topic_lines(spark, root):
    titles = corpus(spark, root).select("id", "title")
    return tp.article_topic_lines(titles, article_topics(spark, root), _K)


_SENTENCES_SQL = f"""{TITLES},
    every AS (SELECT words FROM titles JOIN corpus USING (id) WHERE title <> '' AND len(words) > 0
              UNION ALL SELECT unnest({sentences_sql('text')}) FROM corpus),
    filled AS (SELECT list_filter(words, lambda w: w <> '') AS words FROM every)"""


@query(
    "training_sentences",
    f"""WITH {_SENTENCES_SQL}
    SELECT array_to_string(words, '|') AS words, count(*) AS n FROM filled WHERE len(words) > 0 GROUP BY 1""",
)
def training_sentences(spark, root):
    every = _sentences(spark, root).select(F.array_join("words", "|").alias("words"))
    return every.groupBy("words").agg(F.count("*").alias("n"))


def _sentences(spark, root):
    docs = corpus(spark, root)
    return mo.training_sentences(titles_nonempty(docs), docs)


# Sizes of the models fitted on the test tables, those of the reference for LDA; every round reads all texts.
LDA_TOPICS, LDA_ROUNDS = 50, 50
LDA_WORDS = 20
WORD_DIM, WORD_USES, WORD_PARTITIONS, CLUSTERS = 100, 5, 4, 10

_WITH_TERMS = f"""{VOCAB}, with_terms AS (
  SELECT id, count(*) AS n FROM terms JOIN vocab USING (term) GROUP BY 1)"""


@functools.lru_cache(maxsize=8)
def _lda(spark, root):
    """Vocabulary, count vectors and model, fitted once per session and folder."""
    docs = corpus(spark, root)
    with settings(spark, SHUFFLES_DROPPED):
        vocab = vocabulary(spark, root)
        words = docs.select("id", filtered_words(docs).alias("words"))
        counts = mo.count_vectors(words, "id", "words", vocab)
    return vocab, counts, em.em_fit(counts, "id", LDA_TOPICS, LDA_ROUNDS)


@query(
    "lda_fit",
    f"""WITH {_WITH_TERMS} SELECT count(*) AS documents, (SELECT count(*) FROM vocab) AS terms,
        CAST({LDA_TOPICS} AS BIGINT) AS topics, CAST(0 AS BIGINT) AS violations FROM with_terms""",
)
def lda_fit(spark, root):
    """A fresh fit: texts and terms it covers, topics, and texts whose weights do not sum to one."""
    _lda.cache_clear()
    _, counts, model = _lda(spark, root)
    whole = F.aggregate("topicDistribution", F.lit(0.0), lambda total, p: total + p)
    sums = em.em_distributions(model).select(whole.alias("p"), F.size("topicDistribution").alias("k"))
    wrong = (F.abs(F.col("p") - 1) > 1e-6) | (F.col("k") != LDA_TOPICS)
    return sums.agg(
        F.count("*").alias("documents"),
        F.lit(model.terms).cast("bigint").alias("terms"),
        F.max("k").cast("bigint").alias("topics"),
        F.count(F.when(wrong, 1)).alias("violations"),
    )


@query(
    "lda_topics",
    f"""SELECT CAST(unnest(range({LDA_TOPICS})) AS INTEGER) AS topic, CAST({LDA_WORDS} AS BIGINT) AS words,
        CAST(0 AS BIGINT) AS violations""",
)
def lda_topics(spark, root):
    """Per topic the words listed, and those out of order, without weight or not in the vocabulary."""
    vocab, _, model = _lda(spark, root)
    listed = em.em_topics(model, vocab, LDA_WORDS)
    before = F.lag("weight").over(Window.partitionBy("topic").orderBy("rank"))
    known = vocab.select(F.col("term").alias("word"), F.lit(True).alias("known"))
    judged = listed.withColumn("before", before).join(known, "word", "left")
    wrong = (F.col("weight") > F.col("before")) | (F.col("weight") <= 0) | F.col("known").isNull()
    return judged.groupBy("topic").agg(F.count("*").alias("words"), F.count(F.when(wrong, 1)).alias("violations"))


@query(
    "lda_article_topics",
    f"WITH {_WITH_TERMS} SELECT id, TRUE AS above, TRUE AS ordered FROM with_terms",
)
def lda_article_topics(spark, root):
    """Texts with a topic: their kept topics reach 1/k, fall, and begin with the best one."""
    _, _, model = _lda(spark, root)
    topics = tp.article_topics(em.em_distributions(model), "id", "topicDistribution", LDA_TOPICS)
    weights = F.transform("topics", lambda t: t["probability"])
    return topics.select(
        "id",
        F.forall(weights, lambda p: p >= 1 / LDA_TOPICS).alias("above"),
        ((weights == F.sort_array(weights, asc=False)) & (F.get("topics", F.lit(0)) == F.col("best"))).alias("ordered"),
    )


@query("lda_likelihood", f"WITH {_WITH_TERMS} SELECT count(*) AS documents, TRUE AS below_zero FROM with_terms")
def lda_likelihood(spark, root):
    """Documents, and whether their mean log likelihood is a finite number below zero."""
    _, counts, model = _lda(spark, root)
    value = em.em_likelihood(model)
    return counts.agg(F.count("*").alias("documents")).withColumn("below_zero", F.lit(-1e9 < value < 0))


_TRAINED = f"""WITH {_SENTENCES_SQL}, used AS (SELECT unnest(words) AS word FROM filled)
SELECT word, TRUE AS trained FROM used GROUP BY 1 HAVING count(*) >= {WORD_USES}"""


@functools.lru_cache(maxsize=8)
def _word2vec(spark, root):
    """Word vectors, trained once per session and folder."""
    sentences = _sentences(spark, root)
    return skipgram.vectors_fit(sentences, dim=WORD_DIM, min_count=WORD_USES, partitions=WORD_PARTITIONS)


@query("word2vec_fit", _TRAINED)
def word2vec_fit(spark, root):
    """Words of the model, and whether their vectors have the size and a length."""
    _word2vec.cache_clear()
    length = vec_norm(F.col("vector").cast("array<double>"))
    # An infinite or undefined length is beyond every finite one.
    trained = (F.size("vector") == WORD_DIM) & (length > 0) & (length < F.lit(float("inf")))
    return _word2vec(spark, root).select("word", trained.alias("trained"))


@query("word2vec_roundtrip", _TRAINED)
def word2vec_roundtrip(spark, root):
    """The model saved and loaded again, compared word by word."""
    model = _word2vec(spark, root)
    path = scratch_path(spark, "word2vec")
    sinks.write_word_vectors(model, path)
    loaded = read_word_vectors(spark, path).withColumnRenamed("vector", "loaded")
    both = model.join(loaded, "word")
    return both.select("word", (F.col("vector").cast("array<double>") == F.col("loaded")).alias("trained"))


@query(
    "kmeans_fit",
    f"SELECT count(*) AS points, CAST({CLUSTERS} AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced FROM embeddings",
)
def kmeans_fit(spark, root):
    """Points and clusters of a fit, and members that lie nearer to another centre."""
    points = vectors(spark, root)
    model = mo.kmeans_fit(points, CLUSTERS)
    members = mo.cluster_members(model, points)
    near = nearest_centre(points, mo.cluster_centres(model, spark)).withColumnRenamed("cluster", "nearest")
    return members.join(near, "id").agg(
        F.count("*").alias("points"),
        F.count_distinct("cluster").alias("clusters"),
        F.count(F.when(F.col("cluster") != F.col("nearest"), 1)).alias("misplaced"),
    )


@query(
    "stop_words_roundtrip",
    f"WITH {TOKENIZED}, used AS (SELECT DISTINCT unnest(words) AS word FROM tokenized) SELECT word FROM used",
)
def stop_words_roundtrip(spark, root):
    """Every kept word of the texts as a stop list: written, and read as one."""
    rows = term_rows(corpus(spark, root), "id", split_words(F.col("text")), STOP)
    path = scratch_path(spark, "stop")
    rows.select(F.col("term").alias("value")).distinct().write.text(path)
    return stop_words(spark, path)


@query(
    "job_info_roundtrip",
    f"""WITH {_WITH_TERMS} SELECT CAST({LDA_TOPICS} AS BIGINT) AS topics, CAST({LDA_ROUNDS} AS BIGINT) AS rounds,
        count(*) AS documents, (SELECT count(*) FROM vocab) AS terms,
        (SELECT count(*) FROM corpus) - count(*) AS "emptyTexts" FROM with_terms""",
)
def job_info_roundtrip(spark, root):
    """The record of the registered fit, written and read again."""
    _, counts, model = _lda(spark, root)
    path = scratch_path(spark, "info")
    about = {"jobId": 1, "jobName": "lda", "description": ""}
    sinks.write_job_info(spark, about | mo.fit_info(corpus(spark, root), counts, "id", model.k, model.terms, LDA_ROUNDS), path)
    return spark.read.schema(JOB_INFO).json(path).select(
        F.col("numTopics").cast("long").alias("topics"), F.col("maxIterations").cast("long").alias("rounds"),
        "documents", "terms", "emptyTexts",
    )
