"""Vector arithmetic, text vectors and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import lsh
from ..operators import similarity as si
from ..operators.rows import array_rows
from .queries_text import TITLES
from .registry import query
from .views import STOP, label_means, text_word_table, titles, vectors, word_table

VECTORS = """
vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"""
MEANS = f"""{VECTORS},
cells AS (SELECT id, label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM vectors),
sums AS (SELECT label, pos, sum(x) AS s, count(*) AS n FROM cells GROUP BY ALL),
means AS (SELECT label, list(s / n ORDER BY pos) AS m FROM sums GROUP BY 1)"""
NORM = "sqrt(list_dot_product({0}, {0}))"
TEXT_WORDS = f"""{TITLES}, {VECTORS},
title_terms AS (SELECT id, unnest(words) AS term FROM titles),
ranked AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS idx
           FROM title_terms GROUP BY term),
word_table AS (SELECT term AS word, v, idx FROM ranked JOIN vectors ON id = idx)"""
TITLE_VECTORS = f"""{TEXT_WORDS},
known AS (SELECT t.id, unnest(v) AS x, unnest(range(len(v))) AS pos
          FROM title_terms t JOIN word_table w ON w.word = t.term),
known_sums AS (SELECT id, pos, sum(x) AS s FROM known GROUP BY ALL),
title_sums AS (SELECT id, list(s ORDER BY pos) AS s FROM known_sums GROUP BY 1),
title_vectors AS (SELECT id, list_transform(s, lambda x: x / len(words)) AS v
                  FROM title_sums JOIN titles USING (id))"""


def _paired(spark, root):
    """Each vector with the mean of its label; the few means are broadcast by size."""
    means = label_means(spark, root).withColumnRenamed("vector", "mean")
    return vectors(spark, root).join(means, "label")


def _cells(df, key):
    return df.select(key, F.posexplode("vector").alias("pos", "value")).select(
        key, F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


@query("vector_sum", f"WITH {MEANS} SELECT label, pos, round(s, 6) AS value FROM sums")
def vector_sum(spark, root):
    return _cells(si.group_vector_sum(vectors(spark, root), "label"), "label")


@query(
    "vector_sum_pairs",
    f"""WITH {MEANS} SELECT id, round(list_sum(list_transform(list_zip(v, m), lambda z: z[1] + z[2])), 6)
        AS total FROM vectors JOIN means USING (label)""",
)
def vector_sum_pairs(spark, root):
    both = vx.vec_sum(F.col("vector"), F.col("mean"))
    total = F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x)
    return _paired(spark, root).select("id", F.round(total, 6).alias("total"))


@query(
    "vector_dot",
    f"WITH {MEANS} SELECT id, round(list_dot_product(v, m), 6) AS dot FROM vectors JOIN means USING (label)",
)
def vector_dot(spark, root):
    dot = vx.vec_dot(F.col("vector"), F.col("mean"))
    return _paired(spark, root).select("id", F.round(dot, 6).alias("dot"))


@query(
    "vector_mean",
    f"WITH {MEANS} SELECT label, pos, round(s / n, 6) AS value FROM sums",
)
def vector_mean(spark, root):
    summed = si.group_vector_sum(vectors(spark, root), "label")
    mean = vx.vec_div(F.col("vector"), F.col("n"))
    return _cells(summed.select("label", mean.alias("vector")), "label")


@query("vector_norm", f"WITH {VECTORS} SELECT id, round({NORM.format('v')}, 6) AS norm FROM vectors")
def vector_norm(spark, root):
    return vectors(spark, root).select("id", F.round(vx.vec_norm(F.col("vector")), 6).alias("norm"))


@query(
    "cosine_pairs",
    f"WITH {MEANS} SELECT id, label, round(list_dot_product(v, m) / nullif({NORM.format('v')} * "
    f"{NORM.format('m')}, 0), 6) AS cosine FROM vectors JOIN means USING (label)",
)
def cosine_pairs(spark, root):
    score = vx.cosine(F.col("vector"), F.col("mean"))
    return _paired(spark, root).select("id", "label", F.round(score, 6).alias("cosine"))


@query(
    "scaled_dot",
    f"WITH {MEANS} SELECT id, round(list_dot_product(v, m) / (len(v) * len(m)), 6) AS scaled "
    "FROM vectors JOIN means USING (label)",
)
def scaled_dot(spark, root):
    scaled = vx.scaled_dot(F.col("vector"), F.col("mean"))
    return _paired(spark, root).select("id", F.round(scaled, 6).alias("scaled"))


@query(
    "word_vectors",
    f"""WITH {TEXT_WORDS} SELECT term AS word, v IS NOT NULL AS known,
        round(coalesce({NORM.format('v')}, 0), 6) AS norm,
        round(coalesce(v[1], 0), 6) AS first_value
        FROM ranked LEFT JOIN word_table ON word = term""",
)
def word_vectors(spark, root):
    words = array_rows(titles(spark, root), "id", F.col("words"), "word")
    tokens = words.select("word").distinct()
    table = text_word_table(spark, root)
    found = si.word_vectors(tokens, table)
    norm = vx.vec_norm(F.col("vector"))
    return found.select(
        "word",
        (norm > 0).alias("known"),
        F.round(norm, 6).alias("norm"),
        F.round(F.get("vector", F.lit(0)), 6).alias("first_value"),
    )


@query(
    "title_vectors",
    f"""WITH {TITLE_VECTORS} SELECT t.id, round(coalesce({NORM.format('v')}, 0), 6) AS norm,
        round(coalesce(v[1], 0), 6) AS first_value FROM titles t LEFT JOIN title_vectors USING (id)
        WHERE len(t.words) > 0""",
)
def title_vectors(spark, root):
    found = si.title_vectors(titles(spark, root), text_word_table(spark, root))
    return found.select(
        "id",
        F.round(vx.vec_norm(F.col("vector")), 6).alias("norm"),
        F.round(F.get("vector", F.lit(0)), 6).alias("first_value"),
    )


@query(
    "mean_vectors",
    f"""WITH {VECTORS}, rows AS (
      SELECT l_orderkey AS id, v FROM lineitem LEFT JOIN vectors ON vectors.id = l_partkey)
    SELECT id, round(coalesce(sum(v[1]), 0) / count(*), 6) AS first_value,
           round(coalesce(sum(v[64]), 0) / count(*), 6) AS last_value FROM rows GROUP BY 1""",
)
def mean_vectors(spark, root):
    lines = spark.read.parquet(f"{root}/lineitem.parquet").select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("word")
    )
    found = si.mean_vectors(lines, word_table(spark, root), "id", "word")
    return found.select(
        "id",
        F.round(F.get("vector", F.lit(0)), 6).alias("first_value"),
        F.round(F.element_at("vector", -1), 6).alias("last_value"),
    )


_DISTANCE = "list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(
    "nearest_centre",
    f"""WITH {MEANS}, pairs AS (
      SELECT id, means.label AS cluster, round({_DISTANCE}, 9) AS d FROM vectors CROSS JOIN means)
    SELECT id, cluster FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1""",
)
def nearest_centre(spark, root):
    return si.nearest_centre(vectors(spark, root), label_means(spark, root, "cluster"))


@query(
    "cluster_centres",
    f"WITH {MEANS} SELECT label AS cluster, pos, round(s / n, 6) AS value FROM sums",
)
def cluster_centres(spark, root):
    return _cells(label_means(spark, root, "cluster"), "cluster")


_SCORE = f"round(list_dot_product({{0}}, {{1}}) / ({NORM.format('{0}')} * {NORM.format('{1}')}), 9)"


@query(
    "cluster_keywords",
    f"""WITH {MEANS}, pairs AS (
      SELECT means.label AS cluster, id AS word, {_SCORE.format('v', 'm')} AS score
      FROM vectors CROSS JOIN means),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, word) AS rank FROM pairs)
    SELECT cluster, word, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10""",
)
def cluster_keywords(spark, root):
    found = si.nearest_words(label_means(spark, root, "query"), word_table(spark, root), 10)
    return found.select(
        F.col("query").alias("cluster"), "word", F.round("score", 6).alias("score"), "rank"
    )


_LABELS_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"


@query(
    "synonyms",
    f"""WITH {TEXT_WORDS}, pairs AS (
      SELECT q.word AS query, w.word AS word, {_SCORE.format('q.v', 'w.v')} AS score
      FROM word_table q JOIN word_table w ON q.word <> w.word AND q.word IN {_LABELS_SQL}),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, word) AS rank FROM pairs)
    SELECT query, word, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 20""",
)
def synonyms(spark, root):
    table = text_word_table(spark, root)
    labels = si.label_vectors(table, list(STOP)).withColumnRenamed("label", "query")
    found = si.nearest_words(labels, table, 20, exclude_self=True)
    return found.select("query", "word", F.round("score", 6).alias("score"), "rank")


# Neighbours of less cosine need not be found.
LSH_COSINE = 0.35


@query(
    "nearest_words_lsh",
    f"""WITH {VECTORS}, pairs AS (
      SELECT q.id AS query, w.id AS word, {_SCORE.format('q.v', 'w.v')} AS score
      FROM vectors q JOIN vectors w ON q.id <> w.id AND q.id % 4 = 0),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, word) AS rank FROM pairs)
    SELECT count(*) AS links, TRUE AS recalled, CAST(0 AS BIGINT) AS wrong FROM best WHERE rank <= 10 AND score >= {LSH_COSINE}""",
)
def nearest_words_lsh(spark, root):
    """The ten nearest words by hash tables against those of the exact search.

    ``recalled``: of the neighbours of at least LSH_COSINE, 95 % are found; ``wrong``: found
    ones with another score than the exact search gives.
    """
    words = word_table(spark, root)
    asked = words.filter("word % 4 = 0").withColumnRenamed("word", "query")
    exact = si.nearest_words(asked, words, 10, exclude_self=True).filter(F.col("score") >= LSH_COSINE)
    found = lsh.nearest_words_lsh(asked, words, 10, exclude_self=True, min_cosine=LSH_COSINE)
    both = exact.join(found.select("query", "word", F.col("score").alias("found")), ["query", "word"], "left")
    same = F.abs(F.col("score") - F.col("found")) < 1e-8
    return both.agg(
        F.count("*").alias("links"),
        (F.count("found") >= 0.95 * F.count("*")).alias("recalled"),
        F.count(F.when(~same, 1)).alias("wrong"),
    )


@query(
    "classify_nearest_label",
    f"""WITH {TITLE_VECTORS}, {MEANS.replace(VECTORS + ',', '')}, pairs AS (
      SELECT id, label, {_SCORE.format('v', 'm')} AS score FROM title_vectors CROSS JOIN means),
    best AS (SELECT id, label, score FROM pairs WHERE isfinite(score)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY pairs.score DESC, label) = 1)
    SELECT id, label, round(score, 6) AS score FROM titles LEFT JOIN best USING (id) WHERE len(words) > 0""",
)
def classify_nearest_label(spark, root):
    texts = si.title_vectors(titles(spark, root), text_word_table(spark, root))
    found = si.classify_nearest_label(texts, label_means(spark, root))
    return found.select("id", "label", F.round("score", 6).alias("score"))
