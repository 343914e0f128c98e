"""Results and plans on data where one key holds a third of all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from storytrends.operators import explore as ex
from storytrends.operators import popularity as pop
from storytrends.operators import similarity as si
from storytrends.operators import terms as te
from storytrends.operators import topics as tp
from storytrends.operators import trends as tr
from storytrends.session import cut_lineage

N = 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    """Stories of which a third have one author, one host and one topic."""
    hot = F.col("id") % 3 == 0
    return spark.range(N).select(
        F.col("id").alias("story_id"),
        F.timestamp_seconds(F.lit(1_400_000_000) + (F.col("id") * 1009) % 31_000_000).alias("created_at"),
        F.when(hot, 0).otherwise(F.col("id") % 997).alias("author"),
        (F.col("id") * 37 % 501).alias("points"),
        (F.col("id") % 11).alias("num_comments"),
        F.when(hot, 1).otherwise(F.col("id") % 7).cast("int").alias("topic"),
        F.concat(F.lit("http://www."), F.when(hot, "hot").otherwise((F.col("id") % 501).cast("string")), F.lit(".org/x")).alias("url"),
    )


def test_rankings(skewed):
    rows = skewed.select("author", "points", "story_id", "topic", "created_at").collect()
    count = {}
    for r in rows:
        count[r.author] = count.get(r.author, 0) + 1
    best = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert [(r.author, r.stories) for r in ex.top_submitters(skewed).collect()] == best
    assert ex.top_domains(skewed, n=1).first().domain == "hot.org"
    peaks = tr.topic_peak_month(pop.topic_popularity(skewed))
    month = {r.topic: r.month for r in peaks.collect()}
    found = {(r.topic, r["rank"]): r.story_id for r in tr.spike_stories(peaks, skewed, 3).collect()}
    for topic in month:
        mine = [r for r in rows if r.topic == topic and f"{r.created_at:%Y-%m}" == month[topic]]
        mine.sort(key=lambda r: (-r.points, r.story_id))
        assert [found[topic, i + 1] for i in range(3)] == [r.story_id for r in mine[:3]]


def test_bag_of_words_with_a_hot_term(spark):
    words = F.array(F.lit("hot"), F.concat(F.lit("w"), (F.col("id") % 300).cast("string")), F.lit("hot"))
    texts = spark.range(6000).select("id", words.alias("words"))
    counts = te.count_terms(texts.select(F.explode("words").alias("term")))
    vocab = te.vocab_index(counts)
    assert vocab.filter("idx = 0").first().term == "hot"
    for hot_terms in (1, 1000):
        bag = te.bag_of_words(texts, "id", "words", vocab, hot_terms)
        assert bag.count() == 12_000
        assert bag.filter("idx = 0").agg(F.sum("n")).first()[0] == 12_000


def test_topic_words_of_a_hot_topic(spark):
    words = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("topic"),
        F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"),
        (F.col("id") % 1000).cast("double").alias("weight"),
    )
    found = tp.topic_strings(words, 3).filter("topic = 0").first().words.split()
    # Every third id, and all multiples of 50: the heaviest are ids ending in 999.
    expected = sorted(f"w{i}" for i in range(999, 20_000, 1000) if i % 3 == 0 or i % 50 == 0)[:3]
    assert found == expected


@pytest.fixture
def no_broadcast(spark):
    """Joins by shuffle, with skew seen at the size of this data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_split_a_hot_word(spark, no_broadcast):
    word = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5000).cast("string"))
    rows = spark.range(120_000).select("id", word.alias("word"))
    table = rows.select("word").distinct().withColumn("vector", F.array(F.lit(1.0), F.lit(2.0)))
    means = si.mean_vectors(rows, cut_lineage(table), "id", "word", dim=2)
    assert "skew=true" in final_plan(means)
    assert means.filter("vector = array(1D, 2D)").count() == 120_000
    texts = rows.select("id", F.array("word").alias("words"))
    bases = table.select(F.col("word").alias("form"), F.upper("word").alias("base"))
    done = te.term_normalize(texts, "id", "words", bases, None, max_rows=0)
    assert "skew=true" in final_plan(done)
    assert done.filter("words[0] = 'HOT'").count() == 40_000
