from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from storytrends.plans import jobs

K = 3
THEMES = (
    ("python", "snake", "script", "parser"),
    ("java", "virtual", "machine", "bytecode"),
    ("hadoop", "cluster", "mapper", "reducer"),
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("stories")
    rng = random.Random(4)
    for month, name in ((1, "January"), (2, "February"), (4, "April")):
        lines = []
        for i in range(40):
            words = [rng.choice(THEMES[i % K]) for _ in range(12)]
            text = ". ".join(" ".join(words[j : j + 4]) for j in range(0, 12, 4))
            post = {"created_at": f"2015-{month:02d}-05T01:00:00Z", "title": " ".join(words[:3]).title(),
                    "url": "", "author": f"a{i % 5}", "points": i, "story_text": "", "num_comments": i % 4,
                    "created_at_i": 0, "objectID": f"{month}-{i}"}
            page = dict.fromkeys(("title", "metaDescription", "metaKeywords", "finalUrl", "topImage"), "")
            lines.append(json.dumps({"webpage": {**page, "cleanedText": text}, "HNItem": post}))
        (root / f"stories-2015-{name}-5").write_text("\n".join(lines) + "\n")
    return root


def test_lda_job(spark, folder, tmp_path):
    out = str(tmp_path / "lda")
    dictionary = spark.createDataFrame([("reducer", "reduce")], "form string, base string")
    tokens = jobs.tokenize_job(spark, f"{folder}/*", out, ["machine"], dictionary)
    assert tokens.count() == 120
    jobs.lda_job(spark, tokens, out, K, 10, drop_top=1, words_per_topic=2, info={"jobName": "2015-*"})
    assert spark.read.parquet(f"{out}/topics").count() == K * 2
    assert spark.read.parquet(f"{out}/clustering").selectExpr("min(probability) p").first().p >= 1 / K
    info = spark.read.json(f"{out}/info").first()
    terms = spark.read.parquet(f"{out}/tokenized").selectExpr("explode(words) w").distinct().count() - 1
    assert (info.jobName, info.numTopics, info.documents, info.terms, info.emptyTexts) == ("2015-*", K, 120, terms, 0)


def test_word2vec_kmeans_and_popularity_jobs(spark, folder, tmp_path):
    model, out = str(tmp_path / "w2v"), str(tmp_path / "kmeans")
    jobs.word2vec_job(spark, f"{folder}/*", model, dim=8, min_count=1, max_iter=5)
    jobs.kmeans_job(spark, f"{folder}/*", model, out, k=K, max_iter=5, words_per_topic=4)
    clusters = spark.read.parquet(f"{out}/clustering")
    assert clusters.count() == 120 and clusters.select("topicId").distinct().count() == K
    jobs.popularity_job(spark, f"{folder}/*", f"{out}/clustering", f"{out}/topics", f"{out}/page")
    score = spark.read.parquet(f"{out}/page/popularity").groupBy("month").sum("score").collect()
    assert len(score) == 3 and all(abs(r[1] - 1) < 1e-9 for r in score)
    scores = json.loads(spark.read.text(f"{out}/page/scores").first()[0])
    assert [t["date"] for t in scores["totals"]] == ["2015-01", "2015-02", "2015-03", "2015-04"]
    assert [t["articles"] for t in scores["totals"]] == [40, 40, 0, 40]
    assert len(scores["topicseries"]) == K
    for i, total in enumerate(scores["totals"]):
        for measure in ("articles", "points", "comments"):
            assert sum(s[measure][i] for s in scores["topicseries"]) == total[measure]
    keywords = json.loads(spark.read.text(f"{out}/page/keywords").first()[0])
    assert [len(k) for k in keywords] == [4] * K and set(keywords[0][0]) == {"w", "s"}


def test_classify_job(spark, folder, tmp_path):
    model, out = str(tmp_path / "w2v"), str(tmp_path / "labels")
    jobs.word2vec_job(spark, f"{folder}/*", model, dim=8, min_count=1, max_iter=5)
    jobs.classify_job(spark, f"{folder}/*", model, out)
    found = spark.read.parquet(out)
    assert found.count() == 120
    assert {r.label for r in found.select("label").distinct().collect()} <= {"python", "java", "hadoop"}


def test_page_documents_fill_missing_topics(spark):
    from storytrends.sinks.page import keywords_json

    words = spark.createDataFrame([(0, "a", 0.5), (2, "b", 1.0)], "topic int, word string, weight double")
    document = json.loads(keywords_json(words).first().value)
    assert document == [[{"w": "a", "s": 0.5}], [], [{"w": "b", "s": 1.0}]]


def test_stories_outside_all_clusters_keep_their_months(spark, folder, tmp_path):
    out = str(tmp_path / "one")
    one = spark.createDataFrame([("2-3", 0)], "objectID string, topicId int")
    one.write.parquet(f"{out}/clustering")
    spark.createDataFrame([(0, "w", 1.0)], "topicId int, word string, weight double").write.parquet(f"{out}/topics")
    jobs.popularity_job(spark, f"{folder}/*", f"{out}/clustering", f"{out}/topics", f"{out}/page")
    scores = json.loads(spark.read.text(f"{out}/page/scores").first()[0])
    assert [t["date"] for t in scores["totals"]] == ["2015-01", "2015-02", "2015-03", "2015-04"]
    assert [t["articles"] for t in scores["totals"]] == [40, 40, 0, 40]
    assert scores["topicseries"][0]["articles"] == [0, 1, 0, 0]


def test_loose_words_and_topic_reports(spark, folder, tmp_path):
    out = str(tmp_path / "loose")
    tokens = jobs.tokenize_job(spark, f"{folder}/*", out, ["machine"], loose=True)
    jobs.lda_job(spark, tokens, out, K, 5, drop_top=1, words_per_topic=5)
    jobs.topic_report_job(spark, f"{folder}/*", f"{out}/topics", f"{out}/clustering", f"{out}/report")
    assert spark.read.text(f"{out}/report/matrix").filter("value LIKE 'TOPIC%'").count() == K
    assert spark.read.text(f"{out}/report/titles").count() == 120


def test_explore_and_pages_jobs(spark, folder, tmp_path):
    jobs.explore_job(spark, f"{folder}/*", str(tmp_path / "explore"), 3)
    assert spark.read.parquet(str(tmp_path / "explore" / "submitters")).count() == 3
    stories = jobs.sources.read_stories(spark, f"{folder}/*")
    posts = stories.select("HNItem.*").withColumn("url", F.concat(F.lit("http://x/"), "objectID"))
    html = "<html><head><title>T</title></head><body><p>five words are enough here</p></body></html>"
    pages = posts.limit(7).select("objectID", F.lit(html).alias("html"))
    jobs.pages_job(spark, posts, pages, str(tmp_path / "pages"))
    outcomes = {r.outcome: r.n for r in spark.read.parquet(str(tmp_path / "pages" / "outcomes")).collect()}
    assert outcomes == {"success": 7}
    days = spark.read.json(str(tmp_path / "pages" / "days"))
    assert days.count() == 120 and days.filter("webpage.cleanedText = 'five words are enough here'").count() == 7


def test_export_job_rows(spark, folder, monkeypatch):
    seen = []
    monkeypatch.setattr(jobs.sinks, "write_jdbc", lambda df, url, table, **o: seen.append((df.count(), len(df.columns), table)))
    jobs.export_job(spark, f"{folder}/*", "jdbc:none", "articles")
    assert seen == [(120, 12, "articles")]
