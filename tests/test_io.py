from __future__ import annotations

import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from storytrends import sinks, sources
from storytrends.session import cut_lineage, scratch_dir

LINE = {
    "webpage": {"title": "Page", "metaDescription": "", "metaKeywords": "", "cleanedText": "Some text", "finalUrl": "", "topImage": ""},
    "HNItem": {"created_at": "2015-06-10T08:09:10.000Z", "title": "T", "url": "http://a/", "author": "me",
               "points": 3, "story_text": "", "num_comments": 1, "created_at_i": 1433923750, "objectID": "77"},
}


@pytest.fixture
def day_files(tmp_path):
    sparse = {"HNItem": {"objectID": "78", "points": None}}
    (tmp_path / "my-stories-2015-June-10").write_text(json.dumps(LINE) + "\n" + json.dumps(sparse) + "\n")
    (tmp_path / "my-stories-2015-January-1").write_text(json.dumps(LINE) + "\n")
    (tmp_path / "my-stories-2014-June-2").write_text("")
    return str(tmp_path)


def test_read_stories_fills_missing_values(spark, day_files):
    rows = sources.read_stories(spark, sources.period_glob(day_files, 2015, 6)).orderBy("HNItem.objectID").collect()
    assert [r.HNItem.objectID for r in rows] == ["77", "78"]
    assert rows[0].file_day == dt.date(2015, 6, 10)
    assert rows[0].webpage.cleanedText == "Some text" and rows[0].HNItem.points == 3
    assert rows[1].HNItem.title == "" and rows[1].HNItem.points == 0 and rows[1].webpage.title == ""
    assert rows[1].HNItem.created_at is None


def test_periods(spark, day_files):
    count = lambda *p: sources.read_stories(spark, sources.period_glob(day_files, *p)).count()
    assert (count(), count(2015), count(2015, 1), count("201*"), count(2014)) == (3, 3, 1, 3, 0)


def test_malformed_line(spark, tmp_path):
    (tmp_path / "stories-2015-June-3").write_text(json.dumps(LINE) + "\n{broken\n")
    path = sources.period_glob(str(tmp_path))
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_stories(spark, path).collect()
    rows = sources.read_stories(spark, path, "PERMISSIVE").collect()
    assert sorted(r.HNItem.objectID for r in rows) == ["", "77"]
    assert [r._corrupt_record for r in rows if r._corrupt_record] == ["{broken"]


def test_write_daily_by_default(spark, day_files, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_daily(sources.read_stories(spark, sources.period_glob(day_files, 2015, 1)), out)
    back = sources.read_stories(spark, sources.period_glob(out, 2015, 6))
    assert [r.HNItem.objectID for r in back.collect()] == ["77"]


def test_write_daily_keeps_order_and_days(spark, day_files, tmp_path):
    stories = sources.read_stories(spark, sources.period_glob(day_files, 2015))
    many = stories.select("webpage", "HNItem", "file_day", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("n"))
    out = str(tmp_path / "out")
    sinks.write_daily(many.select("HNItem", "file_day", "n"), out, F.col("file_day"), F.col("n"), partitions=3)
    assert len(glob.glob(f"{out}/file=stories-*")) == 2
    # A day may lie in several files; read by name, they are in order.
    for folder in glob.glob(f"{out}/file=stories-*"):
        order = []
        for name in sorted(glob.glob(f"{folder}/*.json")):
            order += [json.loads(line)["n"] for line in open(name)]
        assert order == sorted(order) and set(order) == set(range(1, 51))
    back = sources.read_stories(spark, sources.period_glob(out, 2015, 6))
    assert back.count() == 100 and back.first().file_day == dt.date(2015, 6, 10)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_daily(many, out, F.col("file_day"), F.col("n"))


def test_tokenized_text_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([("1", ["a", "b"]), ("2", [])], "id string, words array<string>")
    for kind in ("text", "parquet"):
        path = str(tmp_path / kind)
        sinks.write_tokenized(df, path, kind)
        back = sources.read_tokenized(spark, path, kind).orderBy("id").collect()
        assert [tuple(r) for r in back] == [("1", ["a", "b"]), ("2", [])]


def test_topic_words_of_driver_file_lines(spark, tmp_path):
    (tmp_path / "topics.txt").write_text("0, word, 0.5 \n0, other, 1.0E-4 \n")
    rows = sources.read_topic_words(spark, str(tmp_path / "topics.txt"), "csv").collect()
    assert [tuple(r) for r in rows] == [(0, "word", 0.5), (0, "other", 1e-4)]


def test_comments_by_line_and_by_file(spark, tmp_path):
    hits = {"hits": [{"comment_text": "one", "created_at": "x"}, {"comment_text": "two"}]}
    (tmp_path / "lines.json").write_text(json.dumps(hits) + "\n" + json.dumps(hits))
    (tmp_path / "whole.json").write_text(json.dumps(hits, indent=2))
    text = lambda name, multi: sorted(r[0] for r in sources.read_comments(spark, str(tmp_path / name), multi).collect())
    assert text("lines.json", False) == ["one", "one", "two", "two"]
    assert text("whole.json", True) == ["one", "two"]


def test_job_info_and_lines(spark, tmp_path):
    info = {"jobId": 2, "jobName": "2015-*", "description": "LDA", "numTopics": 50, "maxIterations": 50}
    sinks.write_job_info(spark, info, str(tmp_path / "info"))
    assert spark.read.json(str(tmp_path / "info")).first().asDict() == info
    sinks.write_lines(spark.createDataFrame([("x\ty",)], "line string"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first()[0] == "x\ty"


def test_article_export_columns(spark, day_files):
    row = sinks.article_export(sources.read_stories(spark, sources.period_glob(day_files, 2015, 1))).first()
    assert row.asDict() == {
        "Date": dt.datetime(2015, 6, 10, 8, 9, 10), "Article": "Some text", "Author": "me", "Title": "T", "Points": 3,
        "Url": "http://a/", "ObjectId": "77", "Webpage_title": "Page", "MetaDescription": "", "MetaKeywords": "",
        "FinalUrl": "", "TopImage": "",
    }


def test_cut_lineage_uses_the_named_folder(spark):
    df = cut_lineage(spark.range(10).withColumnRenamed("id", "n"), "probe")
    assert df.inputFiles()[0].removeprefix("file://").startswith(scratch_dir(spark).removeprefix("file://"))
    assert df.count() == 10
