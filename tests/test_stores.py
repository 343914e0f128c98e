"""Stories by month, dumps read by many tasks, sketches, and stop tables."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from storytrends import sources
from storytrends.operators import explore as ex
from storytrends.operators.stopping import _hashes, bloom_filter, may_contain, without_stop_words


@pytest.fixture(scope="module")
def posts(spark):
    day = F.date_add(F.lit(dt.date(2014, 11, 1)), (F.col("id") % 180).cast("int"))
    return spark.range(5000).select(
        F.when(F.col("id") % 500 != 7, F.to_timestamp(day)).alias("created_at"),
        F.concat(F.lit("a"), F.col("id") * 7919 % 700).alias("author"),
        F.col("id").alias("points"),
    )


def months(df):
    return {(r.year, r.month): (r.n, r.p) for r in df.groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("points").alias("p")).collect()}


def test_writing_a_month_again_leaves_the_others(spark, posts, tmp_path):
    path = str(tmp_path / "store")
    sources.write_months(posts, path, "created_at")
    before = months(sources.read_months(spark, path))
    assert sum(n for n, _ in before.values()) == 5000 and (None, None) in before
    january = sources.in_period(posts, "created_at", 2015, 1)
    sources.write_months(january.limit(3).withColumn("points", F.lit(1).cast("long")), path, "created_at")
    after = months(sources.read_months(spark, path))
    assert after.pop((2015, 1)) == (3, 3)
    before.pop((2015, 1))
    assert after == before


def test_a_range_of_months_prunes_folders(spark, posts, tmp_path):
    path = str(tmp_path / "store")
    sources.write_months(posts, path, "created_at")
    part = sources.read_months(spark, path, dt.date(2014, 12, 1), dt.date(2015, 2, 1))
    assert set(months(part)) == {(2014, 12), (2015, 1), (2015, 2)}
    text = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "PartitionFilters: []" not in text
    assert "DataFilters: []" in text


def test_a_large_month_becomes_several_files(spark, tmp_path):
    path = str(tmp_path / "store")
    one = spark.range(400_000).select(F.lit(dt.datetime(2015, 1, 5)).alias("created_at"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2MB")
    try:
        sources.write_months(one, path, "created_at")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(spark.read.parquet(path).inputFiles()) > 3


def dump(hits, **more):
    return {"hits": hits, "nbHits": len(hits), **more}


def hit(i, text):
    return {"created_at": f"2015-01-{i % 28 + 1:02d}", "author": "a", "comment_text": text, "tags": [{"x": 1}, {"y": [1, 2]}]}


def test_one_large_document_in_many_tasks(spark, tmp_path):
    path = str(tmp_path / "dump.json")
    hits = [hit(i, f'text {i} with ,{{"created_at": and "quotes" {"x" * (i % 300)}') for i in range(8000)]
    with open(path, "w") as file:
        json.dump(dump(hits), file, separators=(",", ":"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        split = sources.read_split_comments(spark, path)
        assert split.rdd.getNumPartitions() > 4
        found = sorted(r[0] for r in split.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = sources.read_comments(spark, path, multi_line=True)
    assert whole.rdd.getNumPartitions() == 1
    assert found == sorted(r[0] for r in whole.collect()) and len(found) == 8000


def test_documents_in_lines_and_odd_hits(spark, tmp_path):
    path = str(tmp_path / "lines.json")
    odd = [hit(1, None), {"created_at": "x"}, hit(2, ""), hit(3, "été ☃ \n \\ [{"), hit(4, "]}")]
    documents = [dump([]), dump(odd, page=0), dump([hit(9, "one")]), dump(odd[:2], first={"hits": []}), dump([])]
    with open(path, "w") as file:
        file.write("\n".join(json.dumps(d, separators=(",", ":")) for d in documents) + "\n")
    found = sorted(str(r[0]) for r in sources.read_split_comments(spark, path).collect())
    assert found == sorted(str(r[0]) for r in sources.read_comments(spark, path).collect())
    with open(path, "w") as file:
        json.dump(dump([hit(1, "only"), hit(2, "two")]), file, separators=(",", ":"))
    assert sorted(r[0] for r in sources.read_split_comments(spark, path).collect()) == ["only", "two"]


def test_sketches_of_days_merge_to_months(spark, posts):
    sketches = ex.submitter_sketches(posts.filter("created_at IS NOT NULL"))
    merged = {r.month: r for r in ex.submitters_by_month(sketches).unionByName(ex.merged_submitters(sketches)).collect()}
    exact = posts.filter("created_at IS NOT NULL").groupBy(ex.month_of("created_at").alias("month")).agg(
        F.count_distinct("author").alias("n"), F.count("*").alias("stories")
    )
    for r in exact.collect():
        assert merged[r.month].stories == r.stories and abs(merged[r.month].submitters - r.n) <= max(1, 0.03 * r.n)
    assert abs(merged["all"].submitters - 700) <= 21


def test_stop_tables_of_any_size_agree(spark):
    rows = [
        (1, ["a", "b", "a", None, "c", "stop", "a"]), (1, ["b"]), (2, []), (3, None), (4, ["stop"] * 500),
        (None, ["a", "z"]), (5, [None, None]), (6, ["é", "Stop", "x"]),
    ]
    rows += [(100 + i, [f"w{i}", "stop", f"w{i + 1}", "keep"]) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, words array<string>")
    stop = spark.createDataFrame([("stop",), ("b",), ("b",), (None,), ("é",), *((f"w{i}",) for i in range(0, 300, 3))], "word string")
    listed = {r.word for r in stop.collect()}
    expected = sorted(str((i, None if w is None else [x for x in w if x is not None and x not in listed])) for i, w in rows)
    for options in ({}, {"max_words": 0}, {"max_words": 0, "max_bits": 64}):
        found = without_stop_words(frame, "id", "words", stop, **options).collect()
        assert sorted(str((r.id, r.words)) for r in found) == expected, options
    none = without_stop_words(frame, "id", "words", stop.limit(0), max_words=0)
    assert none.count() == len(rows)


def test_bloom_filter_has_no_false_negatives(spark):
    words = spark.range(3000).selectExpr("concat('w', id) AS word")
    cells = bloom_filter(words, 1 << 16)
    probe = spark.range(20_000).selectExpr("concat('w', id) AS word", "id").select("id", *(h.alias(n) for h, n in zip(_hashes(F.col("word")), "ab", strict=True))).toPandas()
    found = may_contain(cells, probe["a"].to_numpy(), probe["b"].to_numpy())
    assert found[probe["id"] < 3000].all() and found[probe["id"] >= 3000].mean() < 0.02
