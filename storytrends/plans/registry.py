"""The table of registered queries, each with SQL for the same result where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STORIES = """
lc AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
np AS (SELECT count(*) AS c FROM pages),
stories AS (
  SELECT o.o_orderkey AS story_id, o.o_orderdate AS created_at, o.o_custkey AS author,
         CAST(floor(o.o_totalprice / 1000) AS BIGINT) AS points,
         CAST(coalesce(lc.n, 0) AS BIGINT) AS num_comments,
         c.c_nationkey AS topic, p.url AS url
  FROM orders o CROSS JOIN np
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN pages p ON p.page_id = o.o_orderkey % np.c
  LEFT JOIN lc ON lc.l_orderkey = o.o_orderkey)"""

CORPUS = """
corpus AS (
  SELECT doc_id AS id, lang, source, split_part(text, chr(10), 1) AS title, text
  FROM documents)"""

MONTH = "strftime(created_at, '%Y-%m')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def on_stories(body: str) -> str:
    return f"WITH {STORIES}{body if body.startswith(',') else ' ' + body}"


def on_corpus(body: str) -> str:
    return f"WITH {CORPUS}{body if body.startswith(',') else ' ' + body}"
