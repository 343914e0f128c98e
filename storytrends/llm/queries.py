"""Registered queries of this package with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storytrends.session import scratch_path

from . import bpe, html, merkle, minhash, packing, pivots, quality, repeats, rules, shards, slack, warc, whiten
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.links(table(spark, sf_dir, "embeddings"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ruled.drop("text", "clean_text")


@query
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.page_captures(spark, path)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack.pack(table(spark, sf_dir, "documents"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FAILS = f"""((n >= 8 AND NOT regexp_matches(line, {_quoted(rules.SENTENCE)}))
  OR (length(line) - length(translate(line, '{rules.SYMBOLS}', ''))) * 10 > length(line)
  OR regexp_matches(line, {_quoted(rules.SHOUT)}) OR regexp_matches(line, {_quoted(rules.MENU)})
  OR regexp_matches(line, {_quoted(rules.BOILERPLATE)}) OR (n >= 10 AND distinct_words * 4 < n))"""

SQL["op3_quality_rules"] = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
grams AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) AS g
          FROM split WHERE len(w) >= 3),
placed AS (SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS p FROM grams),
twice AS (SELECT doc_id, p FROM placed QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY 1),
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
measured AS (SELECT doc_id, line, len(string_split_regex(trim(line), '[\x20\x09-\x0D]+')) AS n,
                    len(list_distinct(string_split_regex(trim(line), '[\x20\x09-\x0D]+'))) AS distinct_words FROM cut),
judged AS (SELECT doc_id, line, {_FAILS} AS failed FROM measured),
lines AS (SELECT doc_id, sum(length(line)) AS size, coalesce(sum(length(line)) FILTER (failed), 0) AS lost,
                 count(line) FILTER (worded) - count(DISTINCT line) FILTER (worded) AS dup
          FROM (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM judged) GROUP BY 1),
counted AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(lost AS BIGINT) AS lost_chars, size
  FROM split JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)),
based AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
  NOT base_failed AND lost_chars <= size * {rules.LOST_SHARE} AS kept FROM based"""

SQL["op8_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {warc.REVISIT_BYTES} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)"""


def _leaf(text: str) -> str:
    fields = [("doc_id", "doc_id"), ("source", "source"), ("lang", "lang"), ("n_chars", "n_chars"), ("text", text)]
    parts = [f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END" for name, value in fields]
    return f"sha256({' || '.join(parts)})"


def _tree(name: str, start: str) -> str:
    """Levels of the trees over ``start`` (g, pos, digest), and the siblings beside every node."""
    return f"""
{name} AS (
  SELECT g, 0 AS level, pos, digest FROM {start}
  UNION ALL
  SELECT g, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}) WHERE n > 1 GROUP BY g, level, pos // 3),
{name}_beside AS (
  SELECT a.g, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM {name} a JOIN {name} b ON a.g = b.g AND a.level = b.level AND a.pos // 3 = b.pos // 3
  JOIN (SELECT g, max(level) AS top FROM {name} GROUP BY g) t ON t.g = a.g AND a.level < t.top GROUP BY ALL),
{name}_top AS (SELECT g, arg_max(digest, level) AS digest FROM {name} GROUP BY g)"""


def _climb(name: str, tree: str, start: str) -> str:
    """Every row of ``start`` (row, g, pos, digest, proof) folded to the top of its tree, with all siblings."""
    return f"""
{name} AS (
  SELECT row, g, 0 AS level, pos, digest, proof FROM {start}
  UNION ALL
  SELECT row, g, level + 1, pos // 3, sha256(before || digest || after), proof || before || after
  FROM {name} JOIN {tree}_beside USING (g, level, pos)),
{name}_end AS (SELECT row, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM {name} GROUP BY row)"""


SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE rows AS (
  SELECT *, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) & 1 AS odd FROM documents),
leaves AS (SELECT coalesce('s' || source, 'n') AS g, doc_id, {_leaf('text')} AS leaf,
  CASE WHEN odd = 1 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS changed FROM rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS row FROM leaves),
start AS (SELECT g, pos, leaf AS digest FROM placed),{_tree('inner_tree', 'start')},
sources AS (SELECT '' AS g, g AS source, digest, row_number() OVER (ORDER BY g) - 1 AS pos FROM inner_tree_top),{_tree('outer_tree', 'sources')},
changed AS (SELECT row, g, pos, changed AS digest, '' AS proof FROM placed),{_climb('up', 'inner_tree', 'changed')},
halfway AS (SELECT p.row, '' AS g, s.pos, e.digest, e.proof FROM up_end e JOIN placed p USING (row) JOIN sources s ON s.source = p.g),
{_climb('top', 'outer_tree', 'halfway')}
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(e.proof) AS proof_sha256, e.digest AS folded_root,
  e.digest = r.digest AS verified
FROM placed p JOIN sources s ON s.source = p.g JOIN top_end e USING (row) CROSS JOIN outer_tree_top r"""
