"""Filters, totals and rankings of stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.web import url_eligible
from ..operators import explore as ex
from ..operators import filters as fl
from ..session import scratch_path
from ..sources.stories import in_period
from .registry import MONTH, on_corpus, on_stories, query
from .views import corpus, stories, table


@query(
    "stories_in_period",
    on_stories(
        "SELECT story_id, strftime(created_at, '%Y-%m-%d') AS day, points FROM stories "
        "WHERE year(created_at) = 1997 AND month(created_at) = 6"
    ),
)
def stories_in_period(spark, root):
    june = in_period(stories(spark, root, comments=False), "created_at", 1997, 6)
    return june.select("story_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "points")


@query("nonempty_text", on_corpus("SELECT id, text FROM corpus WHERE text <> ''"))
def nonempty_text(spark, root):
    return fl.nonempty_text(corpus(spark, root))


@query(
    "stories_only", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'view'"
)
def stories_only(spark, root):
    events = table(spark, root, "events").select("event_id", "user_id", "event_type")
    return fl.stories_only(events, "event_type", "view")


@query(
    "day_window",
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events "
    "WHERE floor(epoch(ts)) > epoch(TIMESTAMP '2024-01-10 00:00:00') "
    "AND floor(epoch(ts)) < epoch(TIMESTAMP '2024-01-12 23:59:59')",
)
def day_window(spark, root):
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at")
    events = table(spark, root, "events").select("event_id", "ts")
    days = fl.day_window(events, "ts", "2024-01-10", "2024-01-12", open_ends=True)
    return days.select("event_id", at)


@query(
    "day_window_half_open",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'",
)
def day_window_half_open(spark, root):
    events = table(spark, root, "events").select("event_id", "ts")
    return fl.day_window(events, "ts", "2024-01-10").select("event_id")


@query(
    "url_eligible",
    "SELECT page_id, url <> '' AND url NOT LIKE '%.pdf' AS eligible FROM pages",
)
def eligible(spark, root):
    return table(spark, root, "pages").select("page_id", url_eligible(F.col("url")).alias("eligible"))


@query(
    "post_kind_counts",
    """SELECT CASE WHEN lang = 'en' AND text <> '' THEN 'text' WHEN coalesce(url, '') <> '' THEN 'link'
              ELSE 'none' END AS kind, count(*) AS n
       FROM documents LEFT JOIN pages ON page_id = doc_id GROUP BY 1""",
)
def post_kind_counts(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "lang", "text")
    pages = table(spark, root, "pages").select("page_id", "url")
    posts = docs.join(pages, F.col("doc_id") == F.col("page_id"), "left").select(
        F.when(F.col("lang") == "en", F.col("text")).otherwise("").alias("story_text"),
        F.coalesce("url", F.lit("")).alias("url"),
    )
    return fl.post_kind_counts(posts)


@query(
    "overall_totals",
    on_stories(
        "SELECT count(*) AS stories, count(DISTINCT author) AS submitters, "
        "CAST(sum(points) AS BIGINT) AS upvotes, CAST(sum(num_comments) AS BIGINT) AS comments FROM stories"
    ),
)
def overall_totals(spark, root):
    return ex.overall_totals(stories(spark, root))


@query(
    "monthly_totals",
    on_stories(
        f"""SELECT {MONTH} AS month, count(*) AS articles, CAST(sum(points) AS BIGINT) AS points,
              CAST(sum(num_comments) AS BIGINT) AS comments,
              {MONTH} = (SELECT max({MONTH}) FROM stories)
                AND CAST(max(created_at) AS DATE) < last_day(max(created_at)) AS partial
            FROM stories GROUP BY {MONTH}"""
    ),
)
def monthly_totals(spark, root):
    return ex.monthly_totals(stories(spark, root))


@query(
    "submitter_sketches",
    on_stories(
        f""", counted AS (SELECT {MONTH} AS month, count(*) AS stories, count(DISTINCT author) AS submitters FROM stories GROUP BY 1
             UNION ALL SELECT 'all', count(*), count(DISTINCT author) FROM stories)
        SELECT month, stories, submitters, TRUE AS within FROM counted"""
    ),
)
def submitter_sketches(spark, root):
    """Distinct submitters by month and in all, and whether the merged daily sketches are within 3 % of them.

    The sketches are stored by day and merged from there. Three standard errors are 2.4 %;
    one submitter more or less is always within.
    """
    posts = stories(spark, root, comments=False)
    path = scratch_path(spark, "sketches")
    ex.submitter_sketches(posts).write.parquet(path)
    stored = spark.read.parquet(path)
    merged = ex.submitters_by_month(stored).unionByName(ex.merged_submitters(stored)).withColumnRenamed("submitters", "estimate")
    month = ex.month_of("created_at").alias("month")
    exact = posts.groupBy(month).agg(F.count_distinct("author").alias("submitters")).unionByName(
        posts.agg(F.lit("all").alias("month"), F.count_distinct("author").alias("submitters"))
    )
    off = F.abs(F.col("estimate") - F.col("submitters"))
    return merged.join(exact, "month").select(
        "month", "stories", "submitters", (off <= F.greatest(F.lit(1.0), F.col("submitters") * 0.03)).alias("within")
    )


@query(
    "month_calendar",
    on_stories(
        f""", span AS (SELECT date_trunc('month', min(created_at)) AS lo,
                              date_trunc('month', max(created_at)) AS hi FROM stories),
             months AS (SELECT strftime(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)), '%Y-%m') AS month
                        FROM span),
             counted AS (SELECT {MONTH} AS month, count(*) AS articles FROM stories GROUP BY 1)
        SELECT month, CAST(coalesce(articles, 0) AS BIGINT) AS articles
        FROM months LEFT JOIN counted USING (month)"""
    ),
)
def month_calendar(spark, root):
    return ex.months_covered(stories(spark, root, comments=False))


@query(
    "days_without_stories",
    on_stories(
        """, days AS (SELECT DISTINCT CAST(created_at AS DATE) AS day FROM stories),
             span AS (SELECT min(day) AS lo, max(day) AS hi FROM days),
             every AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
        SELECT CAST(day AS VARCHAR) AS day FROM every WHERE day NOT IN (SELECT day FROM days)"""
    ),
)
def days_without_stories(spark, root):
    days = ex.days_without_stories(stories(spark, root, comments=False))
    return days.select(F.col("day").cast("string").alias("day"))


@query(
    "upvote_hist_100",
    on_stories(
        "SELECT CAST(floor(points / 100) * 100 AS BIGINT) AS bucket, count(*) AS n FROM stories GROUP BY 1"
    ),
)
def upvote_hist_100(spark, root):
    return ex.upvote_hist(stories(spark, root, comments=False), 100)


@query(
    "upvote_hist_low",
    on_stories("SELECT points AS bucket, count(*) AS n FROM stories WHERE points <= 30 GROUP BY 1"),
)
def upvote_hist_low(spark, root):
    return ex.upvote_hist(stories(spark, root, comments=False), 1, 30)


@query(
    "upvote_share",
    on_stories(
        "SELECT avg(CASE WHEN points < 100 THEN 1 ELSE 0 END) AS first_bucket, "
        "avg(CASE WHEN points > 100 THEN 1 ELSE 0 END) AS above FROM stories"
    ),
)
def upvote_share(spark, root):
    return ex.upvote_share(stories(spark, root, comments=False))


@query(
    "top_stories",
    on_stories("SELECT story_id, author, points FROM stories WHERE points > 490 ORDER BY 3 DESC, 1"),
)
def top_stories(spark, root):
    best = ex.top_stories(stories(spark, root, comments=False), min_points=490)
    return best.select("story_id", "author", "points")


_PER_GROUP = (
    "count(*) AS stories, CAST(sum(points) AS BIGINT) AS points, "
    "CAST(sum(num_comments) AS BIGINT) AS comments"
)
_TOP_AUTHORS = "SELECT author, {} FROM stories GROUP BY author ORDER BY {} DESC, author LIMIT 10"


@query("top_submitters", on_stories(_TOP_AUTHORS.format(_PER_GROUP, "stories")))
def top_submitters(spark, root):
    return ex.top_submitters(stories(spark, root))


@query("top_submitters_comments", on_stories(_TOP_AUTHORS.format(_PER_GROUP, "comments")))
def top_submitters_comments(spark, root):
    return ex.top_submitters(stories(spark, root), "comments")


@query(
    "top_submitters_rate",
    on_stories(
        """, top AS (SELECT author, count(*) AS stories FROM stories GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
             span AS (SELECT date_diff('day', min(created_at), max(created_at)) + 1 AS days FROM stories)
        SELECT count(*) AS submitters, CAST(sum(stories) AS BIGINT) AS stories,
               CAST(sum(stories) AS DOUBLE) / count(*) / max(days) AS per_day FROM top, span"""
    ),
)
def top_submitters_rate(spark, root):
    return ex.top_submitters_rate(stories(spark, root, comments=False))


_DOMAINS = f""", domains AS (
  SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS domain,
         {_PER_GROUP} FROM stories GROUP BY 1)"""


def _top_domains(measure):
    @query(
        f"top_domains_{measure}",
        on_stories(f"{_DOMAINS} SELECT * FROM domains ORDER BY {measure} DESC, domain LIMIT 10"),
    )
    def top_domains(spark, root):
        return ex.top_domains(stories(spark, root, url=True), measure)


for _m in ex.MEASURES:
    _top_domains(_m)


_RANKED = "(SELECT domain, {0}, row_number() OVER (ORDER BY {0} DESC, domain) AS rank FROM domains)"


@query(
    "domain_rank_table",
    on_stories(
        f"""{_DOMAINS}
        SELECT CAST(rank AS INTEGER) AS rank, s.domain AS domain_by_stories, s.stories,
               p.domain AS domain_by_points, p.points, c.domain AS domain_by_comments, c.comments
        FROM {_RANKED.format('stories')} s FULL JOIN {_RANKED.format('points')} p USING (rank)
        FULL JOIN {_RANKED.format('comments')} c USING (rank) WHERE rank <= 10"""
    ),
)
def domain_rank_table(spark, root):
    return ex.domain_rank_table(stories(spark, root, url=True))


@query(
    "measure_correlation",
    on_stories(
        f"""{_DOMAINS} SELECT count(*) AS groups, round(corr(stories, points), 6) AS stories_points,
              round(corr(stories, comments), 6) AS stories_comments,
              round(corr(points, comments), 6) AS points_comments FROM domains"""
    ),
)
def measure_correlation(spark, root):
    return ex.measure_correlation(ex.domain_measures(stories(spark, root, url=True)))
