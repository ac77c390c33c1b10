"""End-to-end jobs."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from pricetrace.catalog.bindings import ARTICLE_LIST, TAGS, WORDS, articles, lexicon, trades
from pricetrace.catalog.registry import cte, query
from pricetrace.plans import jobs
from pricetrace.schemas import ARTICLE_COLUMNS
from pricetrace.scratch import Staged, new_path
from pricetrace.sinks import datasets

_PIVOT = ", ".join(f"CAST(sum(CASE WHEN policy = {p} THEN cnt ELSE 0 END) AS BIGINT) AS policy_{p}" for p in WORDS)
_SCORE_PIVOT = ", ".join(f"sum(CASE WHEN policy = {p} THEN score ELSE 0 END) AS policy_{p}" for p in WORDS)


@query("trace_articles", f"SELECT target_month, month, policy, rank, cnt, {ARTICLE_LIST}, article_url FROM trc")
def trace_articles(spark, sf):
    return jobs.trace_articles(trades(spark, sf), articles(spark, sf), WORDS)


@query("trace_row_counts", "SELECT count(*) AS articles, count(content_text) AS with_body FROM trc")
def trace_row_counts(spark, sf):
    """The row counts that the tracing job observes while its result is written."""
    seen = Observation("traced")
    Staged(jobs.trace_articles(trades(spark, sf), articles(spark, sf), WORDS, observation=seen), "traced").discard()
    return spark.createDataFrame([(seen.get["articles"], seen.get["with_body"])], "articles bigint, with_body bigint")


@query("trace_articles_month", f"""
  SELECT target_month, month, policy, rank, cnt, {ARTICLE_LIST}, article_url FROM trc WHERE target_month = '199801'""")
def trace_articles_month(spark, sf):
    """One target month, from articles partitioned by month."""
    path = new_path(spark, "articles-by-month")
    datasets.write_by_month(articles(spark, sf).select(*ARTICLE_COLUMNS, "month"), path, "parquet")
    return jobs.trace_articles(trades(spark, sf), datasets.read_months(spark, path), WORDS, "199801")


cte(
    # prices, effects and winners per series
    rchg="""
      SELECT series, month, CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 5, 2) AS INTEGER) AS month_idx,
        (a / lag(a) OVER (PARTITION BY series ORDER BY month) - 1) * 100 AS pct_change FROM sser""",
    rpol="SELECT c.*, p.policy FROM rchg c LEFT JOIN ptype p ON p.month = c.month",
    reff="""
      SELECT s.series, s.policy, s.month AS start_month, per.period, avg(f.pct_change) AS avg_change
      FROM rpol s, per, rpol f
      WHERE s.policy IS NOT NULL AND f.series = s.series AND f.month_idx > s.month_idx AND f.month_idx <= s.month_idx + per.period
      GROUP BY ALL""",
    rcand="""
      SELECT t.series, t.month AS target_month, c.month, c.policy, e.start_month, e.avg_change
      FROM rpol t JOIN rpol c ON c.series = t.series AND c.policy IS NOT NULL AND t.month_idx - c.month_idx BETWEEN 1 AND 6
      LEFT JOIN reff e ON e.series = t.series AND e.policy = c.policy AND e.period = t.month_idx - c.month_idx""",
    rwin="""
      SELECT series, target_month, month, policy FROM (SELECT *, row_number() OVER (PARTITION BY series, target_month
          ORDER BY round(abs(avg_change), 9) DESC NULLS LAST, month, policy, start_month) AS r FROM rcand) WHERE r = 1""",
)


@query("trace_articles_series", """
  SELECT w.series, w.target_month, w.month, w.policy, r.rank, r.cnt, r.article_id
  FROM rwin w JOIN rnk r ON r.month = w.month AND r.policy = w.policy AND r.rank <= 3""")
def trace_articles_series(spark, sf):
    """Each series of the trades, as a region would be, traced on its own."""
    traced = jobs.trace_articles(trades(spark, sf), articles(spark, sf), WORDS, series=["series"])
    return traced.select("series", "target_month", "month", "policy", "rank", "cnt", "article_id")


@query("monthly_policy_analysis", f"""
  SELECT p.*, CAST(CASE WHEN t.policy IN (3, 4) THEN 3 ELSE t.policy END AS INTEGER) AS policy_type
  FROM (SELECT month, {_PIVOT} FROM wcnt GROUP BY month) p JOIN atype t ON t.month = p.month""")
def monthly_policy_analysis(spark, sf):
    return jobs.monthly_policy_analysis(articles(spark, sf), WORDS)


@query("article_ranking", "SELECT month, policy, article_id, cnt, rank FROM rnk")
def article_ranking(spark, sf):
    return jobs.article_ranking(articles(spark, sf), WORDS)


@query("best_articles_tfidf", "SELECT month, policy, article_id, title, score, rank FROM prk")
def best_articles_tfidf(spark, sf):
    best = jobs.best_articles_tfidf(articles(spark, sf), WORDS)
    return best.select("month", "policy", "article_id", "title", "score", "rank")


@query("monthly_policy_tfidf", f"""
  SELECT p.*, t.policy AS policy_type
  FROM (SELECT month, {_SCORE_PIVOT} FROM stot GROUP BY month) p JOIN stype t ON t.month = p.month""")
def monthly_policy_tfidf(spark, sf):
    return jobs.monthly_policy_tfidf(articles(spark, sf), WORDS)


@query("term_discovery", """
  SELECT row_number() OVER (ORDER BY word) AS rank, word FROM gwords WHERE NOT regexp_full_match(word, '[0-9]+')""")
def term_discovery(spark, sf):
    found = jobs.term_discovery(articles(spark, sf), lexicon(spark, sf), TAGS)
    return found.select(F.col("rank"), "word")
