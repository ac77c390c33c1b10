"""Article ids, addresses, filters and result documents."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrace.catalog.bindings import ARTICLE_LIST, WORDS, articles, trades
from pricetrace.catalog.registry import query
from pricetrace.functions import columns
from pricetrace.operators import clean, keywords, ranking
from pricetrace.plans import jobs
from pricetrace.schemas import ARTICLE_COLUMNS
from pricetrace.scratch import new_path, stage
from pricetrace.sinks import reports


@query("pad_ids", "SELECT article_id, CASE WHEN length(article_id) < 10 THEN lpad(article_id, 10, '0') ELSE article_id END AS padded FROM art")
def pad_ids(spark, sf):
    return articles(spark, sf).select("article_id", columns.pad_id(F.col("article_id")).alias("padded"))


@query("article_url", """
  SELECT article_id, 'https://n.news.naver.com/mnews/article/' || newspaper_id || '/' || article_id AS article_url FROM art""")
def article_url(spark, sf):
    url = columns.article_url(F.col("newspaper_id"), F.col("article_id"))
    return articles(spark, sf).select("article_id", url.alias("article_url"))


def ranked(spark, sf, top=None):
    counts = keywords.article_counts(articles(spark, sf), WORDS)
    return ranking.rank_articles(stage(keywords.label_articles(counts), "labels"), top)


def rendered_ranks(spark, sf):
    """Ranks as the text columns of the article list files: labels, and "None" where there is no rank."""
    return ranked(spark, sf).select(
        F.col("month").alias("Month"),
        columns.policy_label(F.col("policy")).alias("Policy"),
        F.col("article_id").alias("ID"),
        F.col("cnt").alias("Count"),
        F.coalesce(F.col("rank").cast("string"), F.lit(columns.NO_POLICY)).alias("Rank"),
    )


@query("policy_rank_filter", """
  SELECT month AS "Month", article_id AS "ID", cnt AS "Count", CAST(rank AS VARCHAR) AS "Rank" FROM rnk WHERE policy = 2 AND rank <= 3""")
def policy_rank_filter(spark, sf):
    kept = clean.policy_rank_filter(rendered_ranks(spark, sf), "정책 2", 3, "Policy", "Rank")
    return kept.select("Month", "ID", "Count", "Rank")


@query("semi_join_articles", f"SELECT month, {ARTICLE_LIST} FROM art WHERE article_id IN (SELECT article_id FROM rnk WHERE rank <= 3)")
def semi_join_articles(spark, sf):
    ids = stage(ranked(spark, sf, 3).select("month", "article_id"), "ids")
    return clean.semi_join(articles(spark, sf), ids, ["month", "article_id"]).select("month", *ARTICLE_COLUMNS)


@query("month_documents", f"SELECT target_month AS month, {ARTICLE_LIST}, article_url FROM trc")
def month_documents(spark, sf):
    traced = jobs.trace_articles(trades(spark, sf), articles(spark, sf), WORDS)
    path = new_path(spark, "month-documents")
    reports.write_month_documents(reports.month_documents(traced, "target_month"), path)
    shape = T.StructType([T.StructField(name, T.StringType()) for name in [*ARTICLE_COLUMNS, "article_url"]])
    lines = spark.read.schema("value string, month string").text(path)
    return lines.select("month", F.from_json("value", shape).alias("d")).select("month", "d.*")
