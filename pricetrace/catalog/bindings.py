"""The given tables seen as articles, trades, pages and keyword tables, in Spark and in check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrace.catalog.registry import cte
from pricetrace.keyword_sets import Keywords
from pricetrace.schemas import ARTICLE_COLUMNS
from pricetrace.sources.tables import read_table

WORDS: Keywords = {
    1: ["that", "was", "with", "of the"],
    2: ["pour", "une", "dans", "est"],
    3: ["und", "nicht", "sich", "LTV"],
    4: ["los", "para", "una", "por"],
}
POLICIES = sorted(WORDS)
TAGS = ["NNG", "NNP", "VV", "VA"]
MONTHS = 83


def articles(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, f"{sf}/documents.parquet", "doc_id bigint, text string, lang string, source string")
    day = F.add_months(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % MONTHS).cast("int"))
    nothing = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("string").alias("article_id"),
        F.col("lang").alias("section_id"),
        nothing.alias("sub_section_id"),
        F.col("source").alias("newspaper_id"),
        F.concat(F.lit("paper "), F.col("source")).alias("newspaper_name"),
        F.substring_index("text", "\n", 1).alias("title"),
        nothing.alias("journalist_name"),
        F.date_format(day, "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        nothing.alias("updated_at"),
        F.concat(F.lit("<article>"), F.col("text"), F.lit("</article>")).alias("content_origin"),
        F.col("text").alias("content_text"),
        F.date_format(day, "yyyyMM").alias("month"),
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    columns = "l_extendedprice double, l_quantity double, l_shipdate timestamp_ntz, l_returnflag string"
    items = read_table(spark, f"{sf}/lineitem.parquet", columns)
    return items.select(
        F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("area"),
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("string").alias("month"),
        F.col("l_returnflag").alias("series"),
    )


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, f"{sf}/pages.parquet", "page_id bigint, url string, html string")


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """(word, tag) of all title words; the tag follows from the word's length."""
    from pricetrace.functions.text import tokens

    words = articles(spark, sf).select(F.explode(tokens(F.col("title"))).alias("word")).distinct()
    tags = F.array(*[F.lit(t) for t in [*TAGS, "JX"]])
    return words.select("word", F.get(tags, F.length("word") % 5).alias("tag"))


TOKEN = r"[\p{L}\p{N}_]+"
ARTICLE_LIST = ", ".join(ARTICLE_COLUMNS)

cte(
    kw="SELECT * FROM (VALUES " + ", ".join(f"({p}, '{w}')" for p in POLICIES for w in WORDS[p]) + ") AS t(policy, word)",
    pol="SELECT DISTINCT policy FROM kw",
    art="""
      SELECT CAST(doc_id AS VARCHAR) AS article_id, lang AS section_id, CAST(NULL AS VARCHAR) AS sub_section_id,
        source AS newspaper_id, 'paper ' || source AS newspaper_name, split_part(text, chr(10), 1) AS title,
        CAST(NULL AS VARCHAR) AS journalist_name,
        strftime(DATE '1995-01-01' + to_months(CAST(doc_id % 83 AS INTEGER)), '%Y-%m-%d 00:00:00') AS created_at,
        CAST(NULL AS VARCHAR) AS updated_at, '<article>' || text || '</article>' AS content_origin, text AS content_text,
        strftime(DATE '1995-01-01' + to_months(CAST(doc_id % 83 AS INTEGER)), '%Y%m') AS month
      FROM documents""",
    trd="""
      SELECT l_extendedprice AS amount, l_quantity AS area, strftime(l_shipdate, '%Y%m') AS month,
        l_returnflag AS series, l_extendedprice / nullif(l_quantity, 0) AS unit_price
      FROM lineitem""",
    btok=f"SELECT month, article_id, unnest(regexp_extract_all(content_text, '{TOKEN}')) AS w FROM art",
    ttok=f"SELECT month, article_id, unnest(regexp_extract_all(title, '{TOKEN}')) AS w FROM art",
    grid="SELECT m.month, p.policy FROM (SELECT DISTINCT month FROM art) m, pol p",
    # weighted keyword counts per month
    wtok="SELECT month, w, 1 AS weight FROM btok UNION ALL SELECT month, w, 2 AS weight FROM ttok",
    whit="SELECT t.month, k.policy, sum(t.weight) AS cnt FROM wtok t JOIN kw k ON t.w = k.word GROUP BY ALL",
    wcnt="""
      SELECT g.month, CAST(g.policy AS INTEGER) AS policy, CAST(coalesce(h.cnt, 0) AS BIGINT) AS cnt
      FROM grid g LEFT JOIN whit h ON h.month = g.month AND h.policy = g.policy""",
    # monthly policy type from weighted counts
    med="SELECT policy, median(cnt) AS median FROM wcnt GROUP BY policy",
    thr="""
      SELECT policy, min(cnt) AS threshold FROM (
        SELECT policy, cnt, row_number() OVER (PARTITION BY policy ORDER BY cnt DESC, month) AS r FROM wcnt)
      WHERE r <= 5 GROUP BY policy""",
    ptype="""
      SELECT m.month, CAST(b.policy AS INTEGER) AS policy FROM (SELECT DISTINCT month FROM wcnt) m LEFT JOIN (
        SELECT c.month, c.policy,
          row_number() OVER (PARTITION BY c.month ORDER BY c.cnt DESC, c.policy) AS r
        FROM wcnt c JOIN med ON med.policy = c.policy JOIN thr ON thr.policy = c.policy
        WHERE c.cnt > med.median AND c.cnt >= thr.threshold) b ON b.month = m.month AND b.r = 1""",
    # per-article counts, labels and ranks
    ahit="SELECT b.article_id, k.policy, count(*) AS cnt FROM btok b JOIN kw k ON b.w = k.word GROUP BY ALL",
    acnt="""
      SELECT a.month, a.article_id, CAST(p.policy AS INTEGER) AS policy, coalesce(h.cnt, 0) AS cnt
      FROM art a CROSS JOIN pol p LEFT JOIN ahit h ON h.article_id = a.article_id AND h.policy = p.policy""",
    lab="""
      SELECT month, article_id, CASE WHEN cnt > 0 THEN policy END AS policy, cnt FROM (
        SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY cnt DESC, policy) AS r FROM acnt) WHERE r = 1""",
    rnk="""
      SELECT month, policy, article_id, cnt, CASE WHEN policy IS NOT NULL THEN
        CAST(dense_rank() OVER (PARTITION BY month, policy ORDER BY cnt DESC) AS INTEGER) END AS rank FROM lab""",
    # prices
    bnd="SELECT quantile_cont(unit_price, 0.01) AS lo, quantile_cont(unit_price, 0.99) AS hi FROM trd",
    trim="SELECT t.* FROM trd t, bnd b WHERE t.unit_price BETWEEN b.lo AND b.hi",
    mavg="SELECT month, avg(unit_price) AS avg_unit_price FROM trim GROUP BY month",
    chg="""
      SELECT month, CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 5, 2) AS INTEGER) AS month_idx,
        avg_unit_price, (avg_unit_price / lag(avg_unit_price) OVER (ORDER BY month) - 1) * 100 AS pct_change FROM mavg""",
    # effects
    cpol="SELECT c.month, c.month_idx, c.pct_change, p.policy FROM chg c LEFT JOIN ptype p ON p.month = c.month",
    per="SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS period",
    eff="""
      SELECT s.policy, s.month AS start_month, s.month_idx AS start_idx, per.period, avg(f.pct_change) AS avg_change
      FROM cpol s, per, cpol f
      WHERE s.policy IS NOT NULL AND f.month_idx > s.month_idx AND f.month_idx <= s.month_idx + per.period
      GROUP BY ALL""",
    cand="""
      SELECT t.month AS target_month, c.month, c.policy, t.month_idx - c.month_idx AS lag, e.start_month, e.avg_change
      FROM cpol t JOIN cpol c ON c.policy IS NOT NULL AND t.month_idx - c.month_idx BETWEEN 1 AND 6
      LEFT JOIN eff e ON e.policy = c.policy AND e.period = t.month_idx - c.month_idx""",
    win="""
      SELECT target_month, month, policy, avg_change FROM (
        SELECT *, row_number() OVER (PARTITION BY target_month
          ORDER BY round(abs(avg_change), 9) DESC NULLS LAST, month, policy, start_month) AS r FROM cand) WHERE r = 1""",
    trc="""
      SELECT w.target_month, w.month, w.policy, r.rank, r.cnt, a.* EXCLUDE (month),
        'https://n.news.naver.com/mnews/article/' || a.newspaper_id || '/' || a.article_id AS article_url
      FROM win w JOIN rnk r ON r.month = w.month AND r.policy = w.policy AND r.rank <= 3
      JOIN art a ON a.article_id = r.article_id""",
)
