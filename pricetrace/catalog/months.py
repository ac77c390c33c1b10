"""Monthly sums, medians, thresholds, policy types and their effects on prices."""

from pyspark.sql import functions as F

from pricetrace.catalog.bindings import POLICIES, WORDS, articles, trades
from pricetrace.catalog.registry import cte, query
from pricetrace.operators import clean, effects, keywords, monthly, prices
from pricetrace.scratch import stage


def month_counts(spark, sf):
    counts = keywords.weighted_counts(keywords.article_counts(articles(spark, sf), WORDS))
    return stage(counts, "month-counts")


def file_counts(spark, sf):
    """Counts per source as if each newspaper had its own file in a month: several rows per month and policy."""
    art = articles(spark, sf).withColumn("month", F.concat("month", F.lit("|"), "newspaper_id"))
    counts = keywords.weighted_counts(keywords.article_counts(art, WORDS))
    return stage(counts.withColumn("month", F.substring_index("month", "|", 1)), "file-counts")


cte(
    fcnt="""
      SELECT f.month, CAST(f.policy AS INTEGER) AS policy, CAST(coalesce(sum(h.weight), 0) AS BIGINT) AS cnt
      FROM (SELECT DISTINCT a.month, a.newspaper_id, p.policy FROM art a, pol p) f
      LEFT JOIN (SELECT a.month, a.newspaper_id, k.policy, x.weight FROM (
          SELECT article_id, w, 1 AS weight FROM btok UNION ALL SELECT article_id, w, 2 FROM ttok) x
        JOIN kw k ON k.word = x.w JOIN art a ON a.article_id = x.article_id) h
        ON h.month = f.month AND h.newspaper_id = f.newspaper_id AND h.policy = f.policy
      GROUP BY f.month, f.newspaper_id, f.policy""",
    amed="SELECT policy, quantile_disc(cnt, 0.5) AS median FROM wcnt GROUP BY policy",
    atype="""
      SELECT m.month, CAST(b.policy AS INTEGER) AS policy FROM (SELECT DISTINCT month FROM wcnt) m LEFT JOIN (
        SELECT c.month, c.policy,
          row_number() OVER (PARTITION BY c.month ORDER BY c.cnt DESC, c.policy) AS r
        FROM wcnt c JOIN amed ON amed.policy = c.policy JOIN thr ON thr.policy = c.policy
        WHERE c.cnt > amed.median AND c.cnt >= thr.threshold) b ON b.month = m.month AND b.r = 1""",
)


@query("month_policy_sum", "SELECT month, policy, CAST(sum(cnt) AS BIGINT) AS cnt FROM fcnt GROUP BY ALL")
def month_policy_sum(spark, sf):
    return monthly.month_policy_sum(file_counts(spark, sf))


@query("month_policy_pivot", """
  SELECT month, CAST(sum(CASE WHEN policy = 1 THEN cnt ELSE 0 END) AS BIGINT) AS policy_1,
    CAST(sum(CASE WHEN policy = 2 THEN cnt ELSE 0 END) AS BIGINT) AS policy_2,
    CAST(sum(CASE WHEN policy = 3 THEN cnt ELSE 0 END) AS BIGINT) AS policy_3,
    CAST(sum(CASE WHEN policy = 4 THEN cnt ELSE 0 END) AS BIGINT) AS policy_4,
    CAST(0 AS BIGINT) AS policy_5
  FROM wcnt GROUP BY month""")
def month_policy_pivot(spark, sf):
    return monthly.month_policy_pivot(month_counts(spark, sf), [*POLICIES, 5])


@query("policy_median", "SELECT policy, CAST(median(cnt) AS DOUBLE) AS median FROM fcnt GROUP BY policy")
def policy_median(spark, sf):
    return monthly.policy_median(file_counts(spark, sf))


@query("policy_median_approx", "SELECT policy, CAST(median AS BIGINT) AS median FROM amed")
def policy_median_approx(spark, sf):
    return monthly.policy_median(monthly.month_policy_sum(month_counts(spark, sf)), approx=True)


@query("topn_threshold", "SELECT policy, CAST(threshold AS BIGINT) AS threshold FROM thr")
def topn_threshold(spark, sf):
    return monthly.topn_threshold(month_counts(spark, sf))


@query("assign_policy_type", "SELECT month, policy AS policy_type FROM ptype")
def assign_policy_type(spark, sf):
    return monthly.assign_policy_type(month_counts(spark, sf))


@query("assign_policy_type_approx", "SELECT month, policy AS policy_type FROM atype")
def assign_policy_type_approx(spark, sf):
    return monthly.assign_policy_type(month_counts(spark, sf), approx=True)


@query("assign_policy_type_merged", """
  SELECT month, CAST(CASE WHEN policy IN (3, 4) THEN 3 ELSE policy END AS INTEGER) AS policy_type FROM ptype""")
def assign_policy_type_merged(spark, sf):
    return monthly.assign_policy_type(month_counts(spark, sf), merge=monthly.MERGE_3_4)


cte(
    amax="""
      SELECT month, policy FROM (
        SELECT month, policy, row_number() OVER (PARTITION BY month ORDER BY cnt DESC, policy) AS r FROM wcnt) WHERE r = 1""",
)


@query("month_argmax", "SELECT month, policy FROM amax")
def month_argmax(spark, sf):
    return monthly.month_argmax(month_counts(spark, sf))


@query("policy_wins", """
  SELECT CAST(coalesce(policy, 0) AS INTEGER) AS policy, count(*) AS months FROM amax GROUP BY ROLLUP (policy)""")
def policy_wins(spark, sf):
    wins = monthly.policy_wins(monthly.month_argmax(month_counts(spark, sf)))
    return wins.select(F.coalesce("policy", F.lit(0)).alias("policy"), "months")


@query("distinct_months", "SELECT DISTINCT month FROM art")
def distinct_months(spark, sf):
    return monthly.distinct_months(articles(spark, sf))


@query("union_months", """
  SELECT month, policy, CAST(cnt AS BIGINT) AS cnt FROM wcnt""")
def union_months(spark, sf):
    counts = month_counts(spark, sf)
    years = [counts.where(F.col("month") < "199801"), counts.where(F.col("month") >= "199801").select("policy", "cnt", "month")]
    return clean.union_all(*years).select("month", "policy", "cnt")


def labelled_changes(spark, sf):
    changes = prices.monthly_price_change(trades(spark, sf))
    types = monthly.assign_policy_type(month_counts(spark, sf))
    return stage(effects.join_change_policy(changes, types), "labelled-changes")


@query("join_change_policy", "SELECT month, month_idx, round(pct_change, 6) AS pct_change, policy FROM cpol")
def join_change_policy(spark, sf):
    rows = labelled_changes(spark, sf)
    return rows.select("month", "month_idx", F.round("pct_change", 6).alias("pct_change"), "policy")


_EFFECT_SQL = "SELECT policy, start_month, start_idx, period, round(avg_change, 6) AS avg_change FROM eff"


def _effect_rows(rows):
    return rows.select("policy", "start_month", "start_idx", "period", F.round("avg_change", 6).alias("avg_change"))


@query("policy_effect", _EFFECT_SQL)
def policy_effect(spark, sf):
    return _effect_rows(effects.policy_effect(labelled_changes(spark, sf)))


@query("forward_range_join", _EFFECT_SQL)
def forward_range_join(spark, sf):
    return _effect_rows(effects.forward_range_join(labelled_changes(spark, sf)))


@query("join_lag_effect", """
  SELECT target_month, month, policy, CAST(lag AS INTEGER) AS lag, start_month, round(avg_change, 6) AS avg_change FROM cand""")
def join_lag_effect(spark, sf):
    rows = labelled_changes(spark, sf)
    candidates = effects.join_lag_effect(rows, effects.policy_effect(rows))
    return candidates.select("target_month", "month", "policy", "lag", "start_month", F.round("avg_change", 6).alias("avg_change"))


@query("effect_winner", "SELECT target_month, month, policy, round(avg_change, 6) AS avg_change FROM win")
def effect_winner(spark, sf):
    rows = labelled_changes(spark, sf)
    winners = effects.effect_winner(effects.join_lag_effect(rows, effects.policy_effect(rows)))
    return winners.select("target_month", "month", "policy", F.round("avg_change", 6).alias("avg_change"))


@query("asof_policy", """
  SELECT month, last_value(policy IGNORE NULLS) OVER (ORDER BY month_idx ROWS UNBOUNDED PRECEDING) AS policy FROM cpol""")
def asof_policy(spark, sf):
    return effects.asof_policy(labelled_changes(spark, sf))
