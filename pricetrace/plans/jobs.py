"""End-to-end jobs composed of the operators; each reads the texts once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pricetrace.functions.columns import article_url
from pricetrace.keyword_sets import Keywords
from pricetrace.operators import effects, keywords, monthly, prices, ranking, tfidf
from pricetrace.schemas import ARTICLE_COLUMNS
from pricetrace.scratch import Staged, stage


def monthly_policy_analysis(
    articles: DataFrame,
    words: Keywords,
    approx: bool = True,
    merge: Mapping[int, int] | None = monthly.MERGE_3_4,
    n: int = monthly.TOP_COUNTS,
) -> DataFrame:
    """(month, policy_1.., policy_type): weighted keyword counts per month and the type they decide."""
    counts = stage(keywords.weighted_counts(keywords.article_counts(articles, words)), "month-counts")
    types = monthly.assign_policy_type(counts, n, approx=approx, merge=merge)
    return monthly.month_policy_pivot(counts, sorted(words)).join(types, "month")


def article_ranking(articles: DataFrame, words: Keywords) -> DataFrame:
    """(month, policy, article_id, cnt, rank) of all articles."""
    labelled = stage(keywords.label_articles(keywords.article_counts(articles, words)), "labels")
    return ranking.rank_articles(labelled)


def best_articles_tfidf(articles: DataFrame, words: Keywords, n: int = 3) -> DataFrame:
    """(month, policy, article_id, title, score, rank): best-scored articles per month and policy."""
    scored = tfidf.article_policy_tfidf(articles, words).withColumn("_row", F.monotonically_increasing_id())
    scored = stage(scored, "article-scores")
    # Ranks are decided on rows without texts; titles are fetched for the ranked ones.
    ranked = ranking.top_rank(scored.select("_row", "month", F.inline("scores")), n)
    found = ranked.join(scored.select("_row", "article_id", "title"), "_row")
    return found.select("month", "policy", "article_id", "title", "score", "rank")


def monthly_policy_tfidf(articles: DataFrame, words: Keywords, n: int = monthly.TOP_SCORES) -> DataFrame:
    """(month, policy_1.., policy_type) from TF-IDF totals at four digits."""
    totals = tfidf.tfidf_policy_totals(articles, words).withColumn("score", F.round("score", 4))
    totals = stage(totals, "month-scores")
    types = monthly.assign_policy_type(totals, n, "score")
    return monthly.month_policy_pivot(totals, sorted(words), "score").join(types, "month")


def term_discovery(articles: DataFrame, lexicon: DataFrame, tags: list[str]) -> DataFrame:
    """(rank, word): distinct words of the terms that lead the months, numbered in alphabetical order."""
    tagged = keywords.tag_filter(articles, lexicon, tags)
    terms = tfidf.top_terms_month(tfidf.gram_counts(tagged, 2, 3, min_length=2))
    frequencies = tfidf.term_month_frequency(terms)
    lines = frequencies.select(F.concat_ws(" ", F.lit("0."), "term", F.col("cnt").cast("string")).alias("value"))
    return ranking.enumerate_rows(tfidf.distinct_words(lines), [F.asc("word")])


def price_change_range(trades: DataFrame, start: str, end: str) -> DataFrame:
    """Monthly changes of the chosen months; trimming and changes come from the whole dataset."""
    return prices.month_range(prices.monthly_price_change(trades), start, end)


def target_winners(labelled: DataFrame, as_of: bool = False, series: list[str] | None = None) -> DataFrame:
    """(*series, target_month, month, policy, avg_change) for all target months that have a candidate."""
    known = effects.policy_effect(labelled, series=series)
    return effects.effect_winner(effects.join_lag_effect(labelled, known, as_of=as_of, series=series), series)


def trace_articles(
    trades: DataFrame, articles: DataFrame, words: Keywords, target_month: str | None = None, top: int = 3, as_of: bool = False,
    observation: Observation | None = None, series: list[str] | None = None,
) -> DataFrame:
    """(*series, target_month, month, policy, rank, cnt, article columns, article_url).

    For every target month: the policy month before it with the strongest price effect, and that
    month's top-ranked articles on the policy. Only narrow counts of the texts are kept between the
    steps; the article rows themselves are met once, by a table of the picked ids. `observation` receives the number of
    rows (`articles`) and of those with a body (`with_body`) when the result is first computed. `series` names columns of the
    trades, a region for instance, that are traced each on its own.
    """
    keys = series or []
    counts = Staged(keywords.article_counts(articles, words), "article-counts")
    types = monthly.assign_policy_type(keywords.weighted_counts(counts.df))
    changes = stage(effects.join_change_policy(prices.monthly_price_change(trades, series), types), "changes")
    winners = target_winners(changes, as_of, series)
    if target_month is not None:
        winners = winners.where(F.col("target_month") == target_month)
    # Labels are needed only in the months and policies that won.
    labelled = keywords.label_articles(counts.df).join(winners.select("month", "policy").distinct(), ["month", "policy"], "left_semi")
    ranked = ranking.rank_articles(labelled, top)
    # An id may stand for several article rows; each of them is met once per target month.
    picks = winners.join(ranked, ["month", "policy"]).groupBy(*keys, "target_month", "month", "policy", "article_id")
    picks = stage(picks.agg(F.min("rank").alias("rank"), F.max("cnt").alias("cnt")), "picks")
    counts.discard()
    # The filter says nothing new, but with it the planner prunes the months of the articles by those of the picks.
    chosen = picks.where(F.col("rank") <= top)
    if target_month is not None:
        chosen = chosen.where(F.col("target_month") == target_month)
    url = article_url(F.col("newspaper_id"), F.col("article_id"))
    traced = articles.join(chosen, ["month", "article_id"]).select(
        *keys, "target_month", "month", "policy", "rank", "cnt", *ARTICLE_COLUMNS, url.alias("article_url")
    )
    if observation is None:
        return traced
    return traced.observe(observation, F.count("*").alias("articles"), F.count("content_text").alias("with_body"))
