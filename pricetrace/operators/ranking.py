"""Ranks whose groups may be huge, and running numbers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetrace.scratch import stage


def rank_by_value(df: DataFrame, keys: list[str], value: str, method: str = "dense", top: int | None = None) -> DataFrame:
    """Descending rank of `value` within `keys`, as column `rank`; rows with a null key or value are left out.

    A window over the rows would put a hot group into one task. Equal values share their rank, so the
    rows are first counted per distinct value, only those few counts are ranked, and the ranks are
    joined back. `method` is `dense` or `min` (gaps after ties). `df` is read twice: stage it first if
    it is expensive.
    """
    present = df.dropna(subset=[*keys, value])
    counts = present.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ordered = Window.partitionBy(*keys).orderBy(F.desc(value))
    if top is not None:
        # Rank ≤ top needs at most `top` distinct values; the limit is applied before the shuffle as well.
        counts = counts.withColumn("_r", F.row_number().over(ordered)).where(F.col("_r") <= top).drop("_r")
    if method == "dense":
        rank = F.dense_rank().over(ordered)
    elif method == "min":
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        rank = (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).cast("int")
    else:
        raise ValueError(f"unknown rank method: {method}")
    ranks = counts.withColumn("rank", rank)
    if top is not None:
        ranks = ranks.where(F.col("rank") <= top)
    return present.join(ranks.drop("_n"), [*keys, value])


def rank_articles(labelled: DataFrame, top: int | None = None) -> DataFrame:
    """(month, policy, article_id, cnt, rank): dense rank by count within month and policy.

    Articles without a policy keep a null rank; with `top` they are left out like all ranks beyond it.
    """
    ranked = rank_by_value(labelled, ["month", "policy"], "cnt", "dense", top)
    columns = ["month", "policy", "article_id", "cnt", "rank"]
    if top is not None:
        return ranked.select(*columns)
    unranked = labelled.where(F.col("policy").isNull()).withColumn("rank", F.lit(None).cast("int"))
    return ranked.select(*columns).unionByName(unranked.select(*columns))


def top_rows(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first `n` rows per group by row number; each task cuts its part to `n` rows before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def top_rank(scores: DataFrame, n: int = 3, digits: int = 4) -> DataFrame:
    """(month, policy, article_id, title, score, rank): best `n` ranks per month and policy, ties kept, gaps after ties.

    Scores are rounded to the digits that the score reports carry; those that are no numbers are dropped.
    """
    usable = scores.where(~F.isnan("score")).withColumn("score", F.round("score", digits))
    return rank_by_value(usable, ["month", "policy"], "score", "min", n)


def top_n_articles(scores: DataFrame, n: int = 3, digits: int = 4) -> DataFrame:
    """Best `n` articles per policy over the whole input; equal scores are ordered by article id."""
    usable = scores.dropna(subset=["article_id", "title", "score"]).where(~F.isnan("score"))
    rounded = usable.withColumn("score", F.round("score", digits))
    return top_rows(rounded, ["policy"], [F.desc("score"), F.asc("article_id")], n)


def enumerate_rows(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Running number from 1 in the given total order, without a single-task window.

    The rows are range partitioned, numbered inside each partition and shifted by the sizes of the
    partitions before it. Only those sizes pass through one task.
    """
    parts = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = parts.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    numbered = local.join(offsets, "_part")
    return numbered.withColumn(name, (F.col("_row") + F.col("_offset")).cast("long")).drop("_part", "_row", "_offset")
