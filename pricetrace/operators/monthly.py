"""Monthly decisions: which policy type a month belongs to.

Inputs are (month, policy, value) rows. They are few (months × policies), but usually stand behind a
pass over all texts, so callers stage them before using them here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrace.operators.ranking import top_rows

MERGE_3_4 = {3: 3, 4: 3}  # fixed value: labels merged by the monthly job
TOP_COUNTS, TOP_SCORES = 5, 10  # fixed values


def month_policy_sum(counts: DataFrame, value: str = "cnt") -> DataFrame:
    return counts.groupBy("month", "policy").agg(F.sum(value).alias(value))


def month_policy_pivot(counts: DataFrame, policies: list[int], value: str = "cnt", prefix: str = "policy_") -> DataFrame:
    """One row per month with a column per policy; policies without rows get zeros."""
    wide = counts.groupBy("month").pivot("policy", policies).agg(F.sum(value)).fillna(0)
    return wide.select("month", *[F.col(f"`{p}`").alias(f"{prefix}{p}") for p in policies])


def policy_median(counts: DataFrame, value: str = "cnt", approx: bool = False) -> DataFrame:
    """(policy, median): interpolated over the rows given, or the lower middle element with `approx`."""
    middle = F.percentile_approx(value, 0.5, 1000) if approx else F.median(value)
    return counts.groupBy("policy").agg(middle.alias("median"))


def topn_threshold(sums: DataFrame, n: int = TOP_COUNTS, value: str = "cnt") -> DataFrame:
    """(policy, threshold): the n-th largest value counting duplicates, or the smallest when there are fewer."""
    largest = top_rows(sums, ["policy"], [F.desc(value), F.asc("month")], n, "_r")
    return largest.groupBy("policy").agg(F.min(value).alias("threshold"))


def _largest(value: str) -> Column:
    """Policy of the largest value; ties go to the lowest number."""
    return -F.max(F.struct(F.col(value), (-F.col("policy")).alias("neg")))["neg"]


def merge_labels(policy: Column, merge: Mapping[int, int] | None) -> Column:
    for old, new in (merge or {}).items():
        if old != new:
            policy = F.when(policy == old, new).otherwise(policy)
    return policy


def assign_policy_type(
    counts: DataFrame,
    n: int = TOP_COUNTS,
    value: str = "cnt",
    approx: bool = False,
    merge: Mapping[int, int] | None = None,
) -> DataFrame:
    """(month, policy_type): the month's policy, or null.

    Candidates lie above their policy's median and reach its top-n threshold; the largest value wins.
    The exact median is taken over the rows given (one per file), the approximate one over month sums.
    Labels are merged after the choice.
    """
    sums = month_policy_sum(counts, value)
    medians = policy_median(sums if approx else counts, value, approx)
    of_policy = Window.partitionBy("policy")
    place = F.row_number().over(of_policy.orderBy(F.desc(value), F.asc("month")))
    ranked = sums.withColumn("_place", place).withColumn(
        "threshold", F.min(F.when(F.col("_place") <= n, F.col(value))).over(of_policy)
    )
    passed = (F.col(value) > F.col("median")) & (F.col(value) >= F.col("threshold"))
    candidate = F.when(passed, F.struct(F.col(value), (-F.col("policy")).alias("neg")))
    winners = ranked.join(medians, "policy").groupBy("month").agg((-F.max(candidate)["neg"]).alias("policy_type"))
    return winners.select("month", merge_labels(F.col("policy_type"), merge).cast("int").alias("policy_type"))


def month_argmax(counts: DataFrame, value: str = "cnt") -> DataFrame:
    """(month, policy): the largest policy of every month; an all-zero month gives the lowest number."""
    return counts.groupBy("month").agg(_largest(value).alias("policy"))


def policy_wins(argmax: DataFrame) -> DataFrame:
    """(policy, months): months won per policy; the row with a null policy is the total."""
    return argmax.rollup("policy").agg(F.count("*").alias("months"))


def distinct_months(df: DataFrame) -> DataFrame:
    """(month): the months present."""
    return df.select("month").distinct()
