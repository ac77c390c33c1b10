"""Price effects of policies in the months after them, and the likeliest policy behind a month.

All inputs hold one row per month (or per policy month), so the windows here stay small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrace.functions.columns import round_key

HORIZON = 6  # fixed value: months an effect may last


def join_change_policy(changes: DataFrame, policy_map: DataFrame) -> DataFrame:
    """Every month's change with its policy type, null when the month has none."""
    return changes.join(policy_map.select("month", F.col("policy_type").alias("policy")), "month", "left")


def policy_effect(labelled: DataFrame, periods: int = HORIZON, series: list[str] | None = None) -> DataFrame:
    """(*series, policy, start_month, start_idx, period, avg_change): one row per policy month and period.

    The change is averaged over the months after the start up to `period` months later. A period
    without any month gives no row; months without a change are ignored.
    """
    keys = series or []
    months = Window.partitionBy(*keys).orderBy("month_idx")
    frames = [
        F.struct(
            F.lit(k).alias("period"),
            F.avg("pct_change").over(months.rangeBetween(1, k)).alias("avg_change"),
            F.count("month_idx").over(months.rangeBetween(1, k)).alias("n"),
        )
        for k in range(1, periods + 1)
    ]
    ahead = labelled.withColumn("frames", F.array(*frames)).where(F.col("policy").isNotNull())
    return ahead.select(
        *keys, "policy", F.col("month").alias("start_month"), F.col("month_idx").alias("start_idx"), F.inline("frames")
    ).where(F.col("n") > 0).drop("n")


def forward_range_join(labelled: DataFrame, periods: int = HORIZON, series: list[str] | None = None) -> DataFrame:
    """The same effects by an equi-join on every month a period can reach, instead of a range condition."""
    keys = series or []
    starts = labelled.where(F.col("policy").isNotNull()).select(
        *keys, "policy", F.col("month").alias("start_month"), F.col("month_idx").alias("start_idx")
    )
    reach = starts.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(periods)))).withColumn("_idx", F.col("start_idx") + F.col("lead"))
    pairs = reach.join(labelled.select(*keys, F.col("month_idx").alias("_idx"), "pct_change"), [*keys, "_idx"])
    covered = pairs.withColumn("period", F.explode(F.sequence(F.col("lead"), F.lit(periods))))
    return covered.groupBy(*keys, "policy", "start_month", "start_idx", "period").agg(F.avg("pct_change").alias("avg_change"))


def join_lag_effect(
    labelled: DataFrame, effects: DataFrame, targets: DataFrame | None = None, periods: int = HORIZON, as_of: bool = False,
    series: list[str] | None = None,
) -> DataFrame:
    """(*series, target_month, target_idx, month, policy, lag, start_month, avg_change): candidates of every target month.

    A candidate is a policy month one to `periods` months before the target. It meets each occurrence
    of its policy with the same period, so rows multiply. Targets default to all months present.
    Effects may lie after the target; `as_of=True` keeps those that end no later than it. With `series`, all of it
    happens within a series; a null in their columns names a series like any other value.
    """
    keys = series or []
    if targets is None:
        targets = labelled.select(*keys, "month", "month_idx")
    targets = targets.select(*keys, F.col("month").alias("target_month"), F.col("month_idx").alias("target_idx"))
    back = targets.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(periods)))).withColumn("month_idx", F.col("target_idx") - F.col("lag"))
    policies = labelled.where(F.col("policy").isNotNull()).select(*keys, "month", "month_idx", "policy")

    def same_series(left: str, right: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}")) for key in keys], F.lit(True))

    met = back.alias("t").join(policies.alias("p"), (F.col("t.month_idx") == F.col("p.month_idx")) & same_series("t", "p"))
    candidates = met.select(*[F.col(f"t.{key}") for key in keys], "target_month", "target_idx", "lag", "p.month", "p.policy").alias("c")
    known = effects.alias("e")
    on = (F.col("c.policy") == F.col("e.policy")) & (F.col("c.lag") == F.col("e.period")) & same_series("c", "e")
    if as_of:
        on = on & (F.col("e.start_idx") + F.col("e.period") <= F.col("c.target_idx"))
    return candidates.join(known, on, "left").select(
        *[F.col(f"c.{key}") for key in keys], "target_month", "target_idx", "month", "c.policy", "lag", "start_month", "avg_change"
    )


def effect_winner(candidates: DataFrame, series: list[str] | None = None) -> DataFrame:
    """(*series, target_month, month, policy, avg_change): the candidate with the largest absolute effect.

    Missing effects come last; ties go to the earlier month, then to the lower policy.
    """
    keys = series or []
    strength = round_key(F.abs("avg_change"))
    best = Window.partitionBy(*keys, "target_month").orderBy(
        F.desc_nulls_last("_strength"), F.asc("month"), F.asc("policy"), F.asc("start_month")
    )
    ranked = candidates.withColumn("_strength", strength).withColumn("_r", F.row_number().over(best))
    return ranked.where(F.col("_r") == 1).select(*keys, "target_month", "month", "policy", "avg_change")


def asof_policy(labelled: DataFrame, series: list[str] | None = None) -> DataFrame:
    """(*series, month, policy): per month the latest policy at or before it, null before the first."""
    keys = series or []
    upto = Window.partitionBy(*keys).orderBy("month_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return labelled.select(*keys, "month", F.last("policy", ignorenulls=True).over(upto).alias("policy"))
