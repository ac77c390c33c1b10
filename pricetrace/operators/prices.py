"""Unit prices, whole-dataset quantile trimming and monthly price changes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrace.functions.columns import month_index, parse_number
from pricetrace.scratch import stage

LOW, HIGH = 0.01, 0.99  # fixed values: trimmed tails


def with_unit_price(trades: DataFrame) -> DataFrame:
    """Add `amount` and `unit_price`; unreadable amounts and zero areas give null."""
    amount = F.col("amount") if "amount" in trades.columns else parse_number(F.col("amount_raw"))
    priced = trades.withColumn("amount", amount)
    return priced.withColumn("unit_price", F.try_divide(F.col("amount"), F.col("area")))


def _log_bucket(v: Column) -> Column:
    """Order-preserving bucket number: about one per 0.1 % of magnitude, whatever the range of values."""
    size = F.floor(F.log1p(F.least(F.abs(v), F.lit(1e300))) * 1024)
    return F.when(v >= 0, size).otherwise(-1 - size)


def _values(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(*keys, v, b) of the usable numbers."""
    rows = df.select(*keys, F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    return rows.withColumn("b", _log_bucket(F.col("v")))


def _cells(values: DataFrame, keys: list[str]) -> DataFrame:
    """First pass: (*keys, b, n, total) with the count and the sum per bucket."""
    return stage(values.groupBy(*keys, "b").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "price-cells")


def _edge_buckets(cells: DataFrame, probabilities: list[float]) -> tuple[int, dict[int, int]]:
    """(rows, bucket: rows before it) of the buckets that hold a wanted rank or the one after it; a few whatever the data."""
    counts = cells.groupBy("b").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("upto", F.sum("n").over(Window.orderBy("b"))).withColumn("rows", F.sum("n").over(Window.partitionBy()))
    needed = F.lit(False)
    for p in probabilities:
        first = F.floor(F.lit(p) * (F.col("rows") - 1))
        needed = needed | ((F.col("upto") > first) & (F.col("upto") - F.col("n") <= first + 1))
    found = ranked.where(needed).collect()
    return (found[0]["rows"] if found else 0), {r["b"]: r["upto"] - r["n"] for r in found}


def _edge_values(values: DataFrame, keys: list[str], edges: dict[int, int]) -> DataFrame:
    """Second pass: (*keys, b, v, n) of the values in the edge buckets."""
    near = values.where(F.col("b").isin(list(edges)))
    return stage(near.groupBy(*keys, "b", "v").agg(F.count("*").alias("n")), "edge-values")


def _interpolated(near: DataFrame, rows: int, edges: dict[int, int], probabilities: list[float]) -> list[float]:
    """Quantiles by linear interpolation between the values at the two ranks around each position."""
    first = [math.floor(p * (rows - 1)) for p in probabilities]
    ranks = sorted({r for f in first for r in (f, min(f + 1, rows - 1))})
    counts = near.groupBy("b", "v").agg(F.sum("n").alias("n"))
    before = F.create_map(*[F.lit(x) for pair in edges.items() for x in pair])[F.col("b")]
    upto = counts.withColumn("upto", before + F.sum("n").over(Window.partitionBy("b").orderBy("v")))
    holds = [F.min(F.when((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r), F.col("v"))) for r in ranks]
    at = dict(zip(ranks, upto.agg(*holds).first(), strict=True))
    pairs = [(at[f], at[min(f + 1, rows - 1)], p * (rows - 1) - f) for f, p in zip(first, probabilities, strict=True)]
    return [low + (high - low) * share for low, high, share in pairs]


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles over all rows; only these few numbers reach the driver.

    Spark's `percentile` would keep every distinct value in one buffer. Here one pass counts the rows per bucket of an
    order-preserving numbering and a second one the values inside the few buckets that hold the wanted ranks.
    """
    values = _values(df, column, [])
    rows, edges = _edge_buckets(_cells(values, []), probabilities)
    if not rows:
        return [None] * len(probabilities)
    return _interpolated(_edge_values(values, [], edges), rows, edges, probabilities)


def trimmed_sums(df: DataFrame, keys: list[str], column: str = "unit_price", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(*keys, n, total) of the rows between two quantiles of the whole dataset, in the two passes that find them.

    Buckets between the quantiles' own count with their sums; only the rows of those few are looked at again.
    """
    values = _values(df, column, keys)
    cells = _cells(values, keys)
    rows, edges = _edge_buckets(cells, [low, high])
    if not rows:
        return cells.select(*keys, "n", "total")
    near = _edge_values(values, keys, edges)
    bounds = _interpolated(near, rows, edges, [low, high])
    first, last = (_log_bucket(F.lit(x)) for x in bounds)
    inner = cells.where(~F.col("b").isin(list(edges)) & (F.col("b") >= first) & (F.col("b") <= last)).select(*keys, "n", "total")
    outer = near.where(F.col("v").between(*bounds)).select(*keys, "n", (F.col("v") * F.col("n")).alias("total"))
    return inner.unionByName(outer)


def trimmed_average(df: DataFrame, keys: list[str], column: str = "unit_price", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(*keys, avg_<column>) of the rows between two quantiles of the whole dataset."""
    return trimmed_sums(df, keys, column, low, high).groupBy(*keys).agg((F.sum("total") / F.sum("n")).alias(f"avg_{column}"))


def trim_quantiles(
    df: DataFrame, column: str = "unit_price", low: float = LOW, high: float = HIGH, approx: bool = False
) -> DataFrame:
    """Rows whose value lies between two quantiles of the whole dataset, both ends included; nulls are dropped."""
    if approx:
        wanted = F.array(F.lit(low), F.lit(high))
        bounds = df.agg(F.percentile_approx(column, wanted, 10_000).alias("q")).first()["q"] or (None, None)
    else:
        bounds = exact_quantiles(df, column, [low, high])
    return df.where(F.col(column).between(F.lit(bounds[0]), F.lit(bounds[1])))


def monthly_average(trades: DataFrame, series: list[str] | None = None) -> DataFrame:
    """(*series, month, month_idx, avg_unit_price)."""
    keys = [*(series or []), "month"]
    averages = trades.groupBy(*keys).agg(F.avg("unit_price").alias("avg_unit_price"))
    return averages.withColumn("month_idx", month_index(F.col("month")))


def _series_window(series: list[str] | None):
    """Months of one series in order. There is one row per month, so even a single series is small."""
    return Window.partitionBy(*(series or [])).orderBy("month_idx")


def percent_change(monthly: DataFrame, series: list[str] | None = None, value: str = "avg_unit_price") -> DataFrame:
    """Add `pct_change` against the previous month present; gaps are not filled and the first month has none."""
    previous = F.lag(value).over(_series_window(series))
    return monthly.withColumn("pct_change", (F.try_divide(F.col(value), previous) - 1) * 100)


def monthly_price_change(trades: DataFrame, series: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(*series, month, month_idx, avg_unit_price, pct_change) from trades (amount or amount_raw, area, month)."""
    priced, keys = with_unit_price(trades), [*(series or []), "month"]
    if approx:
        monthly = monthly_average(trim_quantiles(priced, approx=True), series)
    else:
        monthly = trimmed_average(priced, keys).withColumn("month_idx", month_index(F.col("month")))
    changes = percent_change(monthly, series)
    return changes.select(*(series or []), "month", "month_idx", "avg_unit_price", "pct_change")


def price_change_by_levels(trades: DataFrame, levels: list[str]) -> DataFrame:
    """(level, *levels, month, month_idx, avg_unit_price, pct_change) of every region of a hierarchy, the whole being level 0.

    `levels` name columns from the widest region to the narrowest. A region of level k is told by the first k of them, the
    others are null there; a null among the first k names a region of its own. One pass over the trades gives the sums
    per narrowest region and price bucket, from which all levels are added up; trimming is that of the whole dataset.
    """
    sums = trimmed_sums(with_unit_price(trades), [*levels, "month"])
    sets = [[*[F.col(c) for c in levels[:depth]], F.col("month")] for depth in range(len(levels) + 1)]
    level = sum((1 - F.grouping(c) for c in levels), F.lit(0)).cast("int")
    monthly = sums.groupingSets(sets, *levels, "month").agg((F.sum("total") / F.sum("n")).alias("avg_unit_price"), level.alias("level"))
    changes = percent_change(monthly.withColumn("month_idx", month_index(F.col("month"))), ["level", *levels])
    return changes.select("level", *levels, "month", "month_idx", "avg_unit_price", "pct_change")


def month_range(df: DataFrame, start: str, end: str, month: str = "month") -> DataFrame:
    """Rows with start ≤ month ≤ end."""
    if start > end:
        raise ValueError(f"start month {start} lies after end month {end}")
    return df.where(F.col(month).between(start, end))


def error_metrics(df: DataFrame, actual: Column, predicted: Column, keys: list[str] | None = None) -> DataFrame:
    """RMSE and MAE per group."""
    return df.groupBy(*(keys or [])).agg(
        F.sqrt(F.avg(F.pow(actual - predicted, F.lit(2.0)))).alias("rmse"),
        F.avg(F.abs(actual - predicted)).alias("mae"),
    )
