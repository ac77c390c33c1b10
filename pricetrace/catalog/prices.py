"""Prices: parsing, trimming, monthly averages and changes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricetrace.catalog.bindings import trades
from pricetrace.catalog.registry import cte, query
from pricetrace.functions import columns
from pricetrace.operators import prices
from pricetrace.plans import jobs
from pricetrace.sources.tables import read_table


@query("parse_amount", """
  SELECT month, count(*) AS n, CAST(count(CASE WHEN amount < 90000 THEN 1 END) AS BIGINT) AS n_parsed, round(sum(CASE WHEN amount < 90000 THEN amount END), 2) AS total
  FROM trd GROUP BY month""")
def parse_amount(spark, sf):
    written = F.when(F.col("amount") < 90000, F.format_number("amount", 2)).otherwise(F.concat(F.lit("about "), F.format_number("amount", 0)))
    rows = trades(spark, sf).select("month", written.alias("amount_raw"))
    parsed = rows.withColumn("amount", columns.parse_number(F.col("amount_raw")))
    return parsed.groupBy("month").agg(
        F.count("*").alias("n"), F.count("amount").alias("n_parsed"), F.round(F.sum("amount"), 2).alias("total")
    )


@query("price_trim", "SELECT month, series, amount, area, unit_price FROM trim")
def price_trim(spark, sf):
    trimmed = prices.trim_quantiles(prices.with_unit_price(trades(spark, sf)))
    return trimmed.select("month", "series", "amount", "area", "unit_price")


@query("monthly_avg_price", "SELECT month, round(avg_unit_price, 6) AS avg_unit_price FROM mavg")
def monthly_avg_price(spark, sf):
    averages = prices.monthly_average(prices.trim_quantiles(prices.with_unit_price(trades(spark, sf))))
    return averages.select("month", F.round("avg_unit_price", 6).alias("avg_unit_price"))


def _rounded(changes):
    return changes.select(
        "month", "month_idx", F.round("avg_unit_price", 6).alias("avg_unit_price"), F.round("pct_change", 6).alias("pct_change")
    )


@query("monthly_price_change", """
  SELECT month, month_idx, round(avg_unit_price, 6) AS avg_unit_price, round(pct_change, 6) AS pct_change FROM chg""")
def monthly_price_change(spark, sf):
    return _rounded(prices.monthly_price_change(trades(spark, sf)))


_LEVELS = ["region", "district", "quarter"]


def _level_sql(depth: int) -> str:
    """Check SQL of one level: averages of the trimmed trades per region and month, and their changes."""
    names = _LEVELS[:depth]
    keys = "".join(f"{name}, " for name in names)
    shown = "".join(f"{name}, " if name in names else f"NULL AS {name}, " for name in _LEVELS)
    order = f"PARTITION BY {', '.join(names)} ORDER BY month" if names else "ORDER BY month"
    return f"""SELECT {depth} AS level, {shown} month, round(a, 6) AS avg_unit_price, round((a / lag(a) OVER ({order}) - 1) * 100, 6) AS pct_change
      FROM (SELECT {keys} month, avg(unit_price) AS a FROM (SELECT * FROM regions, bnd WHERE unit_price BETWEEN lo AND hi) GROUP BY ALL)"""


cte(regions="""
  SELECT l_returnflag AS region, l_linestatus AS district, CAST(l_linenumber AS VARCHAR) AS quarter, strftime(l_shipdate, '%Y%m') AS month,
    l_extendedprice / nullif(l_quantity, 0) AS unit_price FROM lineitem""")


@query("price_change_by_region_levels", "SELECT * FROM (" + " UNION ALL ".join(f"({_level_sql(depth)})" for depth in range(4)) + ")")
def price_change_by_region_levels(spark, sf):
    columns = "l_extendedprice double, l_quantity double, l_shipdate timestamp_ntz, l_returnflag string, l_linestatus string, l_linenumber int"
    items = read_table(spark, f"{sf}/lineitem.parquet", columns)
    regions = items.select(
        F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("area"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("string").alias("month"),
        F.col("l_returnflag").alias("region"), F.col("l_linestatus").alias("district"), F.col("l_linenumber").cast("string").alias("quarter"),
    )
    changes = prices.price_change_by_levels(regions, _LEVELS)
    return changes.select("level", *_LEVELS, "month", F.round("avg_unit_price", 6).alias("avg_unit_price"), F.round("pct_change", 6).alias("pct_change"))


@query("price_change_range", """
  SELECT month, month_idx, round(avg_unit_price, 6) AS avg_unit_price, round(pct_change, 6) AS pct_change FROM chg
  WHERE month BETWEEN '199601' AND '199912'""")
def price_change_range(spark, sf):
    return _rounded(jobs.price_change_range(trades(spark, sf), "199601", "199912"))


cte(
    sser="SELECT series, month, avg(unit_price) AS a FROM trim GROUP BY ALL",
    schg="SELECT series, month, (a / lag(a) OVER (PARTITION BY series ORDER BY month) - 1) * 100 AS actual FROM sser",
    sprd="SELECT series, actual, lag(actual) OVER (PARTITION BY series ORDER BY month) AS predicted FROM schg",
)


@query("error_metrics", """
  SELECT series, round(sqrt(avg(pow(actual - predicted, 2))), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae
  FROM sprd GROUP BY series""")
def error_metrics(spark, sf):
    changes = prices.monthly_price_change(trades(spark, sf), ["series"])
    before = F.lag("pct_change").over(Window.partitionBy("series").orderBy("month_idx"))
    errors = prices.error_metrics(changes.withColumn("predicted", before), F.col("pct_change"), F.col("predicted"), ["series"])
    return errors.select("series", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


@query("month_scalars", """
  SELECT DISTINCT month, CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 5, 2) AS INTEGER) AS month_idx,
    strftime(strptime(month, '%Y%m'), '%Y-%m-%d') AS first_day,
    strftime(strptime(month, '%Y%m') + INTERVAL 6 MONTH, '%Y%m') AS in_six_months,
    strftime(strptime(month, '%Y%m') - INTERVAL 1 MONTH, '%Y%m') AS month_before,
    strftime(strptime(month, '%Y%m') - INTERVAL 1 DAY, '%Y%m%d') AS day_before
  FROM trd""")
def month_scalars(spark, sf):
    month = F.col("month")
    months = trades(spark, sf).select("month").distinct()
    return months.select(
        "month",
        columns.month_index(month).alias("month_idx"),
        F.date_format(columns.month_start(month), "yyyy-MM-dd").alias("first_day"),
        columns.shift_month(month, 6).alias("in_six_months"),
        columns.month_of_index(columns.month_index(month) - 1).alias("month_before"),
        columns.previous_day(F.concat(month, F.lit("01"))).alias("day_before"),
    )
