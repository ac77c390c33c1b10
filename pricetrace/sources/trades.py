"""Trade CSV source and the policy map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrace import schemas
from pricetrace.functions.columns import policy_number
from pricetrace.scratch import setting, stage


def header_marks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, mark_a, mark_b): two hashes of each file's header line, equal for different lines only by a chance of 2 ** -128.

    The line is taken as it stands in the file, so the charset does not matter. Hashes are numbers, of which a task keeps
    one pair per file; for the line itself it would have to sort all lines of its files.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value"
    )
    text = F.rtrim("value", F.lit("\r"))
    starts = lines.where("at = 0").select(
        "file", F.monotonically_increasing_id().alias("line"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")
    )
    return starts.groupBy("file").agg(F.min_by("a", "line").alias("mark_a"), F.min_by("b", "line").alias("mark_b"))


def header_groups(spark: SparkSession, paths: str | list[str]) -> list[list[str]]:
    """Files grouped by their header line, in the order of the first file of each group; files without a line are left out.

    Only one short row per file is fetched.
    """
    groups: dict[tuple[int, int], list[str]] = {}
    for row in header_marks(spark, paths).orderBy("file").collect():
        groups.setdefault((row["mark_a"], row["mark_b"]), []).append(row["file"])
    return list(groups.values())


def read_trades(
    spark: SparkSession,
    paths: str | list[str],
    encoding: str = "cp949",
    amount: str = schemas.TRADE_AMOUNT,
    area: str = schemas.TRADE_AREA,
    month: str = schemas.TRADE_MONTH,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Union of the trade files by column name, as (amount_raw, area, month, *keep); a kept column a file lacks is null.

    Files may order their columns differently. The narrow result is stored once, so the text is parsed and decoded once
    however often prices are read. Charsets outside Spark's own list need a session setting, which is on for this job only.
    """
    parts = []
    with setting(spark, "spark.sql.legacy.javaCharsets", "true"):
        for files in header_groups(spark, paths):
            rows = spark.read.option("header", True).option("encoding", encoding).option("escape", '"').csv(files)
            parts.append(rows.select(
                F.col(f"`{amount}`").alias("amount_raw"),
                F.col(f"`{area}`").try_cast("double").alias("area"),
                F.col(f"`{month}`").alias("month"),
                *[F.col(f"`{name}`") for name in keep if name in rows.columns],
            ))
        if not parts:
            names = ["amount_raw string", "area double", "month string", *[f"`{name}` string" for name in keep]]
            return spark.createDataFrame([], ", ".join(names))
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        for name in keep:
            if name not in union.columns:
                union = union.withColumn(name, F.lit(None).cast("string"))
        return stage(union.select("amount_raw", "area", "month", *keep), "trades")


def read_policy_map(spark: SparkSession, path: str) -> DataFrame:
    """(month, policy) from the two named columns of the map file; the literal "None" becomes null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(
        F.col(schemas.MAP_MONTH).alias("month"),
        policy_number(F.col(schemas.MAP_POLICY)).alias("policy"),
    )
