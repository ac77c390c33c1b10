"""CSV, month-partitioned and compacted outputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrace import schemas
from pricetrace.scratch import Staged
from pricetrace.sources.articles import month_from_name, read_articles, with_month_from_file

# A CSV file with embedded line breaks is read back by one task, so files are kept small.
MAX_ROWS_PER_FILE = 500_000
# Fixed value: daily files carry an eight-digit day; its first six digits are the month.
DAILY_MONTH = r"_(\d{6})\d{2}"


def csv_writer(df: DataFrame, header: bool = True):
    return (
        df.write.mode("overwrite")
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
    )


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    csv_writer(df, header).csv(path)


def write_articles(df: DataFrame, path: str) -> None:
    """The eleven article columns in their fixed order."""
    write_csv(df.select(*schemas.ARTICLE_COLUMNS), path)


def write_by_month(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """`month=YYYYMM/` folders in one job.

    The rebalance hint collects each month into few files and lets adaptive execution cut a month
    that is much larger than the others into several tasks.
    """
    balanced = df.hint("rebalance", "month")
    writer = csv_writer(balanced) if fmt == "csv" else balanced.write.mode("overwrite").format(fmt)
    writer.partitionBy("month").format(fmt).save(path)


def compact_by_month(
    spark: SparkSession, source: str, target: str, start: str, end: str, fmt: str = "parquet"
) -> DataFrame:
    """Many small daily article files to one dataset per month, both end months included.

    Months come from the file names, so files outside the range are never opened. The rows are
    shuffled once: small months end up in one file and a large month in as many as its size needs.
    Inside a file, rows keep the order of the source files (names descending) and of their lines.
    """
    if start > end:
        raise ValueError(f"start month {start} lies after end month {end}")
    daily = with_month_from_file(read_articles(spark, source), DAILY_MONTH, fallback=None)
    ordered = _compacted(daily.where(F.col("month").between(start, end)))
    writer = csv_writer(ordered) if fmt == "csv" else ordered.write.mode("overwrite")
    writer.partitionBy("month").format(fmt).save(target)
    return read_months(spark, target, fmt)


def _compacted(daily: DataFrame) -> DataFrame:
    """Rows of daily files (with `month`) in the order of their files and lines, dealt out by month."""
    wanted = daily.select(
        *schemas.ARTICLE_COLUMNS,
        "month",
        F.col("_metadata.file_path").alias("_file"),
        F.monotonically_increasing_id().alias("_position"),
    )
    order = [F.asc("month"), F.desc("_file"), F.asc("_position")]
    return wanted.hint("rebalance", "month").sortWithinPartitions(*order).drop("_file", "_position")


def read_months(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Month-partitioned article dataset; `month` stays text."""
    schema = T.StructType([*schemas.ARTICLES.fields, T.StructField("month", T.StringType())])
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.load(path)


def _listed(spark: SparkSession, source: str, start: str, end: str) -> DataFrame:
    """(file, length, modified, month) of the daily files in the range; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.element_at(F.split("path", "/"), -2)
    month = month_from_name(F.when(name.startswith("part-"), parent).otherwise(name), DAILY_MONTH, None)
    rows = files.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"), month.alias("month"))
    return rows.where(F.col("month").between(start, end))


def compact_new_files(spark: SparkSession, source: str, target: str, start: str, end: str) -> list[str]:
    """Bring the dataset that `compact_by_month` writes up to date; returns the months that were written again.

    A table of the files compacted so far lies beside the dataset. Months with a file that is new, changed or gone are
    compacted from all their files, which are the only ones opened, and replace their folders; the other months stay as they are.
    The table is written last, so a run that fails is made good by the next one. A month of which every file is gone keeps
    its rows.
    """
    if start > end:
        raise ValueError(f"start month {start} lies after end month {end}")
    known, ledger = ["file", "length", "modified", "month"], f"{target.rstrip('/')}-files"
    now = Staged(_listed(spark, source, start, end), "files")
    before = _ledger(spark, ledger, now.schema)
    changed = now.df.join(before, known, "left_anti").unionByName(before.where(F.col("month").between(start, end)).join(now.df, known, "left_anti"))
    months = sorted(row["month"] for row in changed.select("month").distinct().collect())  # at most as many as there are months
    if months:
        daily = with_month_from_file(read_articles(spark, source), DAILY_MONTH, fallback=None)
        _compacted(daily.where(F.col("month").isin(months))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(target)
        outside = Staged(before.where(~F.col("month").between(start, end)), "files-outside")
        now.df.unionByName(outside.df).write.mode("overwrite").parquet(ledger)
        outside.discard()
    now.discard()
    return months


def _ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table of compacted files as it was, stored apart so that it can be replaced; empty before the first run."""
    try:
        return Staged(spark.read.schema(schema).parquet(path), "ledger").df
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def update_months(result: DataFrame, path: str, months: list[str]) -> None:
    """Replace the given months of a stored result (month, ...) by those of `result`; the others are neither read nor written."""
    rows = result.where(F.col("month").isin(months))
    rows.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
