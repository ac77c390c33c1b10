"""Article CSV sources: directory scans, month keys from names, bad rows, dirty or missing headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrace import schemas
from pricetrace.sources import archives, quoted

# How the month (or day) key is written in file names.
MONTH_PATTERNS = {
    "six_digits": r"_(\d{6})\.csv",
    "digits": r"_(\d+)\.csv",
    "first_six": r"(\d{6})",
    "score_report": r"score_(\d{6})",
    "day": r"(\d{8})",
}

_OVERFLOW = "_overflow"


def csv_reader(spark: SparkSession, schema: T.StructType, header: bool = True, multi_line: bool = True):
    """Reader for quoted CSV with embedded line breaks and doubled quotes.

    A file with embedded line breaks is streamed by one task, so `pricetrace.sinks` bounds the rows
    per file; directories are read in one scan however many files they hold. `multi_line=False` splits
    large files that are known to hold one record per line; `quoted.quoted_records` splits any.
    """
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("recursiveFileLookup", True)
    )


def read_articles(
    spark: SparkSession, path: str | list[str], on_bad: str = "keep", header: bool = True, multi_line: bool = True,
    skip_unreadable: bool = False, splits: bool = False,
) -> DataFrame:
    """All article files below `path` in one scan.

    `on_bad` says what happens to lines with more fields than the header: `keep` cuts them to the
    eleven columns, `drop` removes them, `quarantine` adds a boolean column `is_bad`. Short lines are
    always filled up with nulls. `splits` reads large files in several tasks, whatever their quotes hold.
    A file that cannot be read fails the job, unless `skip_unreadable` is set: then no row of a file that is not whole
    is returned, and `archives.damaged_files` names these files.
    """
    if on_bad not in ("keep", "drop", "quarantine"):
        raise ValueError(f"unknown on_bad mode: {on_bad}")
    schema = schemas.ARTICLES if on_bad == "keep" else T.StructType([*schemas.ARTICLES.fields, T.StructField(_OVERFLOW, T.StringType())])
    if splits:
        if skip_unreadable:
            raise ValueError("splits=True reads all files; leave damaged ones out of the path")
        rows = quoted.quoted_records(spark, path, header).select(quoted.parsed(F.col("record"), schema).alias("_row")).select("_row.*")
    else:
        # All columns are parsed, so that a line is judged the same whichever of them a query selects.
        reader = csv_reader(spark, schema, header, multi_line).option("ignoreCorruptFiles", skip_unreadable)
        rows = reader.option("columnPruning", on_bad == "keep").csv(path)
    if skip_unreadable:
        damaged = archives.damaged_files(spark, path).select("file")
        rows = rows.join(damaged, F.col("_metadata.file_path") == F.col("file"), "left_anti")
    if on_bad == "keep":
        return rows
    if on_bad == "drop":
        return rows.where(F.col(_OVERFLOW).isNull()).drop(_OVERFLOW)
    return rows.withColumn("is_bad", F.col(_OVERFLOW).isNotNull()).drop(_OVERFLOW)


def read_headerless(spark: SparkSession, path: str, schema: T.StructType = schemas.ARTICLES, splits: bool = False) -> DataFrame:
    if splits:
        return quoted.quoted_records(spark, path, header=False).select(quoted.parsed(F.col("record"), schema).alias("_row")).select("_row.*")
    return csv_reader(spark, schema, header=False).csv(path)


def source_name() -> Column:
    """Name of the file, or of the dataset folder when Spark wrote it as part files."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    name = F.element_at(parts, -1)
    return F.when(name.startswith("part-"), F.element_at(parts, -2)).otherwise(name)


def month_from_name(name: Column, pattern: str = MONTH_PATTERNS["six_digits"], fallback: str | None = "Unknown") -> Column:
    key = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return key if fallback is None else F.coalesce(key, F.lit(fallback))


def with_month_from_file(
    df: DataFrame, pattern: str = MONTH_PATTERNS["six_digits"], fallback: str | None = "Unknown"
) -> DataFrame:
    """Add `month`, cut from the file name. `fallback=None` skips files whose name holds none.

    The expression uses file metadata only, so a filter on `month` removes files before they are read.
    """
    keyed = df.withColumn("month", month_from_name(source_name(), pattern, fallback))
    return keyed if fallback is not None else keyed.where(F.col("month").isNotNull())


def clean_columns(df: DataFrame) -> DataFrame:
    """Column names without line breaks and outer blanks."""
    return df.toDF(*[name.replace("\r", "").replace("\n", "").strip() for name in df.columns])
