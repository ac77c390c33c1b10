"""Text reports back to tables.

Records are cut by the line-oriented reader itself (`lineSep` set to the marker that opens a record),
so files stay splittable and a header never has to be carried from line to line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrace.functions.columns import policy_number
from pricetrace.sources.articles import MONTH_PATTERNS, month_from_name, source_name

# Line forms of the reports.
FILE_MARK = "파일:"
ID_MARK = "ID: "
COUNT_LINE = r"정책 (\d+)\s*:\s*(\d+)개 단어 발견"
SCORE_LINE = r"정책 (\d+)\s*:\s*(\S+) 점수"
ARTICLE_SCORE_LINE = r"정책 (\d+) TF-IDF 총합: (\S+)"
ARTICLE_LINE = r"^(\d+), 제목: ([^\n]+)"
TERM_LINE = r"^[^.]*\.([^:]*):"
LABEL_LINE = r"^\s*(\d+)\.\s*(.+?)\s+(\d+)\s*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path)


def read_records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """One row per record opened by a line that starts with `mark`; the mark itself is cut off."""
    rows = spark.read.option("recursiveFileLookup", True).option("lineSep", f"\n{mark}").text(path)
    return rows.withColumn("value", F.regexp_replace("value", rf"^\s*{mark}", ""))


def _policy_pairs(block: Column, pattern: str) -> Column:
    """array<struct<policy, value>> of all lines of one block that fit `pattern`."""
    return F.arrays_zip(
        F.regexp_extract_all(block, F.lit(pattern), F.lit(1)).alias("policy"),
        F.regexp_extract_all(block, F.lit(pattern), F.lit(2)).alias("value"),
    )


def _parse_file_blocks(spark: SparkSession, path: str, pattern: str, value: str, value_type: str) -> DataFrame:
    blocks = read_records(spark, path, FILE_MARK)
    pairs = blocks.select(
        F.regexp_extract("value", r"^\s*(\S+)", 1).alias("file"),
        F.explode(_policy_pairs(F.col("value"), pattern)).alias("p"),
    )
    return pairs.select(
        "file",
        month_from_name(F.col("file"), MONTH_PATTERNS["digits"]).alias("month"),
        F.col("p.policy").try_cast("int").alias("policy"),
        F.col("p.value").try_cast(value_type).alias(value),
    ).where(F.col(value).isNotNull())


def parse_counts_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, month, policy, cnt); lines naming the month's top policy are ignored."""
    return _parse_file_blocks(spark, path, COUNT_LINE, "cnt", "bigint")


def parse_scores_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, month, policy, score) at the four digits the report carries."""
    return _parse_file_blocks(spark, path, SCORE_LINE, "score", "double")


def _article_records(spark: SparkSession, path: str) -> DataFrame:
    """(month, value) per article of the score reports; what stands before the first article of a file is a record as well."""
    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", f"\n{ID_MARK}").text(path)
    month = month_from_name(source_name(), MONTH_PATTERNS["score_report"], "unknown")
    return raw.select(month.alias("month"), F.regexp_replace("value", rf"^\s*{ID_MARK}", "").alias("value"))


def parse_article_scores(spark: SparkSession, path: str) -> DataFrame:
    """(month, article_id, title, policy, score) from per-article score reports.

    The whole title is kept. Scores that are not numbers are dropped before anything ranks them,
    and the totals at the end of a file do not match a score line. `rejected_article_scores` has what is left out.
    """
    rows = _article_records(spark, path).where(F.col("value").rlike(ARTICLE_LINE)).select(
        "month",
        F.regexp_extract("value", ARTICLE_LINE, 1).alias("article_id"),
        F.regexp_extract("value", ARTICLE_LINE, 2).alias("title"),
        F.explode(_policy_pairs(F.col("value"), ARTICLE_SCORE_LINE)).alias("p"),
    )
    score = F.col("p.value").try_cast("double")
    return rows.select(
        "month", "article_id", "title", F.col("p.policy").try_cast("int").alias("policy"), score.alias("score")
    ).where(F.col("score").isNotNull() & ~F.isnan("score"))


def rejected_article_scores(spark: SparkSession, path: str) -> DataFrame:
    """(month, reason, line) of everything that `parse_article_scores` leaves out of the score reports.

    `reason` is `id` for a record whose first line has no id of digits, `title` for one with an id and no title, both
    with that line; and `score` for a score line of a good record that holds no number.
    """
    records = _article_records(spark, path).where(F.trim("value") != "")
    good, known = F.col("value").rlike(ARTICLE_LINE), F.col("value").rlike(r"^\d+, 제목:")
    lines = records.where(~good).select("month", F.when(known, "title").otherwise("id").alias("reason"), F.split("value", "\n", 2)[0].alias("line"))
    score = F.regexp_extract("line", ARTICLE_SCORE_LINE, 2).try_cast("double")
    scores = records.where(good).select("month", F.explode(F.split("value", "\n")).alias("line")).where(F.col("line").rlike(ARTICLE_SCORE_LINE))
    return lines.unionByName(scores.where(score.isNull() | F.isnan(score)).select("month", F.lit("score").alias("reason"), "line"))


def parse_ranked_terms(lines: DataFrame) -> DataFrame:
    """Terms of `rank. term: score` lines, one row per line that holds both separators."""
    fits = lines.where(F.col("value").rlike(TERM_LINE))
    kept = [c for c in lines.columns if c != "value"]
    return fits.select(*kept, F.trim(F.regexp_extract("value", TERM_LINE, 1)).alias("term"))


def parse_labelled_words(lines: DataFrame) -> DataFrame:
    """(ordinal, word, label) of `N. phrase label` lines; label 0 means discard.

    A number too large for its column is null in `ordinal`; such a label names no policy and its line is left out.
    """
    parsed = lines.where(F.col("value").rlike(LABEL_LINE)).select(
        F.regexp_extract("value", LABEL_LINE, 1).try_cast("int").alias("ordinal"),
        F.regexp_extract("value", LABEL_LINE, 2).alias("word"),
        F.regexp_extract("value", LABEL_LINE, 3).try_cast("int").alias("label"),
    )
    return parsed.where(F.col("label") != 0)


def unpivot_scores(wide: DataFrame, ids: list[str], policy_columns: list[str]) -> DataFrame:
    """Wide record to one row per policy present; a column that names no policy gives number 0."""
    long = wide.unpivot(ids, policy_columns, "policy_name", "score").where(F.col("score").isNotNull())
    number = F.coalesce(policy_number(F.col("policy_name")), F.lit(0))
    return long.select(*ids, number.alias("policy"), "score")
