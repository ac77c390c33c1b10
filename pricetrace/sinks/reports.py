"""Text reports and result documents.

Each block (a month, or an article) is one row whose text holds its lines, so a report is an ordinary
distributed text write and its lines can never be torn apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrace import schemas
from pricetrace.functions.columns import policy_label

# Fixed value: rule drawn between the counts of a file and its verdict.
RULE = "-" * 22


def _file_blocks(counts: DataFrame, value: str, line_format: str, verdict: str) -> DataFrame:
    """One block per month: file line, one line per policy, and the month's largest policy."""
    line = F.format_string(line_format, F.col("policy"), F.col(value))
    top = F.max(F.struct(F.col(value), (-F.col("policy")).alias("neg")))
    months = counts.groupBy("month").agg(
        F.sort_array(F.collect_list(F.struct("policy", line.alias("line")))).alias("lines"),
        (-top["neg"]).alias("top_policy"),
    )
    return months.select(
        "month",
        F.concat_ws(
            "\n",
            F.concat(F.lit("파일: merged_"), F.col("month"), F.lit(".csv")),
            F.array_join(F.col("lines.line"), "\n"),
            F.lit(RULE),
            F.concat(F.lit(verdict), policy_label(F.col("top_policy")), F.lit("\n")),
        ).alias("block"),
    )


def counts_report(counts: DataFrame) -> DataFrame:
    """(month, block) for (month, policy, cnt)."""
    return _file_blocks(counts, "cnt", "  정책 %d: %d개 단어 발견", "최다 단어 정책: ")


def scores_report(scores: DataFrame) -> DataFrame:
    """(month, block) for (month, policy, score) at four digits."""
    return _file_blocks(scores, "score", "  정책 %d: %.4f 점수", "최다 점수 정책: ")


def article_scores_report(scores: DataFrame, totals: DataFrame) -> DataFrame:
    """(file, block): one block per article of `scores` (month, article_id, title, scores array), totals last in a file."""
    file_name = F.concat(F.lit("score_"), F.col("month"))
    lines = F.transform("scores", lambda s: F.format_string("  정책 %d TF-IDF 총합: %.4f", s.policy, s.score))
    head = F.format_string("ID: %s, 제목: %s", F.col("article_id"), F.col("title"))
    articles = scores.select(
        file_name.alias("file"),
        F.lit(0).alias("part"),
        F.concat(head, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("block"),
    )
    total_line = F.format_string("  정책 %d 총합 TF-IDF: %.4f", F.col("policy"), F.col("score"))
    trailer = totals.groupBy("month").agg(F.sort_array(F.collect_list(total_line)).alias("lines")).select(
        file_name.alias("file"),
        F.lit(1).alias("part"),
        F.concat(F.lit("전체 파일 기준 정책별 TF-IDF 총합:\n"), F.array_join("lines", "\n")).alias("block"),
    )
    return articles.unionByName(trailer)


def term_lines(top_terms: DataFrame) -> DataFrame:
    """(month, rank, block) of `rank. term: score` lines."""
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("term"), F.lit(": "), F.format_string("%.4f", F.col("score"))
    )
    return top_terms.select("month", "rank", line.alias("block"))


def frequency_lines(frequencies: DataFrame) -> DataFrame:
    """(rank, block) of `rank. term count` lines."""
    line = F.concat_ws(" ", F.concat(F.col("rank").cast("string"), F.lit(".")), F.col("term"), F.col("cnt").cast("string"))
    return frequencies.select("rank", line.alias("block"))


def block_lines(blocks: DataFrame, *keys: str) -> DataFrame:
    """Blocks to numbered lines, for inspection."""
    return blocks.select(*keys, F.posexplode(F.split("block", "\n")).alias("pos", "line")).select(
        *keys, (F.col("pos") + 1).alias("line_no"), "line"
    )


def write_report(blocks: DataFrame, path: str, partition: str | None = None) -> None:
    """Blocks as text files; with `partition`, one folder per value of that column."""
    if partition is None:
        blocks.select("block").write.mode("overwrite").text(path)
        return
    order = [c for c in ("part", "rank") if c in blocks.columns]
    balanced = blocks.hint("rebalance", partition).sortWithinPartitions(partition, *order)
    balanced.select(partition, "block").write.mode("overwrite").partitionBy(partition).text(path)


def month_documents(traced: DataFrame, month: str = "month") -> DataFrame:
    """(month, article_id, document): one JSON object per article, with the eleven columns and the address.

    The document of a month is all its rows, a line each, whatever their number; months without articles have none.
    """
    fields = [*schemas.ARTICLE_COLUMNS, "article_url"]
    document = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return traced.select(F.col(month).alias("month"), "article_id", document.alias("document"))


def write_month_documents(documents: DataFrame, path: str) -> None:
    """JSON lines below one folder `month=YYYYMM/` per month; a large month becomes several files."""
    lines = documents.hint("rebalance", "month").sortWithinPartitions("month", "article_id").select("month", "document")
    lines.write.mode("overwrite").partitionBy("month").text(path)
