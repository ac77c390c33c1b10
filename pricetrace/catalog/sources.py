"""Sources and sinks: the given tables written out, read back and compared with themselves."""

from pyspark.sql import functions as F

from pricetrace import schemas
from pricetrace.catalog.articles import rendered_ranks
from pricetrace.catalog.bindings import ARTICLE_LIST, WORDS, articles, trades
from pricetrace.catalog.months import month_counts
from pricetrace.catalog.registry import query
from pricetrace.functions.columns import policy_label
from pricetrace.operators import monthly
from pricetrace.scratch import Staged, new_path, setting
from pricetrace.sinks import datasets
from pricetrace.sources import archives
from pricetrace.sources import articles as source
from pricetrace.sources import trades as trade_source

_ALL_ARTICLES = f"SELECT {ARTICLE_LIST} FROM art"
_BY_MONTH = f"SELECT {ARTICLE_LIST}, month FROM art"


@query("scan_articles_csv", _ALL_ARTICLES)
def scan_articles_csv(spark, sf):
    path = new_path(spark, "articles-csv")
    datasets.write_articles(articles(spark, sf), path)
    return source.read_articles(spark, path)


@query("scan_headerless_csv", _ALL_ARTICLES)
def scan_headerless_csv(spark, sf):
    path = new_path(spark, "headerless-csv")
    datasets.write_csv(articles(spark, sf).select(*schemas.ARTICLE_COLUMNS), path, header=False)
    return source.read_headerless(spark, path)


@query("scan_articles_csv_split", _ALL_ARTICLES)
def scan_articles_csv_split(spark, sf):
    path = new_path(spark, "articles-split-csv")
    datasets.write_articles(articles(spark, sf), path)
    with setting(spark, "spark.sql.files.maxPartitionBytes", "262144"):
        return Staged(source.read_articles(spark, path, splits=True), "split-articles").df


def _cut_in_half(spark, path, pattern):
    """Keep only the first half of the bytes of the files that fit a glob pattern."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    for status in fs.Path(path).getFileSystem(conf).globStatus(fs.Path(f"{path}/{pattern}")):
        system = status.getPath().getFileSystem(conf)
        half = fs.Path(status.getPath().toString().replace(".csv.gz", "-half.csv.gz"))
        whole, cut = system.open(status.getPath()), system.create(half)
        jvm.org.apache.commons.io.IOUtils.copyLarge(whole, cut, 0, status.getLen() // 2)
        whole.close()
        cut.close()
        system.delete(status.getPath(), False)


@query("scan_damaged_files", """
  SELECT section_id, section_id <> 'fr' AS whole, CASE WHEN section_id = 'fr' THEN 0 ELSE count(*) END AS n_articles,
    CASE WHEN section_id = 'fr' THEN NULL ELSE sum(1 + length(title) - length(replace(title, chr(10), ''))
      + 2 * (length(content_text) - length(replace(content_text, chr(10), '')))) END AS line_ends
  FROM art GROUP BY section_id""")
def scan_damaged_files(spark, sf):
    path = new_path(spark, "damaged-csv")
    rows = articles(spark, sf).select(*schemas.ARTICLE_COLUMNS)
    datasets.csv_writer(rows.withColumn("section", F.col("section_id")).hint("rebalance", "section"), header=False).option("compression", "gzip").partitionBy("section").csv(path)
    _cut_in_half(spark, path, "section=fr/*.csv.gz")
    section = F.regexp_extract("file", "section=([a-z]+)/", 1).alias("section_id")
    whole = F.bool_and(F.col("state") == archives.WHOLE)
    states = archives.archive_states(spark, path).groupBy(section).agg(whole.alias("whole"), F.sum("line_ends").alias("line_ends"))
    kept = source.read_articles(spark, path, header=False, skip_unreadable=True).groupBy("section_id").agg(F.count("*").alias("n"))
    return states.join(kept, "section_id", "left").select(
        "section_id", "whole", F.coalesce("n", F.lit(0)).alias("n_articles"), F.when(F.col("whole"), F.col("line_ends")).alias("line_ends")
    )


def _named_files(art, name, path):
    """Article files grouped into datasets with the given names."""
    rows = art.select(*schemas.ARTICLE_COLUMNS, name.alias("file"))
    datasets.csv_writer(rows.hint("rebalance", "file")).partitionBy("file").csv(path)


@query("month_from_file_name", "SELECT article_id, month FROM art")
def month_from_file_name(spark, sf):
    path = new_path(spark, "merged-csv")
    art = articles(spark, sf)
    _named_files(art, F.concat(F.lit("merged_"), F.col("month"), F.lit(".csv")), path)
    return source.with_month_from_file(source.read_articles(spark, path)).select("article_id", "month")


@query("clean_header", "SELECT article_id, title, content_text FROM art")
def clean_header(spark, sf):
    path = new_path(spark, "dirty-header")
    rows = articles(spark, sf).select(
        F.col("article_id").alias(" article_id"), F.col("title").alias("title  "), F.col("content_text").alias("content_text \n")
    )
    datasets.write_csv(rows, path)
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return source.clean_columns(read).select("article_id", "title", "content_text")


def _bad_lines(art):
    """Articles as CSV lines; German ones appear a second time with two fields too many."""
    line = F.to_csv(F.struct(*schemas.ARTICLE_COLUMNS), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    broken = F.when(F.col("section_id") == "de", F.array(line, F.concat(line, F.lit(",surplus,fields"))))
    return art.select(F.explode(F.coalesce(broken, F.array(line))))


@query("scan_bad_rows", _ALL_ARTICLES)
def scan_bad_rows(spark, sf):
    path = new_path(spark, "bad-rows")
    _bad_lines(articles(spark, sf)).write.text(path)
    return source.read_articles(spark, path, on_bad="drop", header=False)


@query("scan_bad_rows_quarantine", f"""
  SELECT {ARTICLE_LIST}, FALSE AS is_bad FROM art UNION ALL SELECT {ARTICLE_LIST}, TRUE AS is_bad FROM art WHERE section_id = 'de'""")
def scan_bad_rows_quarantine(spark, sf):
    path = new_path(spark, "quarantine-rows")
    _bad_lines(articles(spark, sf)).write.text(path)
    return source.read_articles(spark, path, on_bad="quarantine", header=False)


@query("scan_trades_csv", "SELECT amount, area, month, series FROM trd")
def scan_trades_csv(spark, sf):
    from pricetrace.functions.columns import parse_number

    path = new_path(spark, "trades-csv")
    rows = trades(spark, sf).select(
        F.format_number("amount", 2).alias(schemas.TRADE_AMOUNT),
        F.col("area").alias(schemas.TRADE_AREA),
        F.col("month").alias(schemas.TRADE_MONTH),
        "series",
    )
    # Yearly files, which do not agree on the order of their columns.
    orders = {"A": rows.columns, "N": rows.columns[::-1], "R": [rows.columns[i] for i in (2, 0, 3, 1)]}
    with setting(spark, "spark.sql.legacy.javaCharsets", "true"):
        for series, names in orders.items():
            part = rows.where(F.col("series") == series).select(*names)
            datasets.csv_writer(part).option("encoding", "cp949").csv(f"{path}/{series}")
    read = trade_source.read_trades(spark, [f"{path}/{series}" for series in orders], keep=("series",))
    return read.select(parse_number(F.col("amount_raw")).alias("amount"), "area", "month", "series")


@query("scan_policy_map", "SELECT month, policy FROM ptype")
def scan_policy_map(spark, sf):
    path = new_path(spark, "policy-map")
    types = monthly.assign_policy_type(month_counts(spark, sf))
    wide = monthly.month_policy_pivot(month_counts(spark, sf), sorted(WORDS), prefix="정책 ").join(types, "month")
    labelled = wide.withColumn("policy_type", policy_label(F.col("policy_type")))
    datasets.write_csv(labelled.withColumnsRenamed({"month": schemas.MAP_MONTH, "policy_type": schemas.MAP_POLICY}), path)
    return trade_source.read_policy_map(spark, path)


@query("sink_csv_roundtrip", """
  SELECT month AS "Month", coalesce('정책 ' || policy, 'None') AS "Policy", article_id AS "ID", cnt AS "Count",
    coalesce(CAST(rank AS VARCHAR), 'None') AS "Rank" FROM rnk""")
def sink_csv_roundtrip(spark, sf):
    path = new_path(spark, "ranks-csv")
    rows = rendered_ranks(spark, sf)
    datasets.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("sink_partitioned_month", _BY_MONTH)
def sink_partitioned_month(spark, sf):
    path = new_path(spark, "by-month")
    datasets.write_by_month(articles(spark, sf).select(*schemas.ARTICLE_COLUMNS, "month"), path)
    return datasets.read_months(spark, path, "csv")


@query("compact_months", _BY_MONTH + " WHERE month BETWEEN '199601' AND '199912'")
def compact_months(spark, sf):
    daily, merged = new_path(spark, "daily-csv"), new_path(spark, "compacted")
    _daily_files(articles(spark, sf), daily)
    return datasets.compact_by_month(spark, daily, merged, "199601", "199912")


def _daily_files(art, path):
    day = F.when(F.col("section_id") == "en", "05").when(F.col("section_id") == "fr", "12").otherwise("26")
    _named_files(art, F.concat(F.lit("article_101_260_"), F.col("month"), day, F.lit("_0.csv")), path)


@query("compact_months_incremental", """
  SELECT a.month, a.article_id, count(*) OVER (PARTITION BY a.month) AS n_articles,
    a.month >= '199801' OR EXISTS (SELECT 1 FROM art l WHERE l.month = a.month AND l.section_id NOT IN ('en', 'fr')) AS updated
  FROM art a WHERE a.month BETWEEN '199601' AND '199912'""")
def compact_months_incremental(spark, sf):
    """English and French articles to 1997 are compacted first, all others later; a monthly result is kept up to date."""
    root = new_path(spark, "incremental")
    art = articles(spark, sf)
    early = F.col("section_id").isin("en", "fr") & (F.col("month") < "199801")
    compacted, counts = f"{root}/compacted", f"{root}/counts"
    for name, rows in (("a", art.where(early)), ("b", art.where(~early))):
        _daily_files(rows, f"{root}/daily/{name}")
        months = datasets.compact_new_files(spark, f"{root}/daily", compacted, "199601", "199912")
        stored = datasets.read_months(spark, compacted)
        datasets.update_months(stored.groupBy("month").agg(F.count("*").alias("n_articles")), counts, months)
    totals = spark.read.schema("n_articles bigint, month string").parquet(counts)
    return stored.join(totals, "month").select("month", "article_id", "n_articles", F.col("month").isin(months).alias("updated"))
