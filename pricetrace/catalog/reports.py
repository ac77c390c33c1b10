"""Text reports written and parsed back."""

from pyspark.sql import functions as F

from pricetrace.catalog.bindings import POLICIES, WORDS, articles
from pricetrace.catalog.months import month_counts
from pricetrace.catalog.registry import query
from pricetrace.catalog.scores import article_scores, frequencies, title_grams
from pricetrace.operators import ranking, tfidf
from pricetrace.scratch import new_path, stage
from pricetrace.sinks import reports as sink
from pricetrace.sources import reports as source
from pricetrace.sources.tables import read_table

_RULE = sink.RULE


@query("report_lines", f"""
  SELECT month, CAST(line_no AS INTEGER) AS line_no, line FROM (
    SELECT DISTINCT month, 1 AS line_no, '파일: merged_' || month || '.csv' AS line FROM wcnt
    UNION ALL SELECT month, 1 + policy, '  정책 ' || policy || ': ' || cnt || '개 단어 발견' FROM wcnt
    UNION ALL SELECT month, 6, '{_RULE}' FROM amax
    UNION ALL SELECT month, 7, '최다 단어 정책: 정책 ' || policy FROM amax
    UNION ALL SELECT month, 8, '' FROM amax)""")
def report_lines(spark, sf):
    return sink.block_lines(sink.counts_report(month_counts(spark, sf)), "month")


@query("parse_counts_report", "SELECT 'merged_' || month || '.csv' AS file, month, policy, cnt FROM wcnt")
def parse_counts_report(spark, sf):
    path = new_path(spark, "counts-report")
    sink.write_report(sink.counts_report(month_counts(spark, sf)), path)
    return source.parse_counts_report(spark, path)


@query("parse_scores_report", "SELECT 'merged_' || month || '.csv' AS file, month, policy, score FROM stot")
def parse_scores_report(spark, sf):
    path = new_path(spark, "scores-report")
    totals = tfidf.tfidf_policy_totals(articles(spark, sf), WORDS).withColumn("score", F.round("score", 4))
    sink.write_report(sink.scores_report(totals), path)
    return source.parse_scores_report(spark, path)


@query("parse_article_scores", "SELECT month, article_id, title, policy, score FROM psc4")
def parse_article_scores(spark, sf):
    path = new_path(spark, "article-scores-report")
    scored = stage(article_scores(spark, sf), "article-scores")
    rounded = scored.withColumn("scores", F.transform("scores", lambda s: s.withField("score", F.round(s.score, 4))))
    sink.write_report(sink.article_scores_report(rounded, tfidf.article_tfidf_totals(scored)), path, "file")
    return source.parse_article_scores(spark, path)


@query("parse_article_scores_rejects", """
  SELECT DISTINCT month, CASE WHEN CAST(article_id AS BIGINT) % 7 = 0 THEN 'id' ELSE 'title' END AS reason,
    CASE WHEN CAST(article_id AS BIGINT) % 7 = 0 THEN 'n' || article_id || ', 제목: ' || title ELSE article_id || ', 제목: ' END AS line
  FROM psc4 WHERE CAST(article_id AS BIGINT) % 7 = 0 OR CAST(article_id AS BIGINT) % 11 = 0""")
def parse_article_scores_rejects(spark, sf):
    path = new_path(spark, "article-scores-report")
    scored = stage(article_scores(spark, sf), "article-scores")
    number = F.col("article_id").cast("bigint")
    spoilt = scored.withColumns({
        "article_id": F.when(number % 7 == 0, F.concat(F.lit("n"), "article_id")).otherwise(F.col("article_id")),
        "title": F.when((number % 7 != 0) & (number % 11 == 0), "").otherwise(F.col("title")),
    })
    sink.write_report(sink.article_scores_report(spoilt, tfidf.article_tfidf_totals(scored)), path, "file")
    return source.rejected_article_scores(spark, path)


@query("parse_ranked_terms", "SELECT month, term FROM ttt")
def parse_ranked_terms(spark, sf):
    path = new_path(spark, "ranked-terms")
    lines = sink.term_lines(tfidf.top_terms_month(title_grams(spark, sf)))
    sink.write_report(lines.withColumn("file", F.concat(F.lit("word_"), F.col("month"))), path, "file")
    read = source.read_lines(spark, path).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"word_(\d{6})", 1).alias("month"))
    return source.parse_ranked_terms(read).select("month", "term")


@query("distinct_sorted_words", """
  SELECT row_number() OVER (ORDER BY word) AS rank, word FROM twords WHERE NOT regexp_full_match(word, '[0-9]+')""")
def distinct_sorted_words(spark, sf):
    path = new_path(spark, "term-counts")
    sink.write_report(sink.frequency_lines(frequencies(spark, sf)), path)
    words = tfidf.distinct_words(source.read_lines(spark, path))
    return ranking.enumerate_rows(words, [F.asc("word")]).select("rank", "word")


@query("labelled_words", """
  SELECT CAST(p_partkey AS INTEGER) AS ordinal, p_name AS word, CAST(p_partkey % 4 AS INTEGER) AS label FROM part WHERE p_partkey % 4 <> 0""")
def labelled_words(spark, sf):
    path = new_path(spark, "labelled-words")
    part = read_table(spark, f"{sf}/part.parquet", "p_partkey bigint, p_name string")
    label = (F.col("p_partkey") % 4).cast("string")
    part.select(F.concat(F.col("p_partkey").cast("string"), F.lit(". "), F.col("p_name"), F.lit(" "), label)).write.text(path)
    return source.parse_labelled_words(source.read_lines(spark, path))


@query("unpivot_scores", """
  SELECT month, article_id, title, policy, CASE WHEN policy = 0 THEN round(score, 6) ELSE round(score, 4) END AS score FROM (
    SELECT month, article_id, title, policy, score FROM psc WHERE score > 1.00001
    UNION ALL SELECT month, article_id, title, 0, sum(score) FROM psc GROUP BY ALL)""")
def unpivot_scores(spark, sf):
    def score(policy):
        return F.filter("scores", lambda s: s.policy == policy)[0].score

    names = {p: f"정책 {p} TF-IDF 총합" for p in POLICIES}
    total = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + s.score)
    wide = article_scores(spark, sf).select(
        "month",
        "article_id",
        "title",
        *[F.when(score(p) > 1.00001, F.round(score(p), 4)).alias(names[p]) for p in POLICIES],
        F.round(total, 6).alias("합계"),
    )
    return source.unpivot_scores(wide, ["month", "article_id", "title"], [*names.values(), "합계"])
