"""Tokens, keyword counts and word lists."""

from pyspark.sql import functions as F

from pricetrace.catalog.bindings import TAGS, TOKEN, WORDS, articles, lexicon
from pricetrace.catalog.registry import cte, query
from pricetrace.functions import text
from pricetrace.keyword_sets import all_words, keywords_from_labels
from pricetrace.operators import clean, keywords, tfidf, threshold
from pricetrace.scratch import new_path
from pricetrace.sources.reports import parse_labelled_words, read_lines

cte(
    # tagged title words: the tag follows from the word's length
    tagged="""
      SELECT month, article_id, pos, w FROM (
        SELECT month, article_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS w
        FROM (SELECT month, article_id, regexp_extract_all(title, '[\\p{L}\\p{N}_]+') AS ws FROM art))
      WHERE length(w) % 5 < 4""",
)


@query("tokenize_words", f"""
  SELECT article_id, len(regexp_extract_all(content_text, '{TOKEN}')) AS n_tokens,
    array_to_string(regexp_extract_all(content_text, '{TOKEN}'), ' ') AS words FROM art""")
def tokenize_words(spark, sf):
    rows = articles(spark, sf).select("article_id", text.tokens(F.col("content_text")).alias("t"))
    return rows.select("article_id", F.size("t").cast("long").alias("n_tokens"), text.joined(F.col("t")).alias("words"))


@query("blank_guard", f"""
  SELECT article_id, CASE WHEN section_id = 'de' THEN 0 ELSE len(regexp_extract_all(content_text, '{TOKEN}')) END AS n_tokens
  FROM art""")
def blank_guard(spark, sf):
    body = F.when(F.col("section_id") != "de", F.col("content_text")).otherwise("  ")
    return articles(spark, sf).select("article_id", F.size(text.tokens(body)).cast("long").alias("n_tokens"))


@query("stopword_filter", f"""
  SELECT article_id, array_to_string(list_filter(regexp_extract_all(content_text, '{TOKEN}'),
    lambda x: x NOT IN ('the', 'de', 'und', 'la')), ' ') AS words FROM art""")
def stopword_filter(spark, sf):
    kept = text.drop_words(text.tokens(F.col("content_text")), ["the", "de", "und", "la"])
    return articles(spark, sf).select("article_id", text.joined(kept).alias("words"))


@query("script_filter", "SELECT article_id, month FROM art WHERE regexp_matches(content_text, '[à-ÿ]')")
def script_filter(spark, sf):
    return clean.script_filter(articles(spark, sf), characters="[à-ÿ]").select("article_id", "month")


@query("drop_required_nulls", """
  SELECT article_id, month FROM art WHERE length(title) > 40 AND section_id <> 'de'""")
def drop_required_nulls(spark, sf):
    holes = articles(spark, sf).select(
        "article_id",
        "month",
        F.when(F.length("title") > 40, F.col("title")).alias("title"),
        F.when(F.col("section_id") != "de", F.col("content_text")).alias("content_text"),
    )
    return clean.drop_required_nulls(holes, ["title", "content_text"]).select("article_id", "month")


@query("keyword_counts_body", """
  SELECT g.month, CAST(g.policy AS INTEGER) AS policy, CAST(coalesce(sum(h.cnt), 0) AS BIGINT) AS cnt
  FROM grid g LEFT JOIN (SELECT a.month, h.policy, h.cnt FROM ahit h JOIN art a ON a.article_id = h.article_id) h
    ON h.month = g.month AND h.policy = g.policy GROUP BY ALL""")
def keyword_counts_body(spark, sf):
    return keywords.keyword_counts(articles(spark, sf), WORDS)


@query("keyword_counts_weighted", "SELECT month, policy, cnt FROM wcnt")
def keyword_counts_weighted(spark, sf):
    return keywords.weighted_counts(keywords.article_counts(articles(spark, sf), WORDS))


@query("keyword_counts_phrases", """
  SELECT g.month, CAST(g.policy AS INTEGER) AS policy, CAST(coalesce(sum(h.cnt), 0) AS BIGINT) AS cnt
  FROM grid g LEFT JOIN (
    SELECT a.month, h.policy, h.cnt FROM ahit h JOIN art a ON a.article_id = h.article_id
    UNION ALL SELECT month, 1, count(*) FROM (SELECT month, ws, unnest(range(1, len(ws))) AS i FROM bws) WHERE ws[i] = 'of' AND ws[i + 1] = 'the' GROUP BY month) h
    ON h.month = g.month AND h.policy = g.policy GROUP BY ALL""")
def keyword_counts_phrases(spark, sf):
    return keywords.body_counts(keywords.article_counts(articles(spark, sf), WORDS, phrases=True))


@query("keyword_counts_labelled", """
  SELECT g.month, CAST(g.policy AS INTEGER) AS policy, CAST(coalesce(h.cnt, 0) AS BIGINT) AS cnt FROM grid g LEFT JOIN (
    SELECT b.month, k.policy, count(*) AS cnt FROM btok b
    JOIN (SELECT policy, word FROM kw UNION SELECT 2, 'with') k ON b.w = k.word GROUP BY ALL) h
  ON h.month = g.month AND h.policy = g.policy""")
def keyword_counts_labelled(spark, sf):
    """A labelled word list as dictionary; one word carries two labels."""
    path = new_path(spark, "labelled-keywords")
    labelled = [(word, policy) for policy, words in WORDS.items() for word in words] + [("with", 2), ("the", 0)]
    lines = [(f"{n}. {word} {policy}",) for n, (word, policy) in enumerate(labelled, 1)]
    spark.createDataFrame(lines, "value string").write.text(path)
    words = keywords_from_labels(parse_labelled_words(read_lines(spark, path)))
    return keywords.keyword_counts(articles(spark, sf), words)


@query("weighted_counts_independent", """
  SELECT g.month, CAST(g.policy AS INTEGER) AS policy, CAST(coalesce(h.cnt, 0) AS BIGINT) AS cnt FROM grid g LEFT JOIN (
    SELECT t.month, k.policy, sum(t.weight) AS cnt FROM (
      SELECT month, w, 1 AS weight FROM btok UNION ALL
      SELECT month, w, 2 AS weight FROM ttok WHERE CAST(article_id AS BIGINT) % 3 > 0) t
    JOIN kw k ON t.w = k.word GROUP BY ALL) h ON h.month = g.month AND h.policy = g.policy""")
def weighted_counts_independent(spark, sf):
    """Titles and bodies counted on their own: an article without a title still counts with its body."""
    titled = F.when(F.col("article_id").cast("long") % 3 > 0, F.col("title"))
    counts = keywords.article_counts(articles(spark, sf).withColumn("title", titled), WORDS)
    return keywords.weighted_counts(counts, null_rule="independent")


@query("article_policy_counts", "SELECT month, article_id, policy, cnt FROM acnt")
def article_policy_counts(spark, sf):
    return keywords.article_policy_counts(keywords.article_counts(articles(spark, sf), WORDS))


@query("label_articles", "SELECT month, article_id, policy, cnt FROM lab")
def label_articles(spark, sf):
    return keywords.label_articles(keywords.article_counts(articles(spark, sf), WORDS))


@query("restrict_vocab", f"""
  SELECT article_id, CASE WHEN len(k) = 0 THEN '{tfidf.PLACEHOLDER}' ELSE array_to_string(k, ' ') END AS words FROM (
    SELECT article_id, list_filter(regexp_extract_all(content_text, '{TOKEN}'),
      lambda x: x IN ({", ".join(f"'{w}'" for w in all_words(WORDS))})) AS k FROM art)""")
def restrict_vocab(spark, sf):
    kept = text.restrict_tokens(text.tokens(F.col("content_text")), all_words(WORDS), tfidf.PLACEHOLDER)
    return articles(spark, sf).select("article_id", text.joined(kept).alias("words"))


@query("tag_filter_tokens", """
  SELECT a.article_id, a.month, coalesce(string_agg(t.w, ' ' ORDER BY t.pos), '') AS words
  FROM art a LEFT JOIN tagged t ON t.article_id = a.article_id GROUP BY ALL""")
def tag_filter_tokens(spark, sf):
    tagged = keywords.tag_filter(articles(spark, sf), lexicon(spark, sf), TAGS)
    return tagged.select("article_id", "month", text.joined(F.col("tokens")).alias("words"))


cte(
    # lowercased title words of two letters or more, their n-grams, and the monthly vocabulary
    bws=f"SELECT month, regexp_extract_all(content_text, '{TOKEN}') AS ws FROM art",
    lw=f"""
      SELECT month, article_id, list_filter(regexp_extract_all(lower(title), '{TOKEN}'), lambda x: length(x) >= 2) AS ws FROM art""",
    gram="""
      SELECT month, article_id, array_to_string(ws[i:i + n - 1], ' ') AS term FROM (
        SELECT month, article_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM lw, (VALUES (2), (3)) AS t(n))""",
    gtf="SELECT month, article_id, term, count(*) AS tf FROM gram GROUP BY ALL",
    gvoc="""
      SELECT * FROM (SELECT month, term, sum(tf) AS freq, count(*) AS df,
        row_number() OVER (PARTITION BY month ORDER BY sum(tf) DESC, term) AS rank FROM gtf GROUP BY month, term)
      WHERE rank <= 1000""",
)


@query("word_ngrams", f"""
  SELECT article_id, array_to_string(ws[i:i + n - 1], ' ') AS term FROM (
    SELECT article_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM (SELECT article_id, regexp_extract_all(title, '{TOKEN}') AS ws FROM art), (VALUES (2), (3)) AS t(n))""")
def word_ngrams(spark, sf):
    grams = text.word_ngrams(text.tokens(F.col("title")), 2, 3)
    return articles(spark, sf).select("article_id", F.explode(grams).alias("term"))


@query("vocab_cap", """
  SELECT month, term, CAST(freq AS BIGINT) AS freq, df, CAST(rank AS INTEGER) AS rank FROM gvoc""")
def vocab_cap(spark, sf):
    grams = tfidf.gram_counts(tfidf.title_tokens(articles(spark, sf)), 2, 3, min_length=2)
    return tfidf.vocab_cap(grams).select("month", "term", "freq", "df", "rank")


@query("vocab_cap_threshold", """
  SELECT month, term, CAST(freq AS BIGINT) AS freq, df, CAST(rank AS INTEGER) AS rank FROM gvoc""")
def vocab_cap_threshold(spark, sf):
    grams = tfidf.gram_counts(tfidf.title_tokens(articles(spark, sf)), 2, 3, min_length=2)
    return threshold.vocab_cap_by_threshold(grams, tfidf.MAX_TERMS)
