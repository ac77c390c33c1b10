"""TF-IDF scores, ranks and term lists."""

from pyspark.sql import functions as F

from pricetrace.catalog.bindings import TOKEN, WORDS, articles
from pricetrace.catalog.registry import cte, query
from pricetrace.functions.columns import round_key
from pricetrace.operators import keywords, monthly, ranking, tfidf
from pricetrace.scratch import stage


def gram_ctes(name: str, words: str, sizes: tuple[int, ...]) -> dict[str, str]:
    """Check SQL from word lists (month, article_id, ws) to the top terms of every month."""
    values = ", ".join(f"({n})" for n in sizes)
    return {
        f"{name}g": f"""
          SELECT month, article_id, array_to_string(ws[i:i + n - 1], ' ') AS term FROM (
            SELECT month, article_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM {words}, (VALUES {values}) AS t(n))""",
        f"{name}f": f"SELECT month, article_id, term, count(*) AS tf FROM {name}g GROUP BY ALL",
        f"{name}v": f"""
          SELECT * FROM (SELECT month, term, count(*) AS df,
            row_number() OVER (PARTITION BY month ORDER BY sum(tf) DESC, term) AS r FROM {name}f GROUP BY month, term)
          WHERE r <= 1000""",
        f"{name}w": f"""
          SELECT f.month, f.article_id, f.term, n.n, f.tf * (ln((1.0 + n.n) / (1.0 + v.df)) + 1) AS w
          FROM {name}f f JOIN {name}v v ON v.month = f.month AND v.term = f.term JOIN mn n ON n.month = f.month""",
        f"{name}u": f"SELECT month, term, n, w / sqrt(sum(w * w) OVER (PARTITION BY article_id)) AS u FROM {name}w",
        f"{name}m": f"SELECT month, term, round(sum(u) / any_value(n), 9) AS mean FROM {name}u GROUP BY month, term",
        f"{name}t": f"""
          SELECT month, CAST(r AS INTEGER) AS rank, term, round(mean, 4) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY month ORDER BY mean DESC, term) AS r FROM {name}m) WHERE r <= 50""",
    }


cte(
    mn="SELECT month, count(*) AS n FROM art GROUP BY month",
    # fixed vocabulary
    ltok=f"SELECT month, article_id, unnest(regexp_extract_all(lower(content_text), '{TOKEN}')) AS w FROM art",
    ftf="SELECT month, article_id, w AS term, count(*) AS tf FROM ltok WHERE w IN (SELECT word FROM kw) GROUP BY ALL",
    fdf="SELECT month, term, count(*) AS df FROM ftf GROUP BY ALL",
    fw="""
      SELECT f.month, f.article_id, f.term, f.tf * (ln((1.0 + n.n) / (1.0 + d.df)) + 1) AS w
      FROM ftf f JOIN fdf d ON d.month = f.month AND d.term = f.term JOIN mn n ON n.month = f.month""",
    fu="SELECT month, article_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY article_id)) AS weight FROM fw",
    fsum="SELECT f.month, k.policy, sum(f.weight) AS score FROM fu f JOIN kw k ON k.word = f.term GROUP BY ALL",
    ftot="""
      SELECT g.month, CAST(g.policy AS INTEGER) AS policy, coalesce(s.score, 0.0) AS score
      FROM grid g LEFT JOIN fsum s ON s.month = g.month AND s.policy = g.policy""",
    # one vectoriser per policy
    ptf="SELECT b.month, b.article_id, k.policy, lower(b.w) AS term, count(*) AS tf FROM btok b JOIN kw k ON k.word = b.w GROUP BY ALL",
    pdf="SELECT month, policy, term, count(*) AS df FROM ptf GROUP BY ALL",
    pw="""
      SELECT f.article_id, f.policy, f.tf * (ln((1.0 + n.n) / (1.0 + d.df)) + 1) AS w
      FROM ptf f JOIN pdf d ON d.month = f.month AND d.policy = f.policy AND d.term = f.term JOIN mn n ON n.month = f.month""",
    psum="SELECT article_id, policy, sum(w) / sqrt(sum(w * w)) AS score FROM pw GROUP BY ALL",
    psc="""
      SELECT a.month, a.article_id, a.title, CAST(p.policy AS INTEGER) AS policy, coalesce(s.score, 1.0) AS score
      FROM art a CROSS JOIN pol p LEFT JOIN psum s ON s.article_id = a.article_id AND s.policy = p.policy""",
    psc4="SELECT month, article_id, title, policy, round(score, 4) AS score FROM psc",
    prk="""
      SELECT month, policy, article_id, title, score, CAST(r AS INTEGER) AS rank FROM (
        SELECT *, rank() OVER (PARTITION BY month, policy ORDER BY score DESC) AS r FROM psc4) WHERE r <= 3""",
    # policy type from scores
    stot="SELECT month, policy, round(score, 4) AS score FROM ftot",
    smed="SELECT policy, median(score) AS median FROM stot GROUP BY policy",
    sthr="""
      SELECT policy, min(score) AS threshold FROM (
        SELECT policy, score, row_number() OVER (PARTITION BY policy ORDER BY score DESC, month) AS r FROM stot)
      WHERE r <= 10 GROUP BY policy""",
    stype="""
      SELECT m.month, CAST(b.policy AS INTEGER) AS policy FROM (SELECT DISTINCT month FROM stot) m LEFT JOIN (
        SELECT c.month, c.policy, row_number() OVER (PARTITION BY c.month ORDER BY c.score DESC, c.policy) AS r
        FROM stot c JOIN smed ON smed.policy = c.policy JOIN sthr ON sthr.policy = c.policy
        WHERE c.score > smed.median AND c.score >= sthr.threshold) b ON b.month = m.month AND b.r = 1""",
    # title terms
    **gram_ctes("tt", "lw", (2, 3)),
    tfreq="SELECT term, count(*) AS cnt FROM ttt GROUP BY term",
    twords="SELECT DISTINCT unnest(string_split(term, ' ')) AS word FROM ttt",
    # tagged title terms
    gw="SELECT month, article_id, list(lower(w) ORDER BY pos) AS ws FROM tagged WHERE length(w) >= 2 GROUP BY ALL",
    **gram_ctes("tg", "gw", (2, 3)),
    gwords="SELECT DISTINCT unnest(string_split(term, ' ')) AS word FROM tgt",
    # bigrams of all title words
    bw=f"SELECT month, article_id, regexp_extract_all(lower(title), '{TOKEN}') AS ws FROM art",
    bg="""
      SELECT month, article_id, ws[i] || ' ' || ws[i + 1] AS term FROM (
        SELECT month, article_id, ws, unnest(range(1, len(ws))) AS i FROM bw)""",
    bf="SELECT month, article_id, term, count(*) AS tf FROM bg GROUP BY ALL",
    bs="""
      SELECT b.month, b.term, round(max(b.tf) * ln((any_value(n.n) + 1.0) / (count(*) + 1.0)), 9) AS score
      FROM bf b JOIN mn n ON n.month = b.month GROUP BY b.month, b.term""",
)


@query("tfidf_fixed_vocab", "SELECT month, article_id, term, round(weight, 6) AS weight FROM fu")
def tfidf_fixed_vocab(spark, sf):
    rows = tfidf.tfidf_fixed_vocab(articles(spark, sf), WORDS)
    return rows.select("month", "article_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_policy_totals", """
  SELECT t.month, t.policy, round(t.score, 6) AS score, CAST(b.policy AS INTEGER) AS top_policy FROM ftot t JOIN (
    SELECT month, policy, row_number() OVER (PARTITION BY month ORDER BY round(score, 9) DESC, policy) AS r FROM ftot) b
  ON b.month = t.month AND b.r = 1""")
def tfidf_policy_totals(spark, sf):
    totals = tfidf.tfidf_policy_totals(articles(spark, sf), WORDS).withColumn("sort_key", round_key(F.col("score")))
    totals = stage(totals, "totals")
    top = monthly.month_argmax(totals, "sort_key").withColumnRenamed("policy", "top_policy")
    return totals.join(top, "month").select("month", "policy", F.round("score", 6).alias("score"), "top_policy")


def article_scores(spark, sf):
    return tfidf.article_policy_tfidf(articles(spark, sf), WORDS)


@query("article_policy_tfidf", "SELECT month, article_id, title, policy, round(score, 6) AS score FROM psc")
def article_policy_tfidf(spark, sf):
    rows = tfidf.long_scores(article_scores(spark, sf))
    return rows.select("month", "article_id", "title", "policy", F.round("score", 6).alias("score"))


@query("article_tfidf_totals", "SELECT month, policy, round(sum(score), 6) AS score FROM psc GROUP BY month, policy")
def article_tfidf_totals(spark, sf):
    totals = tfidf.article_tfidf_totals(article_scores(spark, sf))
    return totals.select("month", "policy", F.round("score", 6).alias("score"))


@query("assign_policy_type_tfidf", "SELECT month, policy AS policy_type FROM stype")
def assign_policy_type_tfidf(spark, sf):
    totals = tfidf.tfidf_policy_totals(articles(spark, sf), WORDS)
    rounded = stage(totals.withColumn("score", F.round("score", 4)), "totals")
    return monthly.assign_policy_type(rounded, monthly.TOP_SCORES, "score")


@query("top3_rank", "SELECT month, policy, article_id, title, score, rank FROM prk")
def top3_rank(spark, sf):
    scores = stage(tfidf.long_scores(article_scores(spark, sf)), "article-scores")
    return ranking.top_rank(scores).select("month", "policy", "article_id", "title", "score", "rank")


@query("top_n_row_number", """
  SELECT policy, article_id, title, score, CAST(r AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY policy ORDER BY score DESC, article_id) AS r FROM psc4) WHERE r <= 3""")
def top_n_row_number(spark, sf):
    scores = tfidf.long_scores(article_scores(spark, sf))
    return ranking.top_n_articles(scores).select("policy", "article_id", "title", "score", "rank")


def title_grams(spark, sf):
    return tfidf.gram_counts(tfidf.title_tokens(articles(spark, sf)), 2, 3, min_length=2)


@query("top_terms_month", "SELECT month, rank, term, score FROM ttt")
def top_terms_month(spark, sf):
    return tfidf.top_terms_month(title_grams(spark, sf))


@query("top_words_mllib", """
  SELECT month, CAST(r AS INTEGER) AS rank, term, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, term) AS r FROM bs) WHERE r <= 50""")
def top_words_mllib(spark, sf):
    grams = tfidf.gram_counts(tfidf.title_tokens(articles(spark, sf)), 2, 2)
    return tfidf.top_words(grams).select("month", "rank", "term", F.round("score", 6).alias("score"))


@query("hashed_tfidf")
def hashed_tfidf(spark, sf):
    return tfidf.hashed_tfidf(articles(spark, sf)).select("month", "article_id", "bucket", "tfidf")


@query("hashed_bigram_counts", """
  SELECT t.month, t.article_id, CAST(t.c - 1 AS DOUBLE) AS n_bigrams, m.n
  FROM (SELECT month, article_id, count(*) AS c FROM ttok GROUP BY ALL HAVING count(*) > 1) t
  JOIN (SELECT month, count(*) AS n FROM art GROUP BY month) m ON m.month = t.month""")
def hashed_bigram_counts(spark, sf):
    """What the hash cannot change: the buckets of an article hold all its bigrams, and its month all its articles."""
    rows = tfidf.hashed_tfidf(articles(spark, sf))
    return rows.groupBy("month", "article_id").agg(F.sum("tf").alias("n_bigrams"), F.first("n").alias("n"))


def frequencies(spark, sf):
    counts = tfidf.term_month_frequency(tfidf.top_terms_month(title_grams(spark, sf)))
    return ranking.enumerate_rows(counts, [F.desc("cnt"), F.asc("term")])


@query("term_month_frequency", "SELECT row_number() OVER (ORDER BY cnt DESC, term) AS rank, term, cnt FROM tfreq")
def term_month_frequency(spark, sf):
    return frequencies(spark, sf).select("rank", "term", "cnt")


@query("rank_articles", "SELECT month, policy, article_id, cnt, rank FROM rnk")
def rank_articles(spark, sf):
    counts = keywords.article_counts(articles(spark, sf), WORDS)
    return ranking.rank_articles(stage(keywords.label_articles(counts), "labels"))
