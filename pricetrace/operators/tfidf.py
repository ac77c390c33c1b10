"""TF-IDF scores, fitted separately for every month.

Two shapes are used. With a known vocabulary an article becomes a short list of (index, tf), the
document frequencies of a month become one array, and scoring is arithmetic inside the row. Without
one (n-grams), terms are rows: counted per document inside the row, added up per task and capped per
month before any of them is compared with the documents again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, NGram, Tokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrace.functions.columns import let, round_key
from pricetrace.functions.text import is_single_word, joined, keep_words, term_counts, tokens, word_ngrams
from pricetrace.keyword_sets import Keywords, all_words
from pricetrace.operators.ranking import top_rows
from pricetrace.scratch import stage

MAX_TERMS, TOP_TERMS, HASH_BUCKETS = 1000, 50, 1000  # fixed values
PLACEHOLDER = "없음"  # fixed value: stands in for a document without policy words

_SPARSE = "array<struct<i:int,tf:bigint>>"


@dataclass(frozen=True)
class Entry:
    """One vocabulary position: a policy's term, the spellings counted for it, and whether it scores."""

    policy: int
    term: str
    spellings: tuple[str, ...]
    scores: bool = True


def _sparse_counts(hits: Column, vocabulary: list[Entry]) -> Column:
    """array<struct<i, tf>> of the vocabulary entries that occur among the hits."""
    spellings = F.array(*[F.array(*[F.lit(w) for w in e.spellings]) for e in vocabulary])
    counts = F.transform(
        spellings,
        lambda ws, i: F.struct(
            i.cast("int").alias("i"), F.size(F.filter(hits, lambda h: F.array_contains(ws, h))).cast("long").alias("tf")
        ),
    )
    return F.filter(counts, lambda e: e.tf > 0)


def _vectors(articles: DataFrame, text: Column, vocabulary: list[Entry], keep: list[str]) -> DataFrame:
    """(month, *keep, terms), staged because both frequencies and scores are computed from it."""
    if vocabulary:
        words = sorted({w for e in vocabulary for w in e.spellings})
        terms = let(keep_words(tokens(text), words), lambda hits: _sparse_counts(hits, vocabulary))
    else:
        terms = F.array().cast(_SPARSE)
    return stage(articles.select("month", *keep, terms.alias("terms")), "vectors")


def idf_by_month(vectors: DataFrame, size: int) -> DataFrame:
    """(month, idf): ln((1+n)/(1+df)) + 1 of every vocabulary position, one array of `size` values per month.

    One aggregation serves both counts: position -1 is marked once per article.
    """
    marks = vectors.select("month", F.explode(F.concat(F.array(F.lit(-1)), F.col("terms.i"))).alias("i"))
    counts = marks.groupBy("month", "i").agg(F.count("*").alias("n"))
    by_month = counts.groupBy("month").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("df"))

    def weight(i: Column) -> Column:
        n = F.try_element_at("df", F.lit(-1))
        return F.log((n + 1) / (F.coalesce(F.try_element_at("df", i), F.lit(0)) + 1)) + 1

    positions = F.sequence(F.lit(0), F.lit(size - 1)) if size else F.array().cast("array<int>")
    return by_month.select("month", F.transform(positions, weight).alias("idf"))


def _weights(terms: str = "terms", idf: str = "idf") -> Column:
    """array<struct<i, tf, w>> with w = tf · idf."""
    return F.transform(
        terms, lambda e: F.struct(e.i.alias("i"), e.tf.alias("tf"), (e.tf * F.get(F.col(idf), e.i)).alias("w"))
    )


def _sum(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x))


def _unit(weights: Column) -> Column:
    """Weights divided by their L2 norm; an empty list stays empty."""
    return let(
        F.sqrt(_sum(weights, lambda e: e.w * e.w)),
        lambda norm: F.transform(weights, lambda e: F.struct(e.i.alias("i"), (e.w / norm).alias("w"))),
    )


def fixed_vocabulary(keywords: Keywords) -> list[str]:
    return [w for w in all_words(keywords) if is_single_word(w)]


def fixed_vocab_weights(articles: DataFrame, keywords: Keywords) -> DataFrame:
    """(month, article_id, weights array<struct<i, w>>), i counting through `fixed_vocabulary`.

    Texts are lowercased and the vocabulary is not, so entries with capitals never score.
    """
    vocabulary = [Entry(0, w, (w,)) for w in fixed_vocabulary(keywords)]
    bodies = articles.where(F.col("content_text").isNotNull())
    vectors = _vectors(bodies, F.lower("content_text"), vocabulary, ["article_id"])
    weighted = vectors.join(idf_by_month(vectors, len(vocabulary)), "month")
    return weighted.select("month", "article_id", let(_weights(), _unit).alias("weights"))


def tfidf_fixed_vocab(articles: DataFrame, keywords: Keywords) -> DataFrame:
    """(month, article_id, term, weight) of the terms present."""
    terms = F.array(*[F.lit(w) for w in fixed_vocabulary(keywords)])
    weights = fixed_vocab_weights(articles, keywords)
    # The outer form keeps the optimizer from computing all weights a second time to test their number.
    rows = weights.select("month", "article_id", F.inline_outer("weights")).where(F.col("i").isNotNull())
    return rows.select("month", "article_id", F.get(terms, F.col("i")).alias("term"), F.col("w").alias("weight"))


def tfidf_policy_totals(articles: DataFrame, keywords: Keywords) -> DataFrame:
    """(month, policy, score): unit weights of a policy's words added up over the month's articles."""
    index = {w: i for i, w in enumerate(fixed_vocabulary(keywords))}

    def total(policy: int) -> Column:
        mine = [index[w] for w in sorted(set(keywords[policy])) if w in index]
        score = _sum(F.filter("weights", lambda e: e.i.isin(mine)), lambda e: e.w) if mine else F.lit(0.0)
        return F.struct(F.lit(policy).alias("policy"), score.alias("score"))

    scores = F.array(*[total(p) for p in sorted(keywords)])
    rows = fixed_vocab_weights(articles, keywords).select("month", F.inline_outer(scores))
    return rows.groupBy("month", "policy").agg(F.sum("score").alias("score"))


def policy_vocabulary(keywords: Keywords) -> list[Entry]:
    """Entries sorted by policy. Words are matched as written and scored in lower case; one letter is too short to score."""
    entries = []
    for policy in sorted(keywords):
        spellings: dict[str, set[str]] = {}
        for word in keywords[policy]:
            if is_single_word(word):
                spellings.setdefault(word.lower(), set()).add(word)
        entries += [Entry(policy, t, tuple(sorted(s)), len(t) > 1) for t, s in sorted(spellings.items())]
    return entries


def article_policy_tfidf(articles: DataFrame, keywords: Keywords, placeholder: str | None = PLACEHOLDER) -> DataFrame:
    """(month, article_id, title, scores array<struct<policy, score>>), one vectoriser per policy and month.

    The score is the sum of the article's unit vector. An article without words of the policy holds only
    the placeholder and scores 1, or 0 with `placeholder=None`.
    """
    vocabulary = policy_vocabulary(keywords)
    whole = articles.dropna(subset=["article_id", "title", "content_text"])
    vectors = _vectors(whole, F.col("content_text"), vocabulary, ["article_id", "title"])
    weighted = vectors.join(idf_by_month(vectors, len(vocabulary)), "month").withColumn("weights", _weights())

    def score(policy: int) -> Column:
        mine = [i for i, e in enumerate(vocabulary) if e.policy == policy]
        scoring = [i for i in mine if vocabulary[i].scores]
        none = F.lit(0.0 if placeholder is None else 1.0)
        if not mine:
            return none
        used = F.filter("weights", lambda e: e.i.isin(scoring)) if scoring else F.filter("weights", lambda e: F.lit(False))
        length = F.sqrt(_sum(used, lambda e: e.w * e.w))
        ratio = F.coalesce(F.try_divide(_sum(used, lambda e: e.w), length), F.lit(0.0))
        return F.when(F.exists("weights", lambda e: e.i.isin(mine)), ratio).otherwise(none)

    scores = [F.struct(F.lit(p).alias("policy"), score(p).alias("score")) for p in sorted(keywords)]
    return weighted.select("month", "article_id", "title", F.array(*scores).alias("scores"))


def long_scores(scored: DataFrame) -> DataFrame:
    """(month, article_id, title, policy, score) from `article_policy_tfidf`."""
    return scored.select("month", "article_id", "title", F.inline_outer("scores"))


def article_tfidf_totals(scored: DataFrame) -> DataFrame:
    """(month, policy, score): article scores added up."""
    return scored.select("month", F.inline_outer("scores")).groupBy("month", "policy").agg(F.sum("score").alias("score"))


def title_tokens(articles: DataFrame, column: str = "title") -> DataFrame:
    return articles.select("month", "article_id", tokens(F.col(column)).alias("tokens"))


def gram_counts(tokenised: DataFrame, lo: int, hi: int, min_length: int = 1) -> DataFrame:
    """(month, doc, grams array<struct<term, tf>>), staged; `doc` numbers the rows, so repeated ids stay apart.

    Tokens are lowercased and those shorter than `min_length` dropped before n-grams are formed.
    """
    folded = F.transform("tokens", lambda t: F.lower(t))
    if min_length > 1:
        folded = F.filter(folded, lambda t: F.length(t) >= min_length)
    counted = let(word_ngrams(folded, lo, hi), term_counts)
    rows = tokenised.select("month", F.monotonically_increasing_id().alias("doc"), counted.alias("grams"))
    return stage(rows, "grams")


def vocab_cap(grams: DataFrame, n: int = MAX_TERMS) -> DataFrame:
    """(month, term, freq, df, rank): the n most frequent terms of every month; ties in alphabetical order."""
    rows = grams.select("month", F.inline("grams"))
    totals = rows.groupBy("month", "term").agg(F.sum("tf").alias("freq"), F.count("*").alias("df"))
    return top_rows(totals, ["month"], [F.desc("freq"), F.asc("term")], n)


def _documents(grams: DataFrame) -> DataFrame:
    return grams.groupBy("month").agg(F.count("*").alias("n"))


def top_terms_month(grams: DataFrame, max_terms: int = MAX_TERMS, top: int = TOP_TERMS) -> DataFrame:
    """(month, rank, term, score): mean unit-vector TF-IDF of a term over all documents of the month."""
    vocabulary = vocab_cap(grams, max_terms).join(_documents(grams), "month")
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    vocabulary = vocabulary.select("month", "term", "n", idf.alias("idf"))
    rows = grams.select("month", "doc", F.inline("grams")).join(vocabulary, ["month", "term"])
    weighted = rows.withColumn("w", F.col("tf") * F.col("idf"))
    # One shuffle by document: its few capped terms travel together and leave divided by its norm.
    documents = weighted.groupBy("month", "doc", "n").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("ws")
    )
    units = documents.select("month", "n", "norm", F.inline("ws"))
    means = units.groupBy("month", "term").agg((F.sum(F.col("w") / F.col("norm")) / F.first("n")).alias("mean"))
    ranked = top_rows(means.withColumn("mean", round_key(F.col("mean"))), ["month"], [F.desc("mean"), F.asc("term")], top)
    return ranked.select("month", "rank", "term", F.round("mean", 4).alias("score"))


def top_words(grams: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(month, rank, term, score): largest TF-IDF a term reaches in any document, with idf = ln((n+1)/(df+1)).

    idf is the same for all documents of a month, so the largest product is the largest tf times idf
    and one aggregation is enough.
    """
    rows = grams.select("month", F.inline("grams"))
    totals = rows.groupBy("month", "term").agg(F.max("tf").alias("tf"), F.count("*").alias("df"))
    scored = totals.join(_documents(grams), "month").withColumn(
        "score", round_key(F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1)))
    )
    return top_rows(scored, ["month"], [F.desc("score"), F.asc("term")], top).select("month", "rank", "term", "score")


def hashed_tfidf(articles: DataFrame, buckets: int = HASH_BUCKETS, column: str = "title") -> DataFrame:
    """(month, article_id, bucket, tf, n, tfidf) of hashed bigrams, idf = ln((n+1)/(df+1)) with the month's n articles."""
    texts = articles.select("month", "article_id", joined(tokens(F.col(column))).alias("text"))
    stages = [
        Tokenizer(inputCol="text", outputCol="words"),
        NGram(n=2, inputCol="words", outputCol="ngrams"),
        HashingTF(inputCol="ngrams", outputCol="raw_features", numFeatures=buckets),
    ]
    hashed = Pipeline(stages=stages).fit(texts).transform(texts)
    # The stored entries of the sparse vector as they are; a first one that is always there is the article's mark -1.
    fields = F.unwrap_udt("raw_features")
    cells = F.concat(F.array(F.struct(F.lit(-1).alias("bucket"), F.lit(1.0).alias("tf"))), F.arrays_zip(fields["indices"].alias("bucket"), fields["values"].alias("tf")))
    rows = stage(hashed.select("month", "article_id", F.inline(cells)), "hashed")
    counts = rows.groupBy("month", "bucket").agg(F.count("*").alias("df"))
    totals = counts.where(F.col("bucket") == -1).select("month", F.col("df").alias("n"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1))
    weights = counts.where(F.col("bucket") >= 0).join(totals, "month").select("month", "bucket", "n", idf.alias("idf"))
    weighted = rows.where(F.col("bucket") >= 0).join(weights, ["month", "bucket"])
    return weighted.select("month", "article_id", "bucket", "tf", "n", (F.col("tf") * F.col("idf")).alias("tfidf"))


def term_month_frequency(terms: DataFrame) -> DataFrame:
    """(term, cnt): in how many monthly lists a term stands."""
    return terms.groupBy("term").agg(F.count("*").alias("cnt"))


def distinct_words(lines: DataFrame) -> DataFrame:
    """Distinct words of `rank. term count` lines: the first field and plain numbers are left out."""
    fields = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    words = lines.select(F.explode(F.slice(fields, 2, F.greatest(F.size(fields), F.lit(1)))).alias("word"))
    return words.where(~F.col("word").rlike("^[0-9]+$")).distinct()
