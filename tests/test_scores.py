"""TF-IDF family and ranks against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, NGram, Tokenizer
from pyspark.sql import functions as F

from pricetrace.operators import ranking, tfidf

WORDS = {1: ["aa", "BB", "c", "of the"], 2: ["aa", "dd"]}


def corpus(seed=1, docs=40):
    rng = random.Random(seed)
    rows = []
    for i in range(docs):
        words = rng.choices(["aa", "BB", "bb", "c", "dd", "zz", "yy"], k=rng.randint(0, 12))
        rows.append((f"20200{i % 3 + 1}", str(i), f"title {i % 5} aa bb", " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(corpus(), "month string, article_id string, title string, content_text string")


def smooth_rows(docs):
    """Unit TF-IDF vectors of token lists."""
    n, df = len(docs), Counter(t for d in docs for t in set(d))
    rows = []
    for d in docs:
        weights = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(d).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        rows.append({t: w / norm for t, w in weights.items()} if norm else {})
    return rows


def by_month(rows):
    months = defaultdict(list)
    for row in rows:
        months[row[0]].append(row)
    return months


def test_fixed_vocabulary(articles):
    vocabulary = {"aa", "BB", "c", "dd"}
    want = {}
    for month, rows in by_month(corpus()).items():
        vectors = smooth_rows([[t for t in r[3].lower().split() if t in vocabulary] for r in rows])
        want |= {(month, r[1], t): w for r, v in zip(rows, vectors, strict=True) for t, w in v.items()}
    got = {(r.month, r.article_id, r.term): r.weight for r in tfidf.tfidf_fixed_vocab(articles, WORDS).collect()}
    assert got.keys() == want.keys() and "BB" not in {k[2] for k in got}
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    totals = {(r.month, r.policy): r.score for r in tfidf.tfidf_policy_totals(articles, WORDS).collect()}
    for (month, policy), score in totals.items():
        assert score == pytest.approx(sum(w for (m, _, t), w in want.items() if m == month and t in WORDS[policy]))


@pytest.mark.parametrize("placeholder", [tfidf.PLACEHOLDER, None])
def test_article_scores(articles, placeholder):
    got = {(r.article_id, r.policy): r.score for r in tfidf.long_scores(tfidf.article_policy_tfidf(articles, WORDS, placeholder)).collect()}
    for rows in by_month(corpus()).values():
        for policy, words in WORDS.items():
            kept = [[t for t in r[3].split() if t in words] for r in rows]
            scoring = [[t.lower() for t in d if len(t) > 1] if d else [tfidf.PLACEHOLDER] for d in kept]
            for row, raw, vector in zip(rows, kept, smooth_rows(scoring), strict=True):
                want = sum(vector.values())
                if not raw and placeholder is None:
                    want = 0.0
                assert got[row[1], policy] == pytest.approx(want), (row, policy)
                if placeholder and raw and any(len(t) > 1 for t in raw):
                    assert 1 - 1e-9 <= want <= math.sqrt(2) + 1e-9


def test_top_terms(articles):
    grams = tfidf.gram_counts(tfidf.title_tokens(articles), 2, 3, min_length=2)
    got = {(r.month, r.rank): (r.term, r.score) for r in tfidf.top_terms_month(grams, top=50).collect()}
    for month, rows in by_month(corpus()).items():
        # one-character tokens are dropped before n-grams are formed
        docs = [["title aa", "aa bb", "title aa bb"] for _ in rows]
        means = Counter()
        for vector in smooth_rows(docs):
            for term, weight in vector.items():
                means[term] += weight / len(rows)
        want = sorted(((round(v, 9), t) for t, v in means.items()), key=lambda x: (-x[0], x[1]))
        assert [got[month, i + 1] for i in range(len(want))] == [(t, round(v, 4)) for v, t in want]


def test_vocabulary_cap_breaks_ties_by_term(spark):
    art = spark.createDataFrame([("m", "1", ["b", "a", "c"])], "month string, article_id string, tokens array<string>")
    capped = tfidf.vocab_cap(tfidf.gram_counts(art, 1, 1), 2).orderBy("rank").collect()
    assert [(r.term, r.freq) for r in capped] == [("a", 1), ("b", 1)]


def test_hashed_scores_equal_the_ml_pipeline(spark, articles):
    month = articles.where("month = '202001'")
    stages = [
        Tokenizer(inputCol="title", outputCol="w"),
        NGram(n=2, inputCol="w", outputCol="g"),
        HashingTF(inputCol="g", outputCol="r", numFeatures=1000),
        IDF(inputCol="r", outputCol="f"),
    ]
    fitted = Pipeline(stages=stages).fit(month).transform(month)
    want = {}
    for r in fitted.select("article_id", "f").collect():
        want |= {(r.article_id, int(i)): float(v) for i, v in zip(r.f.indices, r.f.values, strict=True)}
    got = {(r.article_id, r.bucket): r.tfidf for r in tfidf.hashed_tfidf(articles).where("month = '202001'").collect()}
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()))


def test_distinct_words(spark):
    lines = spark.createDataFrame([("1. red plate 46",), ("2. hot plate 7",), ("3.",), ("",)], "value string")
    assert sorted(r.word for r in tfidf.distinct_words(lines).collect()) == ["hot", "plate", "red"]


def _ranks(values, method):
    distinct = sorted(set(values), reverse=True)
    if method == "dense":
        return {v: i + 1 for i, v in enumerate(distinct)}
    return {v: 1 + sum(x > v for x in values) for v in distinct}


@pytest.mark.parametrize("method", ["dense", "min"])
@pytest.mark.parametrize("top", [None, 1, 3])
def test_ranks_with_ties(spark, method, top):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.randint(0, 6)) for _ in range(200)]
    got = Counter(tuple(r) for r in ranking.rank_by_value(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", method, top).select("k", "v", "rank").collect())
    want = Counter()
    for k in "ab":
        ranks = _ranks([v for x, v in rows if x == k], method)
        want.update((k, v, ranks[v]) for x, v in rows if x == k and (top is None or ranks[v] <= top))
    assert got == want


def test_article_ranks_keep_unlabelled_rows(spark):
    rows = [("m", 1, "a", 5), ("m", 1, "b", 5), ("m", 1, "c", 2), ("m", None, "d", 0)]
    df = spark.createDataFrame(rows, "month string, policy int, article_id string, cnt long")
    assert {r.article_id: r.rank for r in ranking.rank_articles(df).collect()} == {"a": 1, "b": 1, "c": 2, "d": None}
    assert {r.article_id for r in ranking.rank_articles(df, 1).collect()} == {"a", "b"}


def test_nan_scores_never_rank(spark):
    rows = [("m", 1, "a", "t", float("nan")), ("m", 1, "b", "t", 1.5), ("m", 1, "c", None, 2.0)]
    df = spark.createDataFrame(rows, "month string, policy int, article_id string, title string, score double")
    assert {r.article_id: r.rank for r in ranking.top_rank(df).collect()} == {"b": 2, "c": 1}
    assert [r.article_id for r in ranking.top_n_articles(df).collect()] == ["b"]


def test_running_numbers_follow_the_order(spark):
    words = [f"{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(6)
    got = {r.w: r.rank for r in ranking.enumerate_rows(df, [F.asc("w")]).collect()}
    assert got == {w: i + 1 for i, w in enumerate(sorted(words))}
