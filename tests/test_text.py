"""Tokens, keyword counts and labels on hand-made articles."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from pricetrace import keyword_sets
from pricetrace.functions import text
from pricetrace.functions.columns import pad_id, parse_number, policy_label, policy_number
from pricetrace.operators import clean, keywords
from pricetrace.scratch import setting

WORDS = {1: ["금리", "LTV", "of the"], 2: ["전세", "월세"], 3: ["금리"]}

ROWS = [
    ("202001", "0000000001", "금리 인상", "금리 LTV_70% été 전세"),
    ("202001", "0000000002", "전세 전세", "전세 금리"),
    ("202001", "0000000003", None, "월세 월세 LTV ltv"),
    ("202002", "0000000004", "no words", "of the nothing"),
    ("202002", "0000000005", "금리", None),
    ("202002", "0000000006", "", "   "),
]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(ROWS, "month string, article_id string, title string, content_text string")


def test_tokens_are_unicode_words(spark):
    samples = ["금리 LTV_70% été", "éte", "a-b c'd", "", None, "x y"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(text.tokens(F.col("s"))).collect()]
    assert got == [re.findall(r"\w+", s) if s else [] for s in samples]


def _python_counts(rows, weights=(2, 1), null_rule="any"):
    result = collections.Counter()
    for month, _, title, body in rows:
        if null_rule == "any" and (title is None or body is None):
            continue
        for part, weight in ((title, weights[0]), (body, weights[1])):
            counts = collections.Counter(re.findall(r"\w+", part or ""))
            for policy, words in WORDS.items():
                result[month, policy] += weight * sum(counts[w] for w in words)
    return dict(result)


@pytest.mark.parametrize("null_rule", ["any", "independent"])
def test_weighted_counts(articles, null_rule):
    got = keywords.weighted_counts(keywords.article_counts(articles, WORDS), null_rule).collect()
    assert {(r.month, r.policy): r.cnt for r in got} == _python_counts(ROWS, null_rule=null_rule)


def test_joined_and_inline_counts_agree(articles):
    by_join = {tuple(r) for r in keywords.keyword_counts(articles, WORDS).collect()}
    bodies = articles.where("content_text is not null")
    by_row = {tuple(r) for r in keywords.body_counts(keywords.article_counts(bodies, WORDS)).collect()}
    assert by_join == by_row


def test_phrases_count_as_consecutive_tokens(spark):
    words = ["전매 제한", "a b", "a b c", "b a", "a a", "solo", "x-y", "  ", "z"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "c", "x", "y", "solo", "전매", "제한"]) + rng.choice([" ", "-", ", ", "\n"]) for _ in range(rng.randrange(25))) for _ in range(200)] + ["", None, "a b", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [collections.Counter(r[0]) for r in df.select(text.phrase_hits(text.tokens(F.col("t")), words)).collect()]
    want = []
    for t in texts:
        toks = re.findall(r"\w+", t or "")
        counts = collections.Counter()
        for phrase in ("전매 제한", "a b", "a b c", "b a", "a a", "x y"):
            own = phrase.split()
            counts[phrase] = sum(toks[i : i + len(own)] == own for i in range(len(toks)))
        want.append(+counts)
    assert got == want
    counted = df.select(keywords.count_array(F.col("t"), {1: ["a b", "solo"], 2: ["z"]}, phrases=True).alias("c")).collect()
    assert [r.c[0].cnt for r in counted] == [w["a b"] + len(re.findall(r"\bsolo\b", t or "")) for w, t in zip(want, texts)] and all(r.c[1].cnt == 0 for r in counted)


def test_labels_take_lowest_policy_on_ties_and_none_without_words(articles):
    got = {r.article_id: (r.policy, r.cnt) for r in keywords.label_articles(keywords.article_counts(articles, WORDS)).collect()}
    assert got == {
        "0000000001": (1, 1),  # 금리 counts for 1 and 3, 전세 for 2: all equal
        "0000000002": (1, 1),
        "0000000003": (2, 2),
        "0000000004": (None, 0),  # a phrase never counts
        "0000000006": (None, 0),
    }


def test_phrases_are_inert_in_the_given_dictionaries():
    counts = [len(keyword_sets.all_words(d)) for d in (keyword_sets.COUNTING, keyword_sets.REPORTING, keyword_sets.SCORING)]
    assert counts == [31, 45, 53]
    inert = [sum(' ' in w for w in keyword_sets.all_words(d)) for d in (keyword_sets.COUNTING, keyword_sets.REPORTING)]
    assert inert == [8, 6]


def test_ngrams_and_term_counts(spark):
    rows = [(["a", "b", "a", "b"],), (["x"],), ([],)]
    df = spark.createDataFrame(rows, "t array<string>")
    got = df.select(text.word_ngrams(F.col("t"), 2, 3).alias("g")).select("g", text.term_counts(F.col("g")).alias("c")).collect()
    assert got[0].g == ["a b", "b a", "a b", "a b a", "b a b"]
    assert [(x.term, x.tf) for x in got[0].c] == [("a b", 2), ("a b a", 1), ("b a", 1), ("b a b", 1)]
    assert got[1].g == [] and got[2].c == []


def test_term_counts_against_counter(spark):
    words = [[chr(97 + (i * i + j * 7) % 5) for j in range(i)] for i in range(40)]
    df = spark.createDataFrame([(w,) for w in words], "t array<string>")
    for row in df.select("t", text.term_counts(F.col("t")).alias("c")).collect():
        assert {x.term: x.tf for x in row.c} == dict(collections.Counter(row.t))


def test_restrict_and_stopwords(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["z"],), ([],)], "t array<string>")
    kept = [r[0] for r in df.select(text.restrict_tokens(F.col("t"), ["a", "a b"], "none")).collect()]
    assert kept == [["a", "a"], ["none"], ["none"]]
    assert [r[0] for r in df.select(text.drop_words(F.col("t"), ["a"])).collect()] == [["b"], ["z"], []]


def test_tag_filter_keeps_order_repeats_and_copies(spark, articles):
    art = spark.createDataFrame(
        [("m", "1", "b a b c"), ("m", "1", "a"), ("m", None, "c d"), ("m", "2", None)], "month string, article_id string, title string"
    )
    lexicon = spark.createDataFrame([("a", "NNG"), ("a", "JX"), ("b", "VV"), ("c", "JX")], "word string, tag string")
    got = keywords.tag_filter(art, lexicon, ["NNG", "VV"]).collect()
    assert sorted((r.article_id or "", r.tokens) for r in got) == [("", []), ("1", ["a"]), ("1", ["b", "a", "b"]), ("2", [])]


def test_frequent_words_are_settled_before_the_join(spark):
    titles = [("m", str(i), f"hot w{i} w{i + 1}" if i % 50 else None) for i in range(2000)]
    art = spark.createDataFrame(titles, "month string, article_id string, title string")
    lexicon = spark.createDataFrame([("hot", "NNG"), ("off", "JX")] + [(f"w{i}", "NNG" if i % 3 else "JX") for i in range(2001)], "word string, tag string")
    words = art.select("article_id", F.explode(text.tokens(F.col("title"))).alias("word")).unionByName(spark.createDataFrame([("n", None)] * 50, "article_id string, word string"))
    total = words.count()
    assert [r.word for r in keywords.frequent_words(words, total).collect()] == ["hot"]
    settled, others = keywords.wanted_words(words, lexicon.where("tag = 'NNG'"), total)
    assert settled.select("word").distinct().collect() == [("hot",)] and settled.count() == 1960
    assert others.groupBy("word").count().agg(F.max("count")).head()[0] <= 2
    want = {str(i): [w for w in (f"hot w{i} w{i + 1}" if i % 50 else "").split() if w == "hot" or int(w[1:]) % 3] for i in range(2000)}
    for size in ("-1", "10485760"):
        with setting(spark, "spark.sql.autoBroadcastJoinThreshold", size):
            got = keywords.tag_filter(art, lexicon, ["NNG"]).collect()
        assert {r.article_id: r.tokens for r in got} == want


def test_null_drop_modes_and_script_filter(spark, articles):
    assert clean.drop_required_nulls(articles, ["title", "content_text"]).count() == 4
    assert clean.drop_required_nulls(articles, ["title", "content_text"], "all").count() == 6
    assert {r.article_id[-1] for r in clean.script_filter(articles).collect()} == {"1", "2", "3"}


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("82,500", "5037070"), ("n/a", "12345678901"), (None, "0004373862")], "a string, i string")
    got = df.select(parse_number(F.col("a")).alias("a"), pad_id(F.col("i")).alias("i")).collect()
    assert [r.a for r in got] == [82500.0, None, None]
    assert [r.i for r in got] == ["0005037070", "12345678901", "0004373862"]
    labels = spark.createDataFrame([(1,), (None,)], "p int").select(policy_label(F.col("p")).alias("l"))
    assert [r.l for r in labels.collect()] == ["정책 1", "None"]
    assert [r[0] for r in labels.select(policy_number(F.col("l"))).collect()] == [1, None]


def test_rank_filter_tolerates_literal_none(spark):
    df = spark.createDataFrame([("정책 1", "1"), ("정책 1", "None"), ("정책 1", "4"), ("정책 2", "1")], "Policy string, Rank string")
    assert clean.policy_rank_filter(df, "정책 1", 3, "Policy", "Rank").count() == 1


def test_labelled_keywords(spark):
    labelled = spark.createDataFrame([(1, "계약", 1), (2, "계약", 2), (3, "계약", 2)], "ordinal int, word string, label int")
    table = keyword_sets.keywords_from_labels(labelled)
    assert sorted(map(tuple, table.collect())) == [(1, "계약"), (2, "계약")]
