"""Keyword counting per article and per month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrace.functions.columns import let
from pricetrace.functions.text import keep_words, phrase_hits, phrase_of, tokens
from pricetrace.keyword_sets import Keywords, all_words, keywords_df
from pricetrace.scratch import stage

TITLE_WEIGHT, BODY_WEIGHT = 2, 1  # fixed values
#: Share of all tokens from which a word counts as frequent.
FREQUENT = 0.001

_PAIR = "array<struct<policy:int,cnt:bigint>>"


def count_array(text: Column, keywords: Keywords, phrases: bool = False) -> Column:
    """array<struct<policy, cnt>>, one entry per policy, zeros included.

    The text is tokenised once and cut down to keyword tokens; the policies then count in that short
    list. Everything stays inside the row, so no token is ever shuffled. With `phrases`, keywords of several tokens
    count wherever these follow each other, besides the exact tokens; without it they never count.
    """

    def per_policy(hits: Column) -> Column:
        def count(words: list[str]) -> Column:
            found = F.size(keep_words(hits, words))
            own = sorted({phrase for phrase in map(phrase_of, words) if phrase}) if phrases else []
            return (found + F.size(F.filter(hits, lambda hit: hit.isin(own))) if own else found).cast("long")

        entries = [F.struct(F.lit(policy).alias("policy"), count(words).alias("cnt")) for policy, words in sorted(keywords.items())]
        return F.array(*entries).cast(_PAIR)

    words = all_words(keywords)
    if not phrases:
        return let(keep_words(tokens(text), words), per_policy)
    return let(tokens(text), lambda toks: let(F.concat(keep_words(toks, words), phrase_hits(toks, words)), per_policy))


def article_counts(articles: DataFrame, keywords: Keywords, phrases: bool = False) -> DataFrame:
    """(month, article_id, has_title, has_body, title_counts, body_counts): one pass over the texts for all counting.

    Consumers choose their null rule by the two flags. The flags are plain null tests on the source
    columns, so a filter on them reaches the scan; one on the count arrays would count everything twice.
    """
    return articles.select(
        "month",
        "article_id",
        F.col("title").isNotNull().alias("has_title"),
        F.col("content_text").isNotNull().alias("has_body"),
        count_array(F.col("title"), keywords, phrases).alias("title_counts"),
        count_array(F.col("content_text"), keywords, phrases).alias("body_counts"),
    )


def keyword_counts(articles: DataFrame, keywords: Keywords | DataFrame, column: str = "content_text") -> DataFrame:
    """(month, policy, cnt) over bodies, by joining exploded tokens with the keyword table.

    Keywords are a dictionary or a table (policy, word) of any size, such as labelled words give; a word of two policies
    counts for both. Counts are added up per task before the one shuffle on (month, policy), so a hot month costs nothing extra.
    """
    table = keywords if isinstance(keywords, DataFrame) else keywords_df(articles.sparkSession, keywords)
    table = table.select("policy", "word").distinct()
    bodies = articles.where(F.col(column).isNotNull())
    words = bodies.select("month", F.explode(tokens(F.col(column))).alias("word")).groupBy("month", "word").agg(F.count("*").alias("n"))
    found = words.join(table, "word").groupBy("month", "policy").agg(F.sum("n").alias("cnt"))
    # Months times policies is the size of the result; every policy is a row of every month.
    grid = articles.select("month").distinct().crossJoin(table.select("policy").distinct())
    return grid.join(found, ["month", "policy"], "left").select(
        "month", "policy", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt")
    )


def weighted_counts(counts: DataFrame, null_rule: str = "any", weights: tuple[int, int] = (TITLE_WEIGHT, BODY_WEIGHT)) -> DataFrame:
    """(month, policy, cnt) from `article_counts`, titles and bodies weighted.

    `null_rule="any"` ignores an article when title or body is missing; `independent` counts what there is.
    """
    if null_rule == "any":
        counts = counts.where(F.col("has_title") & F.col("has_body"))

    def scaled(column: str, weight: int) -> Column:
        return F.transform(column, lambda p: F.struct(p.policy.alias("policy"), (p.cnt * weight).alias("cnt")))

    parts = F.concat(scaled("title_counts", weights[0]), scaled("body_counts", weights[1]))
    return counts.select("month", F.inline(parts)).groupBy("month", "policy").agg(F.sum("cnt").alias("cnt"))


def body_counts(counts: DataFrame) -> DataFrame:
    """(month, policy, cnt) from `article_counts`, bodies only."""
    return counts.select("month", F.inline_outer("body_counts")).groupBy("month", "policy").agg(F.sum("cnt").alias("cnt"))


def article_policy_counts(counts: DataFrame) -> DataFrame:
    """(month, article_id, policy, cnt), zeros included; articles without a body or id are left out.

    The arrays are never empty, so the outer form gives the same rows; the inner one would have the
    optimizer add a filter on their size, which counts every text a second time.
    """
    rows = counts.where(F.col("article_id").isNotNull() & F.col("has_body"))
    return rows.select("month", "article_id", F.inline_outer("body_counts"))


def label_articles(counts: DataFrame) -> DataFrame:
    """(month, article_id, policy, cnt): the policy counted most often in the body.

    Ties go to the lowest policy number; an article without any keyword gets a null policy.
    """
    best = F.array_max(F.transform("body_counts", lambda p: F.struct(p.cnt.alias("cnt"), (-p.policy).alias("neg"))))
    rows = counts.where(F.col("article_id").isNotNull() & F.col("has_body"))
    return rows.select("month", "article_id", best.alias("best")).select(
        "month",
        "article_id",
        F.when(F.col("best.cnt") > 0, -F.col("best.neg")).alias("policy"),
        F.col("best.cnt").alias("cnt"),
    )


def frequent_words(words: DataFrame, total: int, share: float = FREQUENT) -> DataFrame:
    """(word) of every word that makes up at least `share` of the `total` rows: at most 1 / share rows, whatever the input."""
    return words.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("_n")).where(F.col("_n") >= share * total).select("word")


def wanted_words(words: DataFrame, lexicon: DataFrame, total: int, share: float = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """The rows of `words` whose word is in the lexicon, in two parts: frequent words, and all others.

    Frequent words are looked up first and their verdict is sent to every task (1 / share rows at most), so their rows are
    settled where they are read. Only the others meet the lexicon in a join, in which no key is hot. Null words are dropped.
    """
    entries = lexicon.select("word").distinct()
    known = frequent_words(words, total, share).join(entries.withColumn("_wanted", F.lit(True)), "word", "left").select("word", F.coalesce("_wanted", F.lit(False)).alias("_wanted"))
    marked = words.join(F.broadcast(known), "word", "left")
    settled = marked.where("_wanted").drop("_wanted")
    rest = marked.where("_wanted IS NULL AND word IS NOT NULL").drop("_wanted")
    return settled, rest.join(entries, "word", "left_semi")


def tag_filter(articles: DataFrame, lexicon: DataFrame, tags: list[str], column: str = "title") -> DataFrame:
    """(month, article_id, tokens): tokens whose lexicon tag is wanted, in text order; articles without any keep an empty list.

    A word with several tags passes once if one of them is wanted. Tokens meet the lexicon in `wanted_words`, so it may
    be of any size and any word may stand in every title. Rows are put together by a row number, because ids may
    repeat; each task does so for its own rows first, and one short list per article is shuffled.
    """
    row = F.monotonically_increasing_id().alias("_row")
    rows = stage(articles.select("month", "article_id", row, tokens(F.col(column)).alias("_t")), "titles")
    total = rows.agg(F.sum(F.size("_t"))).head()[0] or 0
    words = rows.select("month", "article_id", "_row", F.posexplode("_t").alias("pos", "word"))
    settled, others = wanted_words(words, lexicon.where(F.col("tag").isin(tags)), total)
    columns = ["_row", "month", "article_id"]
    found = settled.select(*columns, F.struct("pos", "word").alias("one")).unionByName(others.select(*columns, F.struct("pos", "word").alias("one")))
    empty = rows.select(*columns, F.lit(None).cast("struct<pos:int,word:string>").alias("one"))
    grouped = empty.unionByName(found).groupBy(*columns).agg(F.sort_array(F.collect_list("one")).alias("found"))
    return grouped.select("month", "article_id", F.col("found.word").alias("tokens"))
