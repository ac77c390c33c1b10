"""Top terms by a uniform threshold against a plain count."""

import collections
import random

import pytest

from pricetrace.operators import threshold


def grams_of(spark, documents, parts):
    rows = [(month, i, sorted(collections.Counter(terms).items())) for i, (month, terms) in enumerate(documents)]
    return spark.createDataFrame(rows, "month string, doc bigint, grams array<struct<term:string,tf:bigint>>").repartition(parts)


def plain_top(documents, n):
    freq, df = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for month, terms in documents:
        freq[month].update(terms)
        df[month].update(set(terms))
    out = []
    for month, counts in freq.items():
        ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:n]
        out += [(month, term, count, df[month][term], rank) for rank, (term, count) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 7, 200])
def test_threshold_equals_a_plain_count(spark, n):
    rng = random.Random(n)
    documents = [(f"2020{1 + i % 3:02d}", [f"t{int(rng.paretovariate(0.7))}é"[:6] for _ in range(rng.randrange(12))]) for i in range(600)]
    documents += [("202009", ["a", "b", "b"]), ("202010", []), ("202011", [f"x{i}" for i in range(50)])]
    got = threshold.vocab_cap_by_threshold(grams_of(spark, documents, 6), n).collect()
    assert sorted(map(tuple, got)) == plain_top(documents, n)
    assert threshold.vocab_cap_by_threshold(grams_of(spark, documents, 2).limit(0), n).count() == 0


def test_fewer_rows_are_sent_than_there_are_terms(spark):
    rng = random.Random(4)
    documents = [("202001", [f"t{int(rng.paretovariate(0.9))}" for _ in range(40)] + [f"only{i}x{j}" for j in range(20)]) for i in range(2000)]
    local = threshold.local_counts(grams_of(spark, documents, 8))
    rounds = threshold.top_terms(local, 20)
    sent = sum(df.count() for df in (rounds.leaders, rounds.large, rounds.survivors))
    assert sent < 0.1 * local.select("term").distinct().count()
    assert sorted(tuple(r)[:5] for r in rounds.result.select("month", "term", "freq", "df", "rank").collect()) == plain_top(documents, 20)


def test_a_task_stores_many_terms_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(threshold, "_ADD_UP", 1000)
    monkeypatch.setattr(threshold, "_PART_TERMS", 1000, raising=False)
    documents = [(f"20200{1 + i % 2}", [f"t{i}x{j}" for j in range(30)] + ["all", f"t{i % 7}", f"t{i % 7}"]) for i in range(1500)]
    local = threshold.local_counts(grams_of(spark, documents, 1))
    sizes = [row["count"] for row in local.groupBy("part").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 12_000
    got = threshold.top_terms(local, 40).result.select("month", "term", "freq", "df", "rank").collect()
    assert sorted(map(tuple, got)) == plain_top(documents, 40)
