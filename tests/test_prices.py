"""Quantiles, monthly changes and effects against plain Python and pandas."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricetrace.operators import effects, monthly, prices
from pricetrace.plans import jobs


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def test_quantiles_are_exact_whatever_the_buckets(spark):
    rng = random.Random(5)
    cases = [
        [rng.lognormvariate(8, 1) for _ in range(3000)],
        [5.0] * 2000 + [7.0] * 1000 + [rng.random() for _ in range(10)],
        [rng.gauss(0, 100) for _ in range(999)] + [None, float("nan")],
        [1e-9 * i for i in range(1500)] + [1e12],
        [1000 + 1e-6 * i for i in range(2000)],
    ]
    for values in cases:
        clean = pd.Series(values, dtype=float).dropna()
        want = [clean.quantile(q) for q in (0.01, 0.5, 0.99)]
        got = prices.exact_quantiles(frame(spark, values), "x", [0.01, 0.5, 0.99])
        assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_quantiles_of_nothing(spark):
    assert prices.exact_quantiles(frame(spark, [None]), "x", [0.5]) == [None]
    assert prices.trim_quantiles(frame(spark, [None]), "x").count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9).map(lambda x: round(x, 3)), min_size=1, max_size=60))
def test_quantiles_property(spark, values):
    got = prices.exact_quantiles(frame(spark, values), "x", [0.01, 0.99])
    assert np.allclose(got, np.quantile(values, [0.01, 0.99]), rtol=1e-9, atol=1e-6)


def test_two_pass_average_equals_trimmed_rows(spark):
    rng = random.Random(3)
    for draw in (lambda: rng.lognormvariate(3, 1), lambda: float(rng.randrange(5)), lambda: rng.gauss(0, 1), lambda: 7.0):
        rows = [(f"2020{rng.randrange(1, 4):02d}", draw()) for _ in range(700)]
        table = spark.createDataFrame(rows, "month string, unit_price double")
        want = pd.DataFrame(rows, columns=["month", "v"])
        low, high = want.v.quantile([0.01, 0.99])
        want = want[want.v.between(low, high)].groupby("month").v.mean()
        got = {r.month: r.avg_unit_price for r in prices.trimmed_average(table, ["month"]).collect()}
        assert got.keys() == set(want.index) and all(np.isclose(got[m], want[m]) for m in got)
    assert prices.trimmed_average(table.limit(0), ["month"]).count() == 0


def test_trim_keeps_both_ends(spark):
    kept = prices.trim_quantiles(frame(spark, [float(i) for i in range(101)]), "x")
    assert sorted(r.x for r in kept.collect()) == [float(i) for i in range(1, 100)]


def test_unit_price_of_bad_rows_is_null(spark):
    rows = [("1,000", 10.0), ("bad", 10.0), ("1,000", 0.0)]
    got = prices.with_unit_price(spark.createDataFrame(rows, "amount_raw string, area double")).collect()
    assert [r.unit_price for r in got] == [100.0, None, None]


def test_change_uses_previous_present_month(spark):
    rows = [("202001", 100.0), ("202003", 150.0), ("202004", 75.0)]
    base = spark.createDataFrame(rows, "month string, unit_price double")
    got = prices.percent_change(prices.monthly_average(base)).orderBy("month").collect()
    assert [r.pct_change for r in got] == [None, 50.0, -50.0]


def test_single_month_series_and_keys(spark):
    rows = [("a", "202001", 1.0), ("b", "202001", 1.0), ("b", "202002", 2.0)]
    base = spark.createDataFrame(rows, "series string, month string, unit_price double")
    got = prices.percent_change(prices.monthly_average(base, ["series"]), ["series"]).collect()
    assert {(r.series, r.month): r.pct_change for r in got} == {("a", "202001"): None, ("b", "202001"): None, ("b", "202002"): 100.0}


def test_month_range_rejects_reversed_ends(spark):
    with pytest.raises(ValueError):
        prices.month_range(frame(spark, [1.0]), "202002", "202001")


MONTHS = [(f"{2000 + i // 12}{i % 12 + 1:02d}", 2000 * 12 + i + 1) for i in range(20)]


def _labelled(spark, seed):
    rng = random.Random(seed)
    rows = []
    for name, index in MONTHS:
        if rng.random() < 0.15:
            continue  # a missing month
        change = None if not rows else round(rng.uniform(-5, 5), 2)
        rows.append((name, index, change, rng.choice([None, None, 1, 2, 3])))
    return rows, spark.createDataFrame(rows, "month string, month_idx int, pct_change double, policy int")


def _effects(rows):
    out = {}
    for month, index, _, policy in rows:
        for k in range(1, 7):
            ahead = [c for _, i, c, _ in rows if index < i <= index + k]
            if policy is not None and ahead:
                known = [c for c in ahead if c is not None]
                out[policy, month, k] = sum(known) / len(known) if known else None
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_effects_both_ways_and_winner(spark, seed):
    rows, df = _labelled(spark, seed)
    want = _effects(rows)
    for found in (effects.policy_effect(df), effects.forward_range_join(df)):
        got = {(r.policy, r.start_month, r.period): r.avg_change for r in found.collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)
    winners = {}
    for target, t_index, _, _ in rows:
        best = []
        for month, index, _, policy in rows:
            if policy is None or not 1 <= t_index - index <= 6:
                continue
            hits = [v for (p, _, k), v in want.items() if p == policy and k == t_index - index] or [None]
            best += [((0, -round(abs(v), 9)) if v is not None else (1, 0), month, policy) for v in hits]
        if best:
            winners[target] = min(best)[1:]
    candidates = effects.join_lag_effect(df, effects.policy_effect(df))
    got = {r.target_month: (r.month, r.policy) for r in effects.effect_winner(candidates).collect()}
    assert got == winners


def test_as_of_never_looks_past_the_target(spark):
    _, df = _labelled(spark, 4)
    found = effects.join_lag_effect(df, effects.policy_effect(df), as_of=True).where("start_month is not null")
    index = dict(MONTHS)
    assert all(index[r.start_month] + r.lag <= index[r.target_month] for r in found.collect())


def test_asof_policy(spark):
    rows = [("m1", 1, None), ("m2", 2, 3), ("m3", 3, None), ("m4", 4, 1)]
    df = spark.createDataFrame(rows, "month string, month_idx int, policy int")
    assert [r.policy for r in effects.asof_policy(df).orderBy("month").collect()] == [None, 3, 3, 1]


def test_policy_types(spark):
    values = {1: [1, 2, 3, 7, 10, 20], 2: [0, 0, 0, 0, 0, 0], 3: [20, 10, 7, 3, 2, 1], 4: [5, 5, 5, 5, 5, 25]}
    rows = [(f"20200{m + 1}", p, v) for p, vs in values.items() for m, v in enumerate(vs)]
    counts = spark.createDataFrame(rows, "month string, policy int, cnt long")
    medians = {r.policy: r.median for r in monthly.policy_median(counts).collect()}
    approx = {r.policy: r.median for r in monthly.policy_median(counts, approx=True).collect()}
    assert (medians[1], approx[1]) == (5.0, 3)
    assert {r.policy: r.threshold for r in monthly.topn_threshold(counts).collect()} == {1: 2, 2: 0, 3: 2, 4: 5}
    plain = {r.month: r.policy_type for r in monthly.assign_policy_type(counts).collect()}
    assert plain == {"202001": 3, "202002": 3, "202003": 3, "202004": 1, "202005": 1, "202006": 4}
    merged = {r.month: r.policy_type for r in monthly.assign_policy_type(counts, merge=monthly.MERGE_3_4).collect()}
    assert merged["202006"] == 3
    assert {r.month: r.policy for r in monthly.month_argmax(counts.where("policy = 2")).collect()}["202001"] == 2


def test_argmax_of_zeros_and_ties_is_the_lowest_policy(spark):
    counts = spark.createDataFrame([("m", 2, 0), ("m", 1, 0), ("n", 3, 4), ("n", 2, 4)], "month string, policy int, cnt long")
    assert {r.month: r.policy for r in monthly.month_argmax(counts).collect()} == {"m": 1, "n": 2}


def test_threshold_counts_duplicates(spark):
    counts = spark.createDataFrame([(f"m{i}", 1, v) for i, v in enumerate([9, 9, 9, 8, 8, 1])], "month string, policy int, cnt long")
    assert monthly.topn_threshold(counts, 5).first().threshold == 8
    assert monthly.topn_threshold(counts.where("cnt = 9"), 5).first().threshold == 9


def test_trace_meets_repeated_ids_once(spark):
    months = [f"2020{m:02d}" for m in range(1, 13)]
    trade_rows = [(m, 1000.0 * (1 + (i * 7) % 5), 10.0) for i, m in enumerate(months) for _ in range(3)]
    trades = spark.createDataFrame(trade_rows, "month string, amount double, area double")
    rows = [(m, f"{i}-{j % 2}", "t", "x " * (i % 4 + 1) + ("y " * 3 if i % 3 == 0 else "")) for i, m in enumerate(months) for j in range(3)]
    art = spark.createDataFrame(rows, "month string, article_id string, title string, content_text string")
    for name in ("section_id", "sub_section_id", "newspaper_id", "newspaper_name", "journalist_name", "created_at", "updated_at", "content_origin"):
        art = art.withColumn(name, F.lit("n"))
    traced = jobs.trace_articles(trades, art, {1: ["x"], 2: ["y"]}).collect()
    assert traced
    per_target = {}
    for r in traced:
        per_target.setdefault(r.target_month, []).append((r.month, r.article_id))
    copies = {(m, a): sum(1 for x in rows if x[:2] == (m, a)) for m, a, *_ in rows}
    for found in per_target.values():
        assert all(found.count(key) == copies[key] for key in found)
    one = jobs.trace_articles(trades, art, {1: ["x"], 2: ["y"]}, target_month=traced[0].target_month)
    assert {r.target_month for r in one.collect()} == {traced[0].target_month}


def test_levels_keep_null_regions_apart(spark):
    rows = [(r, d, m, 100.0 + 10 * i, 1.0) for i, (r, d, m) in enumerate([(r, d, m) for r in ("x", None) for d in ("1", None, "2") for m in ("202001", "202003")])]
    trades = spark.createDataFrame(rows, "region string, district string, month string, amount double, area double")
    got = {(r.level, r.region, r.district, r.month): r for r in prices.price_change_by_levels(trades, ["region", "district"]).collect()}
    table = pd.DataFrame(rows, columns=["region", "district", "month", "amount", "area"])
    bounds = table["amount"].quantile([0.01, 0.99])
    kept = table[table["amount"].between(*bounds)].fillna("-")
    want = {}
    for level, names in enumerate([[], ["region"], ["region", "district"]]):
        for key, part in kept.groupby([*names, "month"]):
            shown = [None if x == "-" else x for x in key[:-1]]
            want[(level, *shown, *[None] * (2 - level), key[-1])] = part["amount"].mean()
    assert {k: round(r.avg_unit_price, 6) for k, r in got.items()} == {k: round(v, 6) for k, v in want.items()}
    assert len(got) == len(want) and got[(0, None, None, "202001")].pct_change is None and got[(1, None, None, "202003")].pct_change is not None
