import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from pricetrace.llm import neighbours, pii, toxicity
from pricetrace.llm.queries import QUERIES, documents

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in QUERIES["op9_toxicity"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()
    assert len(got) == documents(spark, SF).count()
    for key, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(key).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.5)
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.9
    assert sum(p and t for p, t in held) >= 0.6 * sum(t for _, t in held)


def test_offending_sentences_are_found(spark, odd, none):
    rng = random.Random(3)
    calm = ["the cat sat here", "we walk to town", "rain fell on the hill", "bread and milk today"]
    rows, labels = [], []
    for key in range(400):
        parts = [rng.choice(calm) for _ in range(4)]
        if bad := key % 4 == 0:
            parts.insert(rng.randrange(5), "you utter nitwit")
        rows.append((key, ". ".join(parts) + "."))
        labels.append((key, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels + [(9999, 1), (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_model(docs, known)
    for r in toxicity.score(docs, model).collect():
        text = rows[r["doc_id"]][1]
        assert (r["score"] >= 0.5) == (r["doc_id"] % 4 == 0)
        assert [text[s["start"] : s["end"]].strip() for s in r["offending"]] == ["you utter nitwit"] * (r["doc_id"] % 4 == 0)
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == 12 and all(r["score"] == 0 for r in scored if r["doc_id"] in (3, 4, 5))
    assert toxicity.keep_harmless(odd, model).columns == odd.columns and toxicity.keep_harmless(odd, model).count() == 12
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit_model(docs, known.limit(0)).weights == {}


def _labelled(documents, words, seed):
    """Texts of sentences over a vocabulary of 3,000 words; one in eight is toxic and names a bad word."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(3_000)]
    rows = []
    for n in range(documents):
        parts = rng.choices(vocabulary, k=words)
        if n % 8 == 0:
            parts[rng.randrange(words)] = "nitwit"
        rows.append((" ".join(w + "." * (rng.random() < 0.1) for w in parts), int(n % 8 == 0)))
    return [*rows, ("", 0), (" \n", 1), ("one", 0)]


def plain_fit(rows, fit):
    """The fit with every feature of every word in lists and one sum over all of them."""
    bags = [[words for _, _, words in toxicity.sentences(text)] for text, _ in rows]
    truth = np.array([label for _, label in rows])
    seen = (Counter(), Counter())
    for bag, label in zip(bags, truth, strict=True):
        seen[label].update({f for words in bag for w in words for f in toxicity.features(w)})
    share = {f: (seen[1][f] / truth.sum(), seen[0][f] / (1 - truth).sum()) for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= fit.least_documents}
    chosen = sorted(share, key=lambda f: (-((share[f][0] - share[f][1]) ** 2 / sum(share[f])), f))[: fit.features]
    number = {f: i for i, f in enumerate(chosen)}
    lines = [[number[f] for w in words for f in toxicity.features(w) if f in number] for bag in bags for words in bag]
    rows, columns = np.repeat(np.arange(len(lines)), [len(x) for x in lines]), np.concatenate(lines).astype(int)
    of, size = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags]), len(chosen)
    value, mean, spread = np.append(np.zeros(size), -4.0), np.zeros(size + 1), np.zeros(size + 1)
    for turn in range(1, fit.rounds + 1):
        z = np.clip(value[-1] + np.bincount(rows, value[columns], len(lines)), -30, 30)
        none = np.bincount(of, np.log1p(np.exp(z)), len(bags))
        pull = -1 / np.maximum(np.expm1(np.clip(none, 1e-9, 50)), 1e-9)
        slope = 1 / (1 + np.exp(-z)) * np.where(truth[of] == 1, pull[of], 1) / len(bags)
        gradient = np.append(np.bincount(columns, slope[rows], size), slope.sum())
        gradient[:-1] += fit.penalty * value[:-1]
        mean, spread = 0.9 * mean + 0.1 * gradient, 0.99 * spread + 0.01 * gradient**2
        value -= 0.1 * (mean / (1 - 0.9**turn)) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
    return dict(zip(chosen, value)), value[-1]


def test_fit_equals_a_plain_one(monkeypatch):
    rows, fit = _labelled(300, 60, 1), toxicity.Fit(features=700, rounds=40)
    weights, bias = plain_fit(rows, fit)
    for block, hashes in ((toxicity.BLOCK, toxicity.HASHES), (500, 1 << 10), (1, 1)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        monkeypatch.setattr(toxicity, "HASHES", hashes)
        model = toxicity.train(iter(rows[:40] if block == 1 else rows), fit)
        if block == 1:
            weights, bias = plain_fit(rows[:40], fit)
        assert model.weights.keys() == {f for f, w in weights.items() if abs(w) > 1e-3} and np.isclose(model.bias, bias)
        assert np.allclose([model.weights[f] for f in model.weights], [weights[f] for f in model.weights], rtol=1e-6)
    assert toxicity.train(iter([("", 0), (" ", 1), ("", 0)])).weights == {}


def test_fit_keeps_little_of_its_texts():
    """What the fit holds grows with the text by a few bytes a character, not by a list of eight-byte numbers per feature."""
    held = []
    for documents in (100, 400):
        rows = [*_labelled(documents, 1_000, 2)]
        tracemalloc.start()
        toxicity.train(rows, toxicity.Fit(rounds=2))
        held.append((sum(len(text) for text, _ in rows), tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    (small, less), (large, more) = held
    assert (more - less) / (large - small) < 10


def test_noisy_or_scores():
    scorer = toxicity.Scorer(toxicity.Model({"<bad>": 3.0}, -2.0))
    score, parts = scorer.read("Bad! fine. bad bad\nok")
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    want = [sigmoid(1), sigmoid(-2), sigmoid(4), sigmoid(-2)]
    assert np.allclose([p for _, _, p in parts], want) and np.isclose(score, 1 - np.prod([1 - p for p in want]))


def replaced(spark, rows, secret="k"):
    table = spark.createDataFrame(rows, "doc_id bigint, text string, n_replaced int")
    return {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.replace_pii(table, secret).collect()}


def test_surrogates_keep_format_gender_and_script(spark):
    rows = [
        (1, "to a.b1@mail6.example.com and A.B1@MAIL6.EXAMPLE.COM, not a@b", 0),
        (2, "+1 (743) 555-3824, 743-555-3824 or (743) 555-3824", 0),
        (3, "4539578763621486 and 4539-5787-6362-1486 but 1234567812345678", 0),
        (4, "at 10.2.3.4, 10.2.3.4 or 1.2.3.400 or 1.2.3.4.5", 0),
        (5, "Mr. Miller, James Miller; Mary Jones. Сергей Иванов, Ольга Иванов", 0),
        (6, "nothing here: James, 12345 and 2024-01-01", 0), (7, None, 0), (8, "", 0),
    ]
    got = replaced(spark, rows)
    assert [got[i][1] for i in range(1, 9)] == [2, 3, 2, 2, 5, 0, 0, 0]
    low, high = re.fullmatch(r"to (\S+@\S+\.com) and (\S+@\S+\.COM), not a@b", got[1][0]).groups()
    assert low.upper() == high and low != "a.b1@mail6.example.com" and re.fullmatch(r"[a-z]\.[a-z]\d@[a-z]{4}\d\.[a-z]{7}\.com", low)
    numbers = re.fullmatch(r"\+1 \((\d{3})\) (\d{3})-(\d{4}), (\d{3})-(\d{3})-(\d{4}) or \((\d{3})\) (\d{3})-(\d{4})", got[2][0]).groups()
    assert numbers[:3] == numbers[3:6] == numbers[6:] != ("743", "555", "3824")
    first, second, plain = re.fullmatch(r"(\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4}) but (\d{16})", got[3][0]).groups()
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(first[::-1]))
    assert first == second.replace("-", "") and first[0] == "4" and first != "4539578763621486" and total % 10 == 0 and plain == "1234567812345678"
    a, b = re.fullmatch(r"at (\S+), (\S+) or 1\.2\.3\.400 or 1\.2\.3\.4\.5", got[4][0]).groups()
    assert a == b != "10.2.3.4" and all(0 < int(x) < 255 for x in a.split("."))
    m = re.fullmatch(r"Mr\. (\w+), (\w+) (\w+); (\w+) (\w+)\. (\w+) (\w+), (\w+) (\w+)", got[5][0]).groups()
    assert m[0] == m[2] != "Miller" and m[1] in pii.GIVEN["latin", "m"] and m[3] in pii.GIVEN["latin", "f"] and m[4] not in (m[2], "Jones")
    assert m[5] in pii.GIVEN["cyrillic", "m"] and m[7] in pii.GIVEN["cyrillic", "f"] and m[6] == m[8] and re.fullmatch("[А-я]+", m[6])
    assert (got[6][0], got[7][0], got[8][0]) == (rows[5][1], None, "")
    assert replaced(spark, rows) == got and replaced(spark, rows, "other")[2] != got[2]


def test_surrogates_stay_distinct_where_forms_are_few(spark):
    rows = [(i, f"{chr(97 + i % 26)}{i // 26}@x.io", 0) for i in range(150)]
    got = replaced(spark, rows)
    new = [got[i][0] for i in range(150)]
    assert len(set(new)) == 150 and not set(new) & {text for _, text, _ in rows}


def test_surrogates_of_odd_rows(odd, none):
    out = pii.replace_pii(odd, "k")
    assert out.columns == [*odd.columns, "n_replaced"] and out.count() == 12 and pii.replace_pii(none, "k").count() == 0


def brute_neighbours(ids, vectors, k=20):
    X = np.array(vectors, dtype=float)
    for key, query in zip(ids, X):
        if key % 20 == 0:
            scores = (X * query).sum(axis=1)
            order = [i for i in np.lexsort((ids, -scores)) if ids[i] != key][:k]
            yield key, [(ids[i], scores[i]) for i in order]


def test_neighbours_recall_and_scores(spark):
    got = {}
    for r in QUERIES["op7_nearest_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in rows])
    exact = dict(brute_neighbours(ids, [r["embedding"] for r in rows]))
    assert got.keys() == exact.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) for q in exact)
    assert hits >= 0.9 * 20 * len(exact)
    truth = {(q, i): s for q in exact for i, s in exact[q]}
    assert all(len(v) == 20 and v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())
    assert all(truth[q, i] == s for q in got for i, s in got[q] if (q, i) in truth)


def test_neighbours_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    same = rng.standard_normal(6).astype("float32").tolist()
    rows = [(i, same) for i in range(200, 290)] + [(i, rng.standard_normal(6).astype("float32").tolist()) for i in range(1, 120)]
    rows += [(20, same), (300, None), (320, []), (340, [0.0] * 6), (360, [None] + same[1:]), (380, [float("nan")] * 6), (400, [float("inf")] + same[1:]), (420, [1.0, 2.0]), (None, same)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    small = neighbours.Search(block_rows=50, leaf=8)
    got = {}
    for r in neighbours.nearest_neighbours(table, table.where("vec_id % 20 = 0"), small).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = [(i, v) for i, v in rows if i is not None and i < 300]
    exact = {}
    for q, found in brute_neighbours(np.array([i for i, _ in good]), [v for _, v in good]):
        exact.setdefault(q, found)
    assert got.keys() == exact.keys() and all(got[q] == exact[q] for q in (200, 220, 240, 40, 60))
    assert neighbours.nearest_neighbours(table.limit(0), table).count() == 0 and neighbours.nearest_neighbours(table, table.limit(0)).count() == 0
    few = table.where("vec_id < 4")
    assert neighbours.nearest_neighbours(few, table.where("vec_id = 40")).count() == 3


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3 and abs(neighbours.chi_square_quantile(0.5, 2) - 1.3863) < 1e-3
