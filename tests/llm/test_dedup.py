import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pricetrace.llm import exact_dedup, jaccard_join, near_dedup, pieces, repeats
from pricetrace.llm.components import connected_components
from pricetrace.llm.queries import QUERIES
from pricetrace.llm.shingles import shingle_sets
from pricetrace.scratch import Staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOUR = near_dedup.Forest(width=4)
FOUR_EXACT = jaccard_join.Join()


def shingles(text, width=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def groups(texts, width=4, percent=80):
    sets = {key: shingles(text, width) for key, text in texts.items()}
    parent = {key: key for key in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {key: (len(sets[key]), root(key)) for key in texts}


def family(rng, size, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 200))]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [text for size, edits in ((12, 2), (40, 6), (5, 0), (30, 12), (9, 1)) for text in family(rng, size, edits)]
    texts += ["", "a", "A", "a b", "a b c d", "A b  c\nd", "a b c d e", None]
    table = dict(enumerate(texts))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(list(table.items()), "doc_id bigint, text string"), FOUR).collect()}
    want = groups(table)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = near_dedup.near_duplicates(odd, FOUR).collect()
    by_key = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == 12 and {k: r["component_id"] for k, r in by_key.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 6}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None] and all(r["kept"] for r in rows if r["doc_id"] is None)
    kept = near_dedup.keep_one(odd, FOUR)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 8]
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.keep_one(none).count() == 0


def test_one_key_with_several_texts_is_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, a), (5, b), (3, a), (4, b), (9, "other text of its own")]
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(5, 3), (3, 3), (4, 3), (9, 9)}


def borderline(size, changes, seed=3, words=200):
    """Texts of one family that are all about as similar as two of them with `changes` own words each."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    for _ in range(size):
        copy = list(base)
        for i in rng.sample(range(words), changes):
            copy[i] = f"y{rng.randrange(10**7)}"
        yield " ".join(copy)


def components(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("blocks", [False, True])
def test_families_just_below_the_threshold(spark, monkeypatch, blocks):
    # 200 and 400 documents whose pairs nearly all lie between 0.6 and 0.9: many are compared, few rows are made.
    if blocks:
        monkeypatch.setattr(pieces, "MOST_CLASSES", 64)
    made, whole = [], pieces.piece_links

    def counted(*args):
        links = whole(*args)
        made.append(links.count())
        return links

    monkeypatch.setattr(near_dedup, "piece_links", counted)
    monkeypatch.setattr(jaccard_join, "piece_links", counted)
    for size in (200,) if blocks else (200, 400):
        texts = dict(enumerate(borderline(size, 4)))
        table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
        assert components(near_dedup.near_duplicates(table, FOUR).collect()) == groups(texts)
        assert components(jaccard_join.jaccard_components(table).collect()) == groups(texts, percent=85)
    if not blocks:
        assert all(n < 3 * 400 for n in made)


def test_jaccard_components_equal_brute_force(spark):
    rng = random.Random(12)
    texts = [text for size, edits in ((12, 2), (40, 6), (5, 0), (30, 12), (9, 1), (60, 4)) for text in family(rng, size, edits)]
    texts += [*borderline(60, 3, words=120), "", "a", "A", "a b", "a b c d", "A b  c\nd", "a b c d e", None, " ".join(f"l{i}" for i in range(30_000))]
    texts.append(texts[-1] + " more")
    table = dict(enumerate(texts))
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(table.items()), "doc_id bigint, text string").repartition(5))
    assert components(got.collect()) == groups(table, percent=85)


def test_answers_are_derived_from_close_sets():
    rng = np.random.default_rng(3)
    base = rng.integers(1 << 60, size=400, dtype=np.uint64)
    sets = [base]
    for changes in (2, 8, 8, 30, 31, 32, 33, 60, 90, 5, 7, 40):
        one = base.copy()
        one[rng.choice(400, changes, replace=False)] = rng.integers(1 << 60, size=changes, dtype=np.uint64)
        sets.append(np.sort(one))
    sets += [np.sort(base[:350]), np.sort(base[:339]), np.sort(base[:341]), rng.integers(1 << 60, size=400, dtype=np.uint64)]
    own = [set(x.tolist()) for x in sets]
    near = {(i, j) for i, x in enumerate(own) for j, y in enumerate(own) if i != j and 100 * len(x & y) >= 85 * len(x | y)}
    pairs = jaccard_join.answers(sets, np.arange(len(sets)), jaccard_join.Join())
    assert set(pairs) <= near and len(pairs) < len(sets)
    group = list(range(len(sets)))
    for i, j in near:
        group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    linked = list(range(len(sets)))
    for i, j in pairs:
        linked = [min(linked[i], linked[j]) if g in (linked[i], linked[j]) else g for g in linked]
    assert group == linked
    index = jaccard_join.Index(sets, 77)
    for i, x in enumerate(own):
        wide = {j for j, y in enumerate(own) if i != j and 100 * len(x & y) >= 77 * len(x | y)}
        assert wide <= set(index.candidates(i).tolist())


def test_a_passage_in_every_document_makes_no_piece(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {i: f"{passage} " + " ".join(f"o{i}x{j}" for j in range(300)) for i in range(120)}
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    levels = jaccard_join.sketch(table, FOUR_EXACT, "text")
    rows = jaccard_join.prefixes(table, FOUR_EXACT, levels, "doc_id", "text").collect()
    assert len({t for r in rows for t in r["tokens"]}) == sum(len(r["tokens"]) for r in rows)
    assert components(jaccard_join.jaccard_components(table).collect()) == groups(texts, percent=85)


def test_jaccard_components_of_odd_rows(odd, none):
    rows = jaccard_join.jaccard_components(odd).collect()
    assert len(rows) == 12
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 6}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0} and jaccard_join.jaccard_components(none).count() == 0


def test_shingle_hashes_count_like_sets():
    texts = ["", " ", "a b c d", "a b c", "A B c d e a b c d", "é è x\x0by z", None, "x " * 5000]
    assert [len(s) for s in shingle_sets(pa.array(texts), 4)] == [len(shingles(t)) for t in texts]


def test_components(spark):
    links = [(i, i + 1) for i in range(300)] + [(400, 401), (401, 402), (500, 600), (600, 500), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(301)}, 400: 400, 401: 400, 402: 400, 500: 500, 600: 500}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_heavy_digests(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 500}") for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    frequent = exact_dedup.frequent_values(table, "text", 0.1).collect()
    assert [r["text"] for r in frequent] == ["hot"]
    staged = Staged(exact_dedup.digests(table, columns=("doc_id",)), "d").df
    got = {r["doc_id"]: (r["keep_key"], r["group_size"]) for r in exact_dedup.exact_groups(staged, "doc_id", "_digest", 0.1).collect()}
    members = {}
    for key, text in rows:
        members.setdefault(text, []).append(key)
    assert got == {k: (min(m), len(m)) for m in members.values() for k in m}
    kept = exact_dedup.deduplicate(table, share=0.1)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(m) for m in members.values())


def test_exact_dedup_leaves_clashing_columns_alone(odd):
    before = {tuple(r) for r in odd.collect()}
    kept = [tuple(r) for r in exact_dedup.deduplicate(odd).collect()]
    assert kept and set(kept) <= before


def test_exact_dedup_of_odd_rows(odd, none):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    # 1 stands for its whitespace variants, 3 for the null and empty texts; " \n " becomes one blank.
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 8]
    staged = Staged(exact_dedup.digests(odd, columns=("doc_id",)), "d").df
    rows = exact_dedup.exact_groups(staged, "doc_id", "_digest").collect()
    assert len(rows) == 12 and {(r["keep_key"], r["group_size"]) for r in rows if r["doc_id"] in (1, 2)} == {(1, 4)}
    assert exact_dedup.deduplicate(none).count() == 0


def brute_repeats(texts, depth):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - depth + 1):
            seen[d[i : i + depth]] = seen.get(d[i : i + depth], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - depth + 1):
            if seen[d[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        left = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 9)))
    shared = ["".join(word() for _ in range(n)) for n in (30, 45, 60, 90)]
    texts = ["".join(word() for _ in range(rng.randrange(60))) + rng.choice(shared) + "".join(word() for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += ["a" * 900, "b" * 201, "b" * 200, "c" * 199, "", None, texts[0], "xy" * 300 + shared[0]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    for spec in (repeats.Depth(), repeats.Depth(depth=60, digit=16, block=5)):
        got = {r["doc_id"]: tuple(r)[1:5] for r in repeats.remove_repeats(table, spec).collect()}
        assert [got[i] for i in range(len(texts))] == brute_repeats(texts, spec.depth)


def test_repeats_of_odd_rows_and_long_texts(spark, odd, none, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 10_000)
    rows = repeats.remove_repeats(odd)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows.collect())
    texts = [(r["doc_id"] or 0, r["text"]) for r in odd.collect()]
    want = brute_repeats([t for _, t in texts], 200)
    assert got == sorted((k, *w[:3]) for (k, _), w in zip(texts, want))
    assert repeats.remove_repeats(none).count() == 0


def test_registered_near_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op1_near_dedup"](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert got == groups(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op12_jaccard_join"](spark, sf).collect()}
    assert got == groups(texts, percent=85)
