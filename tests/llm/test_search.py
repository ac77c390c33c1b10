import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricetrace.llm import manifest, ranked
from pricetrace.llm.queries import ORACLES, QUERIES
from pricetrace.scratch import Staged
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    """{item: [(key, score), ...]} by scoring every document."""
    counts = [(key, len(own), Counter(own)) for key, own in ((key, terms(text)) for key, text in docs)]
    n_docs, length = sum(n > 0 for _, n, _ in counts), sum(n for _, n, _ in counts)
    df = {}
    for _, _, own in counts:
        for term in own:
            df[term] = df.get(term, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = {}
    for item, own in asked.items():
        rows = []
        for key, n, doc in counts:
            score = 0
            for term in own & doc.keys():
                tf = doc[term]
                if tf:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 50 + (50 * n * n_docs) // length
                    score += weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                rows.append((key, score))
        rows.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        if rows:
            out[item] = rows[:k]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_merkle_manifest"])
def test_query_matches_sql(spark, name):
    assert differences(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name]) is None


def test_search_equals_scoring_every_document(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(7000)]
    docs += [(7000, None), (7001, ""), (7002, " .;-"), (None, docs[3][1]), (None, docs[4][1]), (5, docs[5][1]), (5, docs[5][1]), (7003, "É é É-x W1 w1 W1" * 30), (1 << 60, docs[6][1]), ((1 << 60) + 1, docs[6][1])]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for i in range(30)]
    items += [(30, None), (31, "!"), (32, "nowhere"), (0, "w1 w2"), (None, "é w3"), (33, docs[6][1])]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    index = Staged(ranked.build_index(table), "index").df
    got = ranked.search(index, spark.createDataFrame(items, "item_id bigint, text string"), 20, together=7)
    assert found(got.collect()) == plain_search(docs, items, 20)


def test_blocks_that_cannot_win_stay_packed():
    shard = ranked._Shard()
    for i in range(20_000):
        shard.add(i, b"rare " * (i % 997 == 0) + b"common " * (1 + i % 3) + b"x " * (i % 40))
    frames = [batch.to_pandas() for batch in shard.rows(0)]
    lengths = np.array(frames[0]["lengths"][0])
    rows = pd.concat(frames[1:]).assign(weight=[{"rare": 7000, "common": 10}.get(t, 5) for t in pd.concat(frames[1:])["term"]])
    scoring = ranked.Scoring(20_000, int(lengths.sum()))
    lists = {row.term: ranked.PostingList(row, lengths, scoring) for row in rows.itertuples()}
    top = ranked.best(list(lists.values()), np.arange(20_000), 10)
    common = lists["common"]
    assert len(common.lasts) == -(-20_000 // ranked.BLOCK) and len(common.unpacked) < 0.6 * len(common.lasts)
    scores = np.zeros(20_000, dtype=np.int64)
    for one in lists.values():
        for places, gain in one.between(0, 20_000):
            scores[places] += gain
    order = np.lexsort((np.arange(20_000), -scores))[:10]
    assert top == [(int(i), int(scores[i])) for i in order]


def test_search_of_odd_rows(spark, odd, none):
    index = Staged(ranked.build_index(odd), "index").df
    items = odd.select(F.col("doc_id").alias("item_id"), "text", "term", "batch")
    docs, asked = [(r["doc_id"], r["text"]) for r in odd.collect()], [(r["item_id"], r["text"]) for r in items.collect()]
    assert found(ranked.search(index, items, 5).collect()) == plain_search(docs, asked, 5)
    assert ranked.search(index, items.limit(0)).count() == 0
    assert ranked.search(Staged(ranked.build_index(none), "index").df, items).count() == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, siblings of each leaf from below)."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for leaf, place in enumerate(at):
            if (place ^ 1) < len(level):
                ways[leaf].append(level[place ^ 1])
            at[leaf] = place // 2
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], ways


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows):
    """Sorted (key, leaf, subroot, root, digest of the proof)."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, sha(*map(encoded, (row["doc_id"], row["lang"], row["text"])))))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    subs = {lang: tree([leaf for _, _, leaf in sorted(by_lang[lang])]) for lang in langs}
    root, above = tree([subs[lang][0] for lang in langs])
    out = []
    for lang, over in zip(langs, above):
        for (known, key, leaf), way in zip(sorted(by_lang[lang]), subs[lang][1]):
            out.append((known, key, leaf, subs[lang][0], root, sha(*way, *over)))
    return sorted(out)


def manifest_rows(df):
    leaves = df.withColumn("leaf", manifest.digest(F.col("doc_id"), F.col("lang"), F.col("text")))
    proofs = manifest.proofs(leaves, "leaf", "lang", "doc_id", ["doc_id"])
    out = proofs.withColumn("proof", F.sha2(manifest.siblings(F.col("steps")), 256)).withColumn("folded", manifest.fold(F.col("leaf"), F.col("steps"))).collect()
    assert all(r["folded"] == r["root"] for r in out)
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"], r["subroot"], r["root"], r["proof"]) for r in out)


def test_manifest_equals_plain_trees(spark):
    # The largest tree has two blocks and a part of a third one.
    assert manifest.BLOCK == 4096
    rows = [(i, lang, f"t{i}") for lang, n in (("en", 9000), ("é", 33), (None, 5), ("", 1), ("z", 2), ("de", 64)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(4)
    assert manifest_rows(df) == plain_manifest(df.collect())


def test_manifest_of_odd_rows(odd, none):
    df = odd.withColumnRenamed("source", "lang")
    assert manifest_rows(df) == plain_manifest(df.collect())
    assert manifest_rows(none.withColumnRenamed("source", "lang")) == []


def test_a_changed_row_is_found(spark):
    rows = QUERIES["op13_merkle_manifest"](spark, SF).collect()
    docs = {r["doc_id"]: r["n_chars"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and docs[r["doc_id"]] is not None
        assert r["verified"] == (not changed) and (r["folded_root"] == r["root"]) == r["verified"]
    assert 0 < sum(not r["verified"] for r in rows) < len(rows)
