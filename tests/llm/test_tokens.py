import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetrace.llm import mixing, packing, sharding
from pricetrace.llm.queries import QUERIES, documents

SF = "/root/testdata/sf0.001"


def test_ids_are_those_of_the_tokenizers_file(spark):
    vocabulary = packing.default_vocabulary()
    texts = [r["text"] for r in documents(spark, SF).limit(60).collect()]
    texts += ["", " ", "\n\n  \n", "don't  stop<|endoftext|>", "é" * 300, "日本語   x\x00", "a" * 1000, "1234567890 " * 50, "  lead", "trail  "]
    for text in texts:
        want = packing.json_encoder(f"{vocabulary}.json").encode(text, add_special_tokens=False).ids
        assert packing.token_ids(text, vocabulary).tolist() == [*want, 0]


def test_added_tokens_are_one_id():
    from tokenizers import Tokenizer

    vocabulary = packing.default_vocabulary()
    plain = Tokenizer.from_file(f"{vocabulary}.json")
    for text in ("the mark <|endoftext|> ends a text", "<|endoftext|><|endoftext|>", "a<|endoftext|", "<|endoftext|>" + "word " * 110_000):
        assert packing.token_ids(text, vocabulary).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]


def check_packing(rows, texts, window=1024):
    vocabulary = packing.default_vocabulary()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys() and sorted(by_sequence) == list(range(len(by_sequence)))
    for key, pieces in by_doc.items():
        ids, at = packing.token_ids(texts[key] or "", vocabulary), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return sum(r["length"] for r in rows) / (window * len(by_sequence))


def test_packed_query_holds_every_token_once(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF).collect()}
    assert check_packing(QUERIES["op4_pack_windows"](spark, SF).collect(), texts) > 0.95


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd.where("doc_id IS NOT NULL AND doc_id <> 2")).collect()
    check_packing(rows, {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] not in (None, 2)})
    all_rows = packing.pack(odd, with_ids=True)
    assert all_rows.where("doc_id IS NULL OR doc_id = 2").count() == 4 and packing.pack(none).count() == 0
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(all_rows).collect()}
    assert whole == {r["sequence_id"]: r["n"] for r in all_rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}


def test_plans_use_the_histogram_exactly():
    rng = np.random.default_rng(3)
    for counts in (rng.integers(0, 400, 33), np.eye(33, dtype=int)[32] * 9, np.eye(33, dtype=int)[1] * 77, np.zeros(33, dtype=int), np.eye(33, dtype=int)[20] * 50):
        counts = counts.copy()
        counts[0] = 0
        plan = packing.window_plan(counts)
        used = sum((use * times for use, times in plan), np.zeros(33, dtype=int))
        assert (used == counts).all() and all((use * np.arange(33)).sum() <= 32 and times > 0 for use, times in plan)
    x = packing.nnls(np.array([[1.0, 0, 1], [0, 1, 1]]), np.array([3.0, 1.0]))
    assert np.allclose(np.array([[1.0, 0, 1], [0, 1, 1]]) @ x, [3, 1]) and (x >= 0).all()


def test_shards_move_only_into_the_new_one(spark, odd, none):
    rows = QUERIES["op3_rendezvous_shards"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, SF).collect()}
    slots = {}
    for r in rows:
        text = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 16, zlib.crc32(text), "key")
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())

    def bid(key, shard):
        return -math.log((int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)

    for r in rows:
        bids = [bid(r["doc_id"], shard) for shard in range(41)]
        assert bids[r["shard"]] == min(bids[:40]) and bids[r["grown_shard"]] == min(bids)
    odd_rows = sharding.shard_table(odd, "doc_id", [1.0, 2.0]).collect()
    assert len(odd_rows) == 12 and len({r["shard"] for r in odd_rows if r["doc_id"] is None}) == 1
    assert {r["size"] for r in odd_rows if r["doc_id"] in (3, 4)} == {16} and sharding.shard_table(none, "doc_id", [1.0]).count() == 0
    assert "shard" in sharding.assign_shards(odd, "doc_id", [1.0]).columns


def test_slots_of_a_hot_key_are_spread(spark, odd):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id", "1 AS g", "id AS _row", "id AS _offset", "id AS _bucket")
    got = sharding.number_slots(rows, "g", "k", "id", rows_per_bucket=100)
    assert got.columns == [*rows.columns, "slot"]
    found = got.collect()
    assert sorted(r["slot"] for r in found) == list(range(3000)) and all(r["id"] == r["_row"] == r["_offset"] for r in found)
    hot = sorted(r["slot"] for r in found if r["k"] == 7)
    assert hot[0] < 100 and hot[-1] > 2900


def test_shard_weights_are_shares(spark):
    placed = sharding.assign_shards(spark.range(20000), "id", [1.0, 3.0]).groupBy("shard").count()
    assert abs({r["shard"]: r["count"] for r in placed.collect()}[1] / 20000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [1.0, 0.0])


def water_level(sizes, weights):
    target, left, open_ = {}, sum(sizes.values()), set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] < level * weights[s]}
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def sainte_lague(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda v: (-votes[v] / (2 * won[v] + 1), v))
        won[best] += 1
    return won


def test_quotas_are_the_highest_quotients(spark):
    rng = random.Random(1)
    for seats in (0, 1, 3, 40, 1234):
        votes = {i: rng.choice([0.0, 1.0, 5.0, rng.random() * 100]) for i in range(12)} | {12: 7.0}
        rows = [(0, i, v, seats) for i, v in votes.items()]
        table = spark.createDataFrame(rows, "g int, i int, votes double, seats bigint")
        got = {r["i"]: r["quota"] for r in mixing.sainte_lague(table, ["g"], ["i"]).collect()}
        assert got == sainte_lague(votes, seats)


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = []
    for source, docs in (("a", 300), ("b", 30), ("c", 40), ("d", 500), (None, 200)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.randrange(0, 400)), source) for i in range(docs)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix_table(table).collect()}
    size = {key: len(text.split()) for key, text, _ in rows}
    names = ["a", "b", "c", "d", None]
    totals = {s: sum(size[k] for k, _, own in rows if own == s) for s in names}
    want = water_level(totals, dict(zip(names, (1, 2, 3, 1, 2))))
    for s in names:
        own = [got[k] for k, _, source in rows if source == s]
        assert np.isclose(own[0]["target"], want[s]) and own[0]["source_size"] == totals[s]
        assert abs(sum(r["taken"] for r in own) - want[s]) < 0.02 * want[s] + 32
    assert all(r["size"] == size[k] and 0 <= r["taken"] <= 3 * r["size"] for k, r in got.items())
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_table(table.repartition(7)).collect()}
    assert again == {k: r["taken"] for k, r in got.items()}
    words = {}
    for r in mixing.mixed_texts(table).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {k: r["taken"] for k, r in got.items() if r["taken"]}


def test_small_sources_come_near_their_targets(spark):
    rows = []
    for source, docs, words in (("a", 15, 20), ("b", 15, 20), ("c", 400, 50), ("d", 3, 4000), ("e", 1, 7), ("f", 4, 4000), ("g", 60, 3), ("h", 2, 0)):
        rows += [(len(rows) + i, " ".join(f"w{j}" for j in range(words)), source) for i in range(docs)]
    got = mixing.mix_table(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    sums, aims = {}, {}
    for r in got:
        source = rows[r["doc_id"]][2]
        sums[source], aims[source] = sums.get(source, 0) + r["taken"], r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(sums[s] - aims[s]) <= 32 for s in sums), (sums, aims)
    total = sum(len(text.split()) for _, text, _ in rows)
    assert abs(sum(sums.values()) - total) <= 0.01 * total


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix_table(odd).collect()
    assert len(rows) == 12 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    mixed = mixing.mixed_texts(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    texts = {re.sub(r"\s+", " ", r["text"] or "") for r in odd.collect()}
    assert all(any(re.sub(r"\s+", " ", r["text"]).strip()[:20] in t for t in texts) for r in mixed.collect())
    assert mixing.mix_table(none).count() == 0 and mixing.mixed_texts(none).count() == 0
