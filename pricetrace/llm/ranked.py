"""Ranked lexical search by Block-Max MaxScore over an inverted index in document shards.

A shard holds the documents that a task read one after the other, up to a number of bytes, and one posting list per term,
cut into blocks of `BLOCK` postings. Of each block the last document, the highest term frequency and the shortest document
are kept apart from the packed postings; with the statistics of the whole corpus they bound every score in the block.

A shard is searched for a batch of items. Its lists are ordered by their global bounds; those that together cannot reach
the k-th best score so far are non-essential. Candidates come from the essential lists alone, window by window, and are
looked up in the others, highest bound first: a candidate that its partial score, the maximum of its block and the bounds
of the lists still to come cannot lift into the best k is rejected before that block is unpacked. The heaps of the shards
are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetrace.scratch import Staged

#: Postings in a block, documents in a window, and the most documents of a shard (places in it take 16 bits).
BLOCK = 128
WINDOW = 2048
MOST = 1 << 16
#: A shard is closed at about so many bytes of text; tokens are counted in pieces of about `PIECE_BYTES`.
SHARD_BYTES = 32 << 20
PIECE_BYTES = 2 << 20
#: Lists of one term that share a join key.
SHARDS_A_KEY = 64

#: Stands for a null key where equal scores are put in order.
LAST = (1 << 63) - 1

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Terms are runs of ASCII letters, digits and characters beyond ASCII; all else is a blank, A-Z count as a-z.
FOLD = bytes(byte + 32 if 0x41 <= byte <= 0x5A else byte if byte in _LETTERS else 0x20 for byte in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


@dataclass(frozen=True)
class Scoring:
    """Whole-corpus numbers: documents with a term, and terms with repeats."""

    documents: int
    length: int

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Score of a term before its weight; it grows with `tf` and falls with `n`, so block extremes bound it."""
        m = 50 + (50 * n.astype(np.int64) * self.documents) // self.length
        return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


class _Shard:
    """Documents gathered for one shard and the postings counted so far."""

    def __init__(self) -> None:
        self.keys: list = []
        self.lengths: list[int] = []
        self.bytes = 0
        self.tokens: list[bytes] = []
        self.first = 0
        self.piece_bytes = 0
        self.pieces: list[tuple] = []

    def add(self, key, raw: bytes) -> None:
        found = terms(raw)
        self.keys.append(key)
        self.lengths.append(len(found))
        self.tokens += found
        self.bytes += len(raw)
        self.piece_bytes += len(raw)
        if self.piece_bytes >= PIECE_BYTES:
            self.count()

    def count(self) -> None:
        """(dictionary, code, document, frequency) of the tokens since the last time."""
        if self.tokens:
            encoded = pa.array(self.tokens, pa.binary()).dictionary_encode()
            places = np.repeat(np.arange(self.first, len(self.lengths)), self.lengths[self.first :])
            both, counts = np.unique(encoded.indices.to_numpy().astype(np.int64) * MOST + places, return_counts=True)
            self.pieces.append((encoded.dictionary, both // MOST, both % MOST, counts))
        self.tokens, self.first, self.piece_bytes = [], len(self.lengths), 0

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        self.count()
        lengths = np.array(self.lengths, dtype=np.int64)
        yield _batch([shard], [None], [None], [self.keys], [lengths], [[]] * 5)
        if not self.pieces:
            return
        names = pa.concat_arrays([piece[0] for piece in self.pieces]).dictionary_encode()
        codes, starts = names.indices.to_numpy(), np.cumsum([0] + [len(piece[0]) for piece in self.pieces])
        term = np.concatenate([codes[start + piece[1]] for start, piece in zip(starts, self.pieces, strict=False)]).astype(np.int64)
        place = np.concatenate([piece[2] for piece in self.pieces])
        order = np.argsort(term * MOST + place)
        term, place, tf = term[order], place[order], np.concatenate([piece[3] for piece in self.pieces])[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        size = np.diff(np.append(first, len(term)))
        inside = np.arange(len(term)) - np.repeat(first, size)
        cut = np.flatnonzero(inside % BLOCK == 0)
        ends = np.append(cut[1:], len(term))
        gaps = np.where(inside % BLOCK == 0, place, place - np.concatenate([[0], place[:-1]]))
        lasts, tops, shorts = place[ends - 1], np.maximum.reduceat(tf, cut), np.minimum.reduceat(lengths[place], cut)
        widest, highest = np.maximum.reduceat(gaps, first), np.maximum.reduceat(tf, first)
        at = np.searchsorted(cut, first)
        upto = np.append(at[1:], len(cut))
        strings = names.dictionary.cast(pa.string())
        for start in range(0, len(first), 10_000):
            some = range(start, min(start + 10_000, len(first)))
            blocks = [np.s_[at[i] : upto[i]] for i in some]
            posts = [np.s_[first[i] : first[i] + size[i]] for i in some]
            packed = [
                [lasts[b].astype(np.uint16).tobytes() for b in blocks],
                [tops[b].astype(np.uint32).tobytes() for b in blocks],
                [shorts[b].astype(np.uint32).tobytes() for b in blocks],
                [gaps[p].astype(np.uint8 if widest[i] < 256 else np.uint16).tobytes() for i, p in zip(some, posts, strict=True)],
                [tf[p].astype(np.uint8 if highest[i] < 256 else np.uint32).tobytes() for i, p in zip(some, posts, strict=True)],
            ]
            count = len(some)
            yield _batch([shard] * count, strings.take(pa.array(term[first[start : start + count]])), size[start : start + count], [None] * count, [None] * count, packed)


INDEX = "shard bigint, term string, df int, keys array<bigint>, lengths array<bigint>, lasts binary, tops binary, shorts binary, gaps binary, tfs binary"


def _batch(shard, term, df, keys, lengths, packed) -> pa.RecordBatch:
    binary = [pa.array(column if column else [None] * len(shard), pa.binary()) for column in packed]
    longs = pa.list_(pa.int64())
    arrays = [pa.array(shard, pa.int64()), pa.array(term, pa.string()), pa.array(df, pa.int32()), pa.array(keys, longs), pa.array(lengths, longs), *binary]
    return pa.RecordBatch.from_arrays(arrays, names=[field.split(" ")[0] for field in INDEX.split(", ")])


def build_index(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Posting lists (shard, term, df, ...) of all texts, and a row without a term per shard: its keys and their lengths.

    Keys are longs or null; null, empty and termless texts are documents of length 0; rows of one key are documents of
    their own. Nothing is shuffled: a shard is what one task read in a row. Store the result before searching.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, current = TaskContext.get().partitionId() << 24, _Shard()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                current.add(key, value.as_buffer().to_pybytes() if value.is_valid else b"")
                if current.bytes >= SHARD_BYTES or len(current.keys) == MOST:
                    yield from current.rows(shard)
                    shard, current = shard + 1, _Shard()
        if current.keys:
            yield from current.rows(shard)

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, INDEX)


def corpus_scoring(index: DataFrame) -> Scoring:
    docs = index.where("term IS NULL")
    counted = docs.select(F.size(F.filter("lengths", lambda n: n > 0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("l"))
    found = counted.agg(F.sum("n"), F.sum("l")).head()
    return Scoring(found[0] or 0, found[1] or 0)


class PostingList:
    """One term's list in a shard: block bounds at hand, postings unpacked when a candidate asks for them."""

    def __init__(self, row, lengths: np.ndarray, scoring: Scoring):
        self.weight, self.df = int(row.weight), int(row.df)
        self.lasts = np.frombuffer(row.lasts, dtype=np.uint16).astype(np.int64)
        highest = np.frombuffer(row.tops, dtype=np.uint32)
        self.bounds = self.weight * scoring.impact(highest, np.frombuffer(row.shorts, dtype=np.uint32))
        self.bound = int(self.bounds.max())
        self.gaps = np.frombuffer(row.gaps, dtype=np.uint8 if len(row.gaps) == self.df else np.uint16)
        self.tfs = np.frombuffer(row.tfs, dtype=np.uint8 if len(row.tfs) == self.df else np.uint32)
        self.lengths, self.scoring, self.unpacked = lengths, scoring, {}

    def block(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of one block."""
        if at not in self.unpacked:
            part = np.s_[at * BLOCK : (at + 1) * BLOCK]
            places = np.cumsum(self.gaps[part], dtype=np.int64)
            self.unpacked[at] = places, self.weight * self.scoring.impact(self.tfs[part], self.lengths[places])
        return self.unpacked[at]

    def between(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(int(np.searchsorted(self.lasts, low)), min(len(self.lasts), int(np.searchsorted(self.lasts, high)) + 1)):
            places, scores = self.block(at)
            a, b = np.searchsorted(places, (low, high))
            if a < b:
                yield places[a:b], scores[a:b]


def best(lists: list[PostingList], keys: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(place, score) of the `k` highest scores above 0 in a shard; equal scores by key, smaller ones first."""
    lists = sorted(lists, key=lambda x: x.bound)
    sums = np.cumsum([x.bound for x in lists])
    places, scores, least = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 1
    for low in range(0, len(keys), WINDOW):
        essential = int(np.searchsorted(sums, least))
        if essential == len(lists):
            break
        partial = np.zeros(min(WINDOW, len(keys) - low), dtype=np.int64)
        for one in lists[essential:]:
            for at, gain in one.between(low, low + len(partial)):
                partial[at - low] += gain
        rest = int(sums[essential - 1]) if essential else 0
        found = np.flatnonzero(partial)
        found = found[partial[found] + rest >= least]
        for i in range(essential - 1, -1, -1):
            if not len(found):
                break
            one, rest = lists[i], int(sums[i - 1]) if i else 0
            block = np.searchsorted(one.lasts, found + low)
            there = block < len(one.lasts)
            most = np.where(there, one.bounds[np.minimum(block, len(one.lasts) - 1)], 0)
            stays = partial[found] + most + rest >= least
            found, block, there = found[stays], block[stays], there[stays]
            for at in np.unique(block[there]):
                documents, gain = one.block(int(at))
                asked = found[block == at]
                spot = np.minimum(np.searchsorted(documents, asked + low), len(documents) - 1)
                hit = documents[spot] == asked + low
                partial[asked[hit]] += gain[spot[hit]]
            found = found[partial[found] + rest >= least]
        found = found[partial[found] >= least]
        if len(found):
            places, scores = np.concatenate([places, found + low]), np.concatenate([scores, partial[found]])
            order = np.lexsort((keys[places], -scores))[:k]
            places, scores = places[order], scores[order]
            if len(scores) == k:
                least = int(scores[-1])
    return list(zip(places.tolist(), scores.tolist(), strict=True))


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (item, term); an item is all rows of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(key, term.decode()) for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for term in set(terms((raw or "").encode()))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], names=["item", "term"])

    return items.select(F.col(key).cast("long"), text).mapInArrow(run, "item bigint, term string").distinct()


def search(index: DataFrame, items: DataFrame, k: int = 50, item: str = "item_id", text: str = "text", together: int = 64) -> DataFrame:
    """(item, rank, doc_id, score): each item's `k` highest-scoring documents with a score above 0.

    Equal scores go by ascending key, null last. About `together` items are searched at once in a shard; a list is sent to
    a shard's batch once, whatever the number of its items that hold the term. Items without terms have no rows, rows of
    one item id are one item, and a null item id is one as well; an empty index or item table gives no rows.
    """
    scoring = corpus_scoring(index)
    asked = Staged(item_terms(items, item, text), "item-terms").df
    batches = max(1, -(-asked.select("item").distinct().count() // together))
    salts = 1 + index.where("term IS NULL").count() // SHARDS_A_KEY
    frequency = index.where("term IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * scoring.documents + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight")
    batched = asked.withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(batches)).cast("int"))
    grouped = batched.groupBy("term", "batch").agg(F.collect_list(F.coalesce("item", F.lit(0).cast("long"))).alias("items"), F.max(F.col("item").isNull()).alias("none"))
    weighed = Staged(grouped.join(frequency.select("term", weight), "term"), "weighed-terms").df
    # A term's lists of all shards are dealt over many keys.
    spread = weighed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lists = index.where("term IS NOT NULL").drop("keys", "lengths").withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(salts)).cast("int"))
    lists = lists.join(spread, ["term", "salt"]).drop("salt")
    docs = index.where("term IS NULL").select(
        F.col("shard").alias("of"), "lengths", F.transform("keys", lambda key: F.coalesce(key, F.lit(LAST))).alias("keys"), F.transform("keys", lambda key: key.isNull()).alias("missing"),
        F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"),
    )

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["item", "doc_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame([], columns=columns).astype("Int64")
        lengths = np.asarray(right["lengths"].iloc[0], dtype=np.int64)
        keys, missing = np.asarray(right["keys"].iloc[0], dtype=np.int64), right["missing"].iloc[0]
        of: dict[int | None, list[PostingList]] = {}
        for row in left.itertuples():
            one = PostingList(row, lengths, scoring)
            own = list(row.items)
            if row.none:
                own.remove(0)
                of.setdefault(None, []).append(one)
            for name in own:
                of.setdefault(int(name), []).append(one)
        out = [(name, None if missing[at] else keys[at], score) for name, own in of.items() for at, score in best(own, keys, k)]
        return pd.DataFrame(out, columns=columns).astype("Int64")

    heaps = lists.groupBy("shard", "batch").cogroup(docs.groupBy("of", "batch")).applyInPandas(run, "item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", "doc_id", "score")
