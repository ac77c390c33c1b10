"""Near-duplicate documents by an LSH forest of MinHash signatures.

Documents with equal shingle sets are one class. A class's signature is read from several starting places, each an order
of the forest: classes that share the first values there are a region, and within a region, sorted by the values that
follow, those with the longest common prefixes stand together, as deep as they agree. A first pass goes along a few orders
and links each class to the likeliest of its neighbours, if their full sets confirm it. The second takes the regions of
all orders that still hold several components and compares them whole, on full sets and where they lie (`pieces`), so that
only links that join components leave a task. Components of the links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrace.llm.pieces import IDENTITY, Lists, Shelf, Union, class_table, grouped, identity, labelled, node_texts, piece_links, signed, similar, star_links
from pricetrace.llm.shingles import mix, shingle_sets
from pricetrace.scratch import Staged


@dataclass(frozen=True)
class Forest:
    """Links need 100 * intersection >= percent * union of `width`-word shingles.

    Two classes with similarity s meet in one of `orders` orders with probability 1 - (1 - s ** depth) ** orders: for
    0.8 that is 0.99997. All classes that meet are compared exactly. The first pass takes `first` orders and looks at
    `region` neighbours at once; it offers a pair if `likely` of the signatures' `sketch` values agree.
    """

    width: int = 5
    percent: int = 80
    orders: int = 20
    depth: int = 4
    first: int = 6
    region: int = 128
    sketch: int = 240
    likely: float = 0.72

    @property
    def values(self) -> int:
        return self.orders * self.depth


def signatures(df: DataFrame, forest: Forest, key: str, text: str) -> DataFrame:
    """(key, n, s1, s2, sig, regions) per row: set size and identity, a byte per value, a hash per order's first values."""
    rng = np.random.Generator(np.random.PCG64(99))
    factors = rng.integers(1 << 63, size=forest.sketch, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salts = rng.integers(1 << 63, size=forest.depth + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    schema = f"{df.select(key).schema[0].simpleString().replace(':', ' ', 1)}, n bigint, s1 bigint, s2 bigint, sig binary, regions array<bigint>"

    def values(hashes: np.ndarray) -> np.ndarray:
        least = np.full(forest.sketch, np.iinfo(np.uint64).max, dtype=np.uint64)
        for start in range(0, len(hashes), 1024):
            np.minimum(least, (hashes[start : start + 1024, None] * factors).min(axis=0), out=least)
        return mix(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                counts, first, second, bytes_, regions = [], [], [], [], []
                for hashes in shingle_sets(part.column(1), forest.width):
                    for numbers, number in zip((counts, first, second), identity(hashes), strict=True):
                        numbers.append(number)
                    found = values(hashes)
                    bytes_.append((found >> np.uint64(56)).astype(np.uint8).tobytes())
                    heads = found[: forest.values].reshape(forest.orders, forest.depth) * salts[:-1]
                    regions.append(mix(heads.sum(axis=1, dtype=np.uint64) + np.arange(forest.orders, dtype=np.uint64) * salts[-1]).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * forest.orders), pa.array(np.concatenate(regions)))
                columns = [part.column(0), pa.array(counts, pa.int64()), signed(first), signed(second), pa.array(bytes_, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "s1", "s2", "sig", "regions"])

    return df.select(key, text).mapInArrow(run, schema)


def neighbours(rows: DataFrame, forest: Forest) -> DataFrame:
    """(hub, node): each node's likeliest neighbour, from rows (region, order, node, sig) that are sorted by region and the values after its own.

    Neighbours are the one before and those of its piece of `region` rows; a larger region is gone through in pieces that
    overlap by half, and the ranges that tasks get may cut one. Nothing depends on what is missed here.
    """
    turned = F.concat(F.expr(f"substring(sig, order * {forest.depth} + 1)"), F.expr(f"substring(sig, 1, order * {forest.depth})"))
    ranged = rows.withColumn("turned", turned).repartitionByRange("region", "turned", "node").sortWithinPartitions("region", "turned", "node")

    def nearest(piece: pd.DataFrame) -> pd.DataFrame:
        sigs = np.frombuffer(b"".join(piece["sig"]), dtype=np.uint8).reshape(len(piece), -1)
        agree = (sigs[:, None, :] == sigs[None, :, :]).mean(axis=2)
        np.fill_diagonal(agree, 0)
        nodes, best = piece["node"].to_numpy(), agree.argmax(axis=1)
        found = pd.DataFrame({"node": nodes, "hub": nodes[best], "agree": agree.max(axis=1)})
        return found[found["agree"] >= forest.likely]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cuts = np.flatnonzero(batch["region"].ne(batch["region"].shift()))
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                for c in range(a, max(a + 1, b - forest.region // 2), forest.region // 2) if b - a > 1 else ():
                    yield nearest(batch.iloc[c : min(b, c + forest.region)])

    found = ranged.select("region", "node", "sig").mapInPandas(run, "node bigint, hub bigint, agree double")
    return found.groupBy("node").agg(F.max_by("hub", F.struct("agree", "hub")).alias("hub"))


def region_links(sets: list[np.ndarray], groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join groups, from the exact overlaps of each set outside the largest group with all others."""
    lists, union = Lists(sets), Union(groups)
    largest = np.bincount(union.group).argmax()
    for one in np.flatnonzero(union.group != largest):
        if union.single():
            break
        shared = lists.counts(lists.tokens(one))
        union.join(one, np.flatnonzero(similar(shared, int(lists.sizes[one]), lists.sizes, percent)))
    return union.pairs


def near_duplicates(df: DataFrame, forest: Forest = Forest(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) per row; `component_id` is the smallest key that links lead to.

    Keys are longs. A text without words has no shingles and no links; a null text has no words. Rows of one key are one
    node, whose links are those of all its texts. Rows with a null key have no links, component null, and are kept.
    """
    shelf = Shelf()
    table = shelf.put(signatures(df, forest, key, text).withColumnRenamed(key, "node"), "signatures")
    classes = shelf.put(class_table(table, "sig", "regions"), "classes")
    spots = classes.select("node", "n", F.posexplode("regions").alias("order", "place"))
    shared = spots.groupBy("place").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("place")
    places = shelf.put(spots.join(shared, "place"), "places")
    texts = shelf.put(node_texts(df, places, key, text), "texts")
    firsts = places.where(F.col("order") < forest.first).select("node", "order", F.col("place").alias("region"))
    likeliest = neighbours(firsts.join(classes.select("node", "sig"), "node"), forest).where("hub <> node")
    links = shelf.put(star_links(likeliest, texts, forest.width, forest.percent), "star-links")
    rows = grouped(places.select("place", "node", "n"), links, shelf)
    more = shelf.put(piece_links(rows, texts, forest.width, lambda own, groups: region_links(own, groups, forest.percent), shelf), "piece-links")
    found = Staged(labelled(table.select("node", *IDENTITY), classes, links.unionByName(more), key), "components").df
    shelf.clear()
    return found.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def keep_one(df: DataFrame, forest: Forest = Forest(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `df`, unchanged, that stand for their component: those with its smallest key. Rows of that key all stay."""
    kept = near_duplicates(df, forest, key, text).where("kept").select(key).distinct()
    return df.alias("d").join(kept.alias("k"), F.col(f"d.{key}").eqNullSafe(F.col(f"k.{key}")), "left_semi")
