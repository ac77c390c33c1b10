"""Comparing documents by their full shingle sets, piece by piece, with links that only ever join components.

Documents with equal sets are one class. Whatever proposes that classes may be alike, the forest's regions or the lists of
an index, names places; classes that share a place must be compared. A place's hub is its smallest class, and all places
of one hub are one piece: each class is sent there once, with its set, however many places it shares. A piece is compared
by one task, which sends back a spanning forest of its links, fewer rows than it has classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrace.llm.components import connected_components
from pricetrace.llm.shingles import mix, shingle_sets
from pricetrace.scratch import Staged

IDENTITY = ["n", "s1", "s2"]
#: A larger piece is dealt into blocks that meet in twos; both together have about so many classes and shingles at most.
MOST_CLASSES = 2_048
MOST_SHINGLES = 4_000_000
#: Classes compared with their hub in one task.
STAR = 1_024

class Shelf:
    """Staged tables that are discarded together."""

    def __init__(self) -> None:
        self.tables: list[Staged] = []

    def put(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(Staged(df, label))
        return self.tables[-1].df

    def clear(self) -> None:
        for table in self.tables:
            table.discard()


Links = Callable[[list[np.ndarray], np.ndarray], list[tuple[int, int]]]


def identity(hashes: np.ndarray) -> tuple[int, np.uint64, np.uint64]:
    """Size and two 64-bit sums: equal for equal sets, and for different ones only by a chance of 2 ** -128."""
    return len(hashes), hashes.sum(dtype=np.uint64), mix(hashes + np.uint64(77)).sum(dtype=np.uint64)


def signed(numbers: list) -> pa.Array:
    return pa.array(np.array(numbers, dtype=np.uint64).view(np.int64))


def class_table(table: DataFrame, *more: str) -> DataFrame:
    """(n, s1, s2, node, *more) per class of `table` (node, n, s1, s2, *more): its smallest node."""
    usable = table.where("n > 0 AND node IS NOT NULL")
    return usable.groupBy(*IDENTITY).agg(F.min(F.struct("node", *more)).alias("c")).select(*IDENTITY, "c.*")


def node_texts(df: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(node, texts) of the given nodes: the distinct texts of their key. Texts are smaller than their sets of hashes."""
    docs = df.select(F.col(key).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return docs.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_set("_text").alias("texts"))


def similar(shared: int | np.ndarray, x: int, y: int | np.ndarray, percent: int) -> bool | np.ndarray:
    return (shared > 0) & (100 * shared >= percent * (x + y - shared))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by the keys."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(key).to_numpy(zero_copy_only=False) for key in keys]
        changed = np.zeros(batch.num_rows - 1, dtype=bool)
        for column in columns:
            changed |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        if kept and any(kept[-1].column(key)[-1] != batch.column(key)[0] for key in keys):
            yield pa.Table.from_batches(kept)
            kept = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            kept.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(kept)
                kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def sets_of(table: pa.Table, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The shingle sets of all texts in a piece, and the row that each belongs to."""
    texts = table.column("texts").combine_chunks()
    rows = np.repeat(np.arange(len(texts)), texts.value_lengths().to_numpy())
    found = [(row, x) for row, x in zip(rows, shingle_sets(texts.flatten(), width), strict=True) if len(x)]
    return np.array([row for row, _ in found], dtype=np.int64), [x for _, x in found]


def star_links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of `pairs` (hub, node), one per node, whose sets are similar. A hub's texts meet its nodes `STAR` at a time."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    centres = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"))
    around = pairs.join(sizes, "hub").select("hub", F.expr("CAST(pmod(xxhash64(node), parts) AS INT)").alias("part"), "node")
    rows = centres.unionByName(around).join(texts, "node").repartition("hub", "part").sortWithinPartitions("hub", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for star in runs(batches, ["hub", "part"]):
            hub, nodes = star.column("hub")[0].as_py(), star.column("node").to_numpy()
            rows, sets = sets_of(star, width)
            centre = [x for row, x in zip(rows, sets, strict=True) if nodes[row] == hub]
            near = {
                int(nodes[row]) for row, x in zip(rows, sets, strict=True) if nodes[row] != hub
                and any(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent) for y in centre)
            }
            yield pa.RecordBatch.from_arrays([pa.array([hub] * len(near), pa.int64()), pa.array(list(near), pa.int64())], names=["a", "b"])

    return rows.select("hub", "part", "node", "texts").mapInArrow(run, "a bigint, b bigint")


def grouped(places: DataFrame, links: DataFrame, shelf: Shelf) -> DataFrame:
    """`places` (place, node, n) with the place's hub and `group`, the node's component by `links`; places of one group are left out."""
    known = connected_components(links)
    rows = shelf.put(places.join(known, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component"), "grouped")
    return apart(rows)


def apart(rows: DataFrame) -> DataFrame:
    """Rows (place, node, n, group) of the places that hold more than one group, with the place's smallest node as `hub`."""
    several = rows.groupBy("place").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.min("node").alias("hub")).where("lo <> hi")
    return rows.join(several.select("place", "hub"), "place")


def piece_links(rows: DataFrame, texts: DataFrame, width: int, links: Links, shelf: Shelf) -> DataFrame:
    """Spanning links (a, b) between the groups of every place, from `rows` (hub, node, n, group).

    `links` gets the sets of a piece and their groups and returns the pairs that join two of them. A piece above
    `MOST_CLASSES` or `MOST_SHINGLES` is dealt into blocks of half as much, and each two blocks meet; no pair of a place
    is left out.
    """
    members = shelf.put(rows.select("hub", "node", "n", "group").distinct(), "members")
    sizes = members.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    blocks = F.when((F.col("m") > MOST_CLASSES) | (F.col("all") > MOST_SHINGLES), F.greatest(F.ceil(F.col("m") * 2 / MOST_CLASSES), F.ceil(F.col("all") * 2 / MOST_SHINGLES)))
    dealt = members.join(sizes.select("hub", F.coalesce(blocks, F.lit(1)).cast("int").alias("blocks")), "hub")
    dealt = dealt.withColumn("side", F.expr("CAST(pmod(xxhash64(node), blocks) AS INT)"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["hub", "low", "high"]
    met = met.select("hub", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "node", "group")
    whole = met.join(texts, "node").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in runs(batches, keys):
            groups = piece.column("group").to_numpy()
            if (groups == groups[0]).all():
                continue
            at, sets = sets_of(piece, width)
            nodes = piece.column("node").to_numpy()[at]
            found = np.array(links(sets, groups[at]), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[found[:, 0]]), pa.array(nodes[found[:, 1]])], names=["a", "b"])

    return whole.select(*keys, "node", "group", "texts").mapInArrow(run, "a bigint, b bigint")


class Lists:
    """Inverted lists over the sets of one piece, tokens numbered rarest first; a token of one set alone has no list."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        tokens, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(tokens), dtype=np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(tokens))
        token = rank[token.reshape(-1)]
        order = np.lexsort((token, owner))
        #: Each set's tokens, rarest first.
        self.token, self.begin = token[order], np.concatenate([[0], np.cumsum(self.sizes)])
        listed = np.argsort(token, kind="stable")
        self.member, self.at = owner[listed], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(tokens)))])

    def tokens(self, one: int) -> np.ndarray:
        return self.token[self.begin[one] : self.begin[one + 1]]

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the given tokens each set holds."""
        return np.bincount(self.member[spread(self.at[tokens], self.at[tokens + 1])], minlength=len(self.sizes))


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one range after the other."""
    sizes = ends - starts
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else sizes
    return np.arange(len(shift)) + shift


class Union:
    """Groups of a piece's sets; `join` takes a set's similar ones and keeps the pairs that join two groups."""

    def __init__(self, groups: np.ndarray):
        self.group = np.unique(groups, return_inverse=True)[1].reshape(-1)
        self.pairs: list[tuple[int, int]] = []

    def single(self) -> bool:
        return bool((self.group == self.group[0]).all())

    def join(self, one: int, near: np.ndarray) -> None:
        for other in near[np.unique(self.group[near], return_index=True)[1]]:
            if self.group[other] != self.group[one]:
                self.group[self.group == self.group[other]] = self.group[one]
                self.pairs.append((one, int(other)))


def labelled(table: DataFrame, classes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, n_shingles, component_id) per row of `table` (node, n, s1, s2) from links between classes.

    `component_id` is the smallest key that links lead to. A text without words has no shingles and no links. Rows of one
    key are one node, whose links are those of all its texts. Rows with a null key have no links and component null.
    """
    members = table.select("node", *IDENTITY).join(classes.select(*IDENTITY, F.col("node").alias("rep")), IDENTITY, "left")
    several = members.where("rep IS NOT NULL").groupBy("node").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("node")
    bridges = members.join(several, "node").where("rep IS NOT NULL").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    found = connected_components(links.unionByName(bridges)).select(F.col("node").alias("rep"), "component")
    own = F.when(F.col("node").isNotNull(), F.coalesce("component", "rep", "node"))
    out = members.join(found, "rep", "left").withColumn("component_id", own)
    return out.select(F.col("node").alias(key), F.col("n").alias("n_shingles"), "component_id")
