"""Exact Jaccard self-join of shingle sets with set-relation skipping.

Two sets that are similar enough share so many tokens among the first ones of both in any common order, so an index of
these prefixes proposes every link, and a set with fewer listed tokens than that has none. The order is rarest first by a
sketch of fixed size and then by hash; it decides how long the lists get, never what is found. Documents on a list are
compared where they meet (`pieces`), by two relations:

* Index level. A list is ordered by the token's place in its sets and cut into blocks. How far down a set's token stands
  bounds what the set can still share, so blocks behind the last useful place, or of unfit sizes, are skipped whole.
* Answer level. A set's answers are kept with their exact overlaps, down to a similarity that holds whatever a very similar
  set can have among its own. For that set the overlaps are corrected by the tokens in which the two differ; its other
  tokens are not read at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetrace.llm.pieces import IDENTITY, Lists, Shelf, Union, apart, class_table, grouped, identity, labelled, node_texts, piece_links, signed, similar, spread, star_links
from pricetrace.llm.shingles import shingle_sets
from pricetrace.scratch import Staged

#: Counters of the sketch in a row, and tasks whose rows are summed at once.
CHUNK = 1 << 16
TOGETHER = 128
#: Entries in a block of an in-memory list.
BLOCK = 16


@dataclass(frozen=True)
class Join:
    """Links need 100 * intersection >= percent * union of `width`-word shingles.

    Prefixes are longer by `more` per cent of a set than needed to share one token, so that similar sets share as many there.
    A set at `close` or more to one with known answers takes them over. `counters` 32-bit numbers are sent to every task.
    """

    width: int = 4
    percent: int = 85
    more: int = 5
    close: int = 92
    counters: int = 1 << 20

    @property
    def wide(self) -> int:
        """Per cent down to which answers are kept: distances add up, so a close set's links lie within."""
        return self.close + self.percent - 100


def sketch(df: DataFrame, join: Join, text: str) -> np.ndarray:
    """Level of each counter: 0 up to twice the median count of the used ones, one more with every doubling.

    Counters are summed per task, then over at most `TOGETHER` tasks at a time; what reaches the driver has a fixed size.
    """
    schema = "task bigint, chunk int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = np.zeros(join.counters, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                sets = list(shingle_sets(batch.column(0).slice(start, 500), join.width))
                seen += np.bincount((np.concatenate(sets) % np.uint64(join.counters)).astype(np.int64), minlength=join.counters)
        rows = [(TaskContext.get().partitionId(), i, part.tobytes()) for i, part in enumerate(np.split(np.minimum(seen, 65_535).astype(np.uint32), range(CHUNK, join.counters, CHUNK))) if part.any()]
        yield pa.RecordBatch.from_pylist([dict(zip(("task", "chunk", "counts"), row, strict=True)) for row in rows], schema=pa.schema([("task", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())]))

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(one, dtype=np.uint32).astype(np.int64) for one in rows["counts"])
        return pd.DataFrame({"task": rows["task"].iloc[:1] // TOGETHER, "chunk": rows["chunk"].iloc[:1], "counts": [np.minimum(counts, (1 << 32) - 1).astype(np.uint32).tobytes()]})

    parts = Staged(df.select(text).mapInArrow(count, schema), "sketch").df
    while (parts.agg(F.max("task")).head()[0] or 0) > 0:
        parts = Staged(parts.groupBy(F.expr(f"task div {TOGETHER}").alias("_tasks"), "chunk").applyInPandas(total, schema), "sketch").df
    seen = np.zeros(join.counters, dtype=np.int64)
    for row in parts.collect():  # counters / CHUNK rows
        counts = np.frombuffer(row["counts"], dtype=np.uint32)
        seen[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(counts)] = counts
    typical = np.median(seen[seen > 0]) if seen.any() else 1
    return np.ceil(np.log2(np.maximum(seen / (2 * typical), 1))).astype(np.uint8)


def prefix_length(size: int | np.ndarray, percent: int, more: int = 0) -> int | np.ndarray:
    """So many first tokens of a set hold one, or `more` per cent of the set, that any similar set has among its own first ones.

    A set of n tokens shares at least percent * n of them with a similar one, so the last percent * n - k cannot hold all
    but k - 1 of those. Of two sets, the smaller k counts; a similar set has at least percent * n tokens.
    """
    return size - (-(-percent * size // 100)) + np.maximum(1, -(-more * size // 100))


def prefixes(df: DataFrame, join: Join, levels: np.ndarray, key: str, text: str) -> DataFrame:
    """(node, n, s1, s2, tokens) per row: the set's identity and its prefix."""
    schema = "node bigint, n bigint, s1 bigint, s2 bigint, tokens array<bigint>"
    sent = df.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                counts, first, second, tokens, ends = [], [], [], [], [0]
                for hashes in shingle_sets(part.column(1), join.width):
                    for numbers, number in zip((counts, first, second), identity(hashes), strict=True):
                        numbers.append(number)
                    order = np.argsort(levels[(hashes % np.uint64(join.counters)).astype(np.int64)], kind="stable")
                    tokens.append(hashes[order[: prefix_length(len(hashes), join.percent, join.more) if len(hashes) else 0]])
                    ends.append(ends[-1] + len(tokens[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens).view(np.int64)))
                columns = [part.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), signed(first), signed(second), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["node", *IDENTITY, "tokens"])

    return df.select(key, text).mapInArrow(run, schema)


class Index(Lists):
    """Blocked lists of the sets' prefixes: each block with its first place and its smallest and largest set."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        super().__init__(sets)
        self.percent = percent
        size = prefix_length(self.sizes, percent)
        rows = spread(self.begin[:-1], self.begin[:-1] + size)
        owner, place = np.repeat(np.arange(len(sets)), size), spread(np.zeros_like(size), size)
        order = np.lexsort((place, self.token[rows]))
        self.owner, self.place, token = owner[order], place[order], self.token[rows][order]
        start = np.flatnonzero(np.diff(token, prepend=-1))
        inside = np.arange(len(token)) - np.repeat(start, np.diff(np.append(start, len(token))))
        self.cut = np.append(np.flatnonzero(inside % BLOCK == 0), len(token))
        firsts = self.cut[:-1]
        self.block_place = self.place[firsts]
        self.block_least, self.block_most = np.minimum.reduceat(self.sizes[self.owner], firsts), np.maximum.reduceat(self.sizes[self.owner], firsts)
        self.block_token = token[firsts]

    def candidates(self, one: int) -> np.ndarray:
        """Sets that may have `percent` with set `one`: they share a prefix token at places that leave enough to share."""
        n, p = int(self.sizes[one]), self.percent
        tokens = self.tokens(one)[: prefix_length(n, p)]
        low, high = np.searchsorted(self.block_token, tokens), np.searchsorted(self.block_token, tokens, side="right")
        blocks, own = spread(low, high), np.repeat(np.arange(len(tokens)), high - low)
        # A set of m tokens must share p (n + m) / (100 + p); after places i and j at most 1 + min(n - i, m - j) - 1 are left.
        fit = (100 * self.block_most[blocks] >= p * n) & (p * self.block_least[blocks] <= 100 * n)
        fit &= (100 + p) * (self.block_most[blocks] - self.block_place[blocks]) >= p * (n + self.block_most[blocks])
        fit &= (100 + p) * (n - own) >= p * (n + self.block_least[blocks])
        blocks, own = blocks[fit], own[fit]
        starts, ends = self.cut[blocks], self.cut[blocks + 1]
        entries, own = spread(starts, ends), np.repeat(own, ends - starts)
        owner = self.owner[entries]
        m = self.sizes[owner]
        left = np.minimum(n - own, m - self.place[entries])
        return np.unique(owner[((100 + p) * left >= p * (n + m)) & (owner != one)])


def answers(sets: list[np.ndarray], groups: np.ndarray, join: Join) -> list[tuple[int, int]]:
    """Spanning links of one piece. Sets of one group need no link; a piece that has become one group is done."""
    index, union = Index(sets, join.wide), Union(groups)
    sizes = index.sizes
    leader: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for one in np.argsort(sizes, kind="stable"):
        if union.single():
            break
        tokens = index.tokens(one)
        if one in leader:  # the answers of a close set, corrected by the tokens in which the two differ
            other, pool, overlap = leader.pop(one)
            theirs = index.tokens(other)
            gone, new = np.setdiff1d(theirs, tokens, assume_unique=True), np.setdiff1d(tokens, theirs, assume_unique=True)
            shared = overlap - index.counts(gone)[pool] + index.counts(new)[pool]
        else:
            pool = index.candidates(one)
            shared = index.counts(tokens)[pool]
            wide = similar(shared, len(tokens), sizes[pool], join.wide)
            pool, shared = np.append(pool[wide], one), np.append(shared[wide], len(tokens))
            for near in pool[similar(shared, len(tokens), sizes[pool], join.close)]:
                if near != one:
                    leader.setdefault(int(near), (one, pool, shared))
        union.join(one, pool[similar(shared, len(tokens), sizes[pool], join.percent)])
    return union.pairs


def listed(entries: DataFrame) -> DataFrame:
    """The entries (place, node) of tokens that more than one node has in its prefix, with the list's smallest node as `hub`."""
    whole = Window.partitionBy("place")
    found = entries.select("place", "node", F.min("node").over(whole).alias("hub"), F.max("node").over(whole).alias("_last"))
    return found.where("hub <> _last").drop("_last")


def jaccard_components(df: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) per row; `component_id` is the smallest key that links lead to.

    Keys are longs. A text without words has no shingles and no links; a null text has no words. Rows of one key are one
    node, whose links are those of all its texts. Rows with a null key have no links and component null. Links are first
    sought between a class and the first one of the lists it shares most of, then within every list that still holds
    several components; no list is cut short.
    """
    levels = sketch(df, join, text)
    shelf = Shelf()
    table = shelf.put(prefixes(df, join, levels, key, text), "prefixes")
    classes = shelf.put(class_table(table.drop("tokens")), "classes")
    sizes = classes.groupBy("node").agg(F.min("n").alias("least"), F.max("n").alias("n"))
    entries = table.join(classes, ["node", *IDENTITY], "left_semi").select("node", F.explode("tokens").alias("place"))
    first = shelf.put(listed(entries), "lists")

    def sharing(rows: DataFrame) -> DataFrame:
        """The rows (place, node, ...) of nodes that have enough places to share with a similar one."""
        shares = F.col("tokens") * 10_000 >= join.more * join.percent * F.col("least")
        return rows.join(rows.groupBy("node").agg(F.count("*").alias("tokens")).join(sizes, "node").where(shares).select("node"), "node", "left_semi")

    places = shelf.put(listed(sharing(first)), "places")
    texts = shelf.put(node_texts(df, places, key, text), "texts")
    shared = places.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("tokens"))
    stars = shared.groupBy("node").agg(F.max_by("hub", F.struct("tokens", "hub")).alias("hub"))
    links = shelf.put(star_links(stars, texts, join.width, join.percent), "star-links")
    rows = grouped(places.select("place", "node").join(sizes.select("node", "n"), "node"), links, shelf)
    # A node that has a link to another group shares as many places with that group alone.
    rows = apart(sharing(shelf.put(rows.drop("hub"), "apart")))
    more = shelf.put(piece_links(rows, texts, join.width, lambda own, groups: answers(own, groups, join), shelf), "piece-links")
    found = Staged(labelled(table, classes, links.unionByName(more), key), "components").df
    shelf.clear()
    return found
