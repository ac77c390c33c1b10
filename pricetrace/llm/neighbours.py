"""Nearest neighbours by inner product through a few stable projections and kd-trees.

Vectors gain one coordinate so that the largest inner product is the smallest distance. A handful of Gaussian projections
of the vectors of a block are indexed by a kd-tree; a query takes the leaves in the order of their boxes' distances, that
is its projected neighbours incrementally, and verifies them on the original vectors. A squared projected distance over
the true one is chi-square distributed, so a query stops once a still unseen vector nearer than its k-th best
would already have shown up with the probability asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetrace.scratch import Staged


@dataclass(frozen=True)
class Search:
    """`certainty` is the chance that a neighbour is seen before a query stops, per neighbour; `projections` must be even."""

    k: int = 20
    projections: int = 8
    leaf: int = 64
    block_rows: int = 10_000
    certainty: float = 0.97
    seed: int = 5


def chi_square_quantile(p: float, freedom: int) -> float:
    """x with P(chi-square <= x) = p for an even number of degrees of freedom, by bisection of the closed form."""

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


class Tree:
    """kd-tree over projected points: a balanced split at the median of the widest side, kept as leaves with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            own = stack.pop()
            if len(own) <= leaf:
                self.leaves.append(own)
                continue
            side = int(np.ptp(points[own], axis=0).argmax())
            middle = len(own) // 2
            order = np.argpartition(points[own, side], middle)
            stack += [own[order[:middle]], own[order[middle:]]]
        self.low = np.array([points[own].min(axis=0) for own in self.leaves])
        self.high = np.array([points[own].max(axis=0) for own in self.leaves])

    def order(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, squared distances of their boxes), nearest first."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        squares = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(squares, kind="stable")
        return order, squares[order]


class Block:
    """Index of some vectors. Equal vectors are one point with its smallest ids, as many as a result can hold besides the query's."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, search: Search):
        self.search = search
        order = np.argsort(ids, kind="stable")
        self.vectors, owner = np.unique(vectors[order], axis=0, return_inverse=True)
        owner = owner.reshape(-1)
        by_point = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[by_point], np.arange(len(self.vectors) + 1))
        self.ids = [ids[order][by_point[a : min(b, a + search.k + 1)]] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.single = self.vectors.astype(np.float32)
        norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.bound = float(norms.max())
        longer = np.column_stack([self.vectors, np.sqrt(np.maximum(self.bound - norms, 0))])
        rng = np.random.Generator(np.random.PCG64(search.seed))
        self.matrix = rng.standard_normal((longer.shape[1], search.projections))
        self.tree = Tree(longer @ self.matrix, search.leaf)
        self.stop = chi_square_quantile(search.certainty, search.projections)

    def best(self, points: np.ndarray, query_id: int, query: np.ndarray) -> list[tuple[float, int]]:
        """(score, id) of the k best ids at some points, scores in double precision."""
        scores = (self.vectors[points] * query).sum(axis=1)
        if len(points) > self.search.k + 1:  # equal scores stay together, one place is for the query's own vector
            edge = np.partition(scores, len(scores) - self.search.k - 1)[len(scores) - self.search.k - 1]
            points, scores = points[scores >= edge], scores[scores >= edge]
        found = [(score, int(i)) for point, score in zip(points.tolist(), scores.tolist(), strict=True) for i in self.ids[point] if i != query_id]
        return sorted(found, key=lambda pair: (-pair[0], pair[1]))[: self.search.k]

    def nearest(self, query_id: int, query: np.ndarray) -> list[tuple[float, int]]:
        """(score, id) of up to k vectors, best first. The query is scaled to the longest vector, which keeps the order.

        While a query has many leaves to go, their vectors are looked at in single precision first, with a margin above
        its error, and only those that may be among the best are scored.
        """
        norm = float(query @ query)
        scale, single = math.sqrt(self.bound / norm), query.astype(np.float32)
        margin = 1e-4 * math.sqrt(self.bound * norm)
        leaves, boxes = self.tree.order(np.append(query * scale, 0.0) @ self.matrix)
        seen, found, at, step = np.array([], dtype=int), [], 0, 4
        while at < len(leaves):
            kth = found[-1][0] if len(found) >= self.search.k else -math.inf
            last = len(leaves)
            if found and kth > -math.inf:
                last = int(np.searchsorted(boxes, self.stop * max(0.0, 2 * self.bound - 2 * scale * kth), side="right"))
            if last <= at:
                break
            if last - at > len(leaves) // 2 and at:  # most of the block: in one go, without picking leaves
                seen, at = np.flatnonzero(self.single @ single >= kth - margin), len(leaves)
            else:
                chosen = leaves[at : min(last, at + step)]
                points = np.concatenate([self.tree.leaves[leaf] for leaf in chosen])
                near = points[self.single[points] @ single >= kth - margin]
                seen, at, step = np.concatenate([seen, near]), at + len(chosen), step * 4
            found = self.best(seen, query_id, query)
        return found


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the vectors that take part: no null, NaN or infinite component, and not all zero."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(F.col(key).alias("id"), parts.alias("vector")).where(F.col("id").isNotNull() & F.col(vector).isNotNull())
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def nearest_neighbours(data: DataFrame, queries: DataFrame, search: Search = Search(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): for each query row the `k` largest inner products among the rows of other ids.

    Query rows of one id share its k places. Vectors of another length than a query's are no candidates for it. Ties go to the smaller id; a row repeated under one id
    may be found as often. Without `k` candidates all are returned, without any the query has no row.
    Every vector is indexed, in blocks of about `block_rows` dealt out evenly; each block sees every query once, as a
    stream, and hands on its best `k`.
    """
    table = Staged(usable(data, key, vector).withColumn("place", F.monotonically_increasing_id()), "vectors").df
    blocks = max(1, -(-table.count() // search.block_rows))
    rows = table.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int"))
    asked = usable(queries, key, vector).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = rows.select("block", F.lit(0).alias("role"), "id", "vector").unionByName(asked.select("block", F.lit(1).alias("role"), "id", "vector"))
    dealt = both.repartition(blocks, "block").sortWithinPartitions("block", "role")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, tuple[list, list]] = {}
        index: dict[int, Block] = {}
        block = None
        for batch in batches:
            out: list[tuple] = []
            for now, part in batch.groupby("block", sort=True):
                if now != block:
                    kept, index, block = {}, {}, now
                for id_, values in part.loc[part["role"] == 0, ["id", "vector"]].itertuples(index=False):
                    ids, vectors = kept.setdefault(len(values), ([], []))
                    ids.append(id_)
                    vectors.append(values)
                for id_, values in part.loc[part["role"] == 1, ["id", "vector"]].itertuples(index=False):
                    if len(values) in kept:
                        ids, vectors = kept.pop(len(values))
                        index[len(values)] = Block(np.array(ids), np.array(vectors, dtype=float), search)
                    if len(values) in index:
                        out += [(id_, i, s) for s, i in index[len(values)].nearest(id_, np.asarray(values, dtype=float))]
            yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    found = dealt.mapInPandas(run, "query_id bigint, id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= search.k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
