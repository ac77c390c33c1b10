"""Merkle manifest of a dataset, with a membership proof for every row found by pointer jumping.

The rows of a group, in key order, are the leaves of a binary tree; the groups' roots, in group order, are the leaves of
one more tree. Trees are built block by block: a task hashes the subtree over `BLOCK` neighbouring nodes, and the tops of
the blocks are the next round's leaves. Each node then holds one step, its sibling towards its parent. A self-join of the
nodes with their ancestors doubles the distance a node sees and appends the ancestor's steps to its own; after as many
joins as the depth has binary digits every leaf holds the whole way to the root.

A step is 33 bytes: `l` or `r` (the sibling stands left or right) or `-` (none, the node is hashed alone), then the digest.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrace.scratch import Staged

#: Levels that a task builds at once, and the leaves below one node of the highest of them.
LEVELS = 12
BLOCK = 1 << LEVELS
STEP = 33


def encoded(value: Column) -> Column:
    """`-` for null, else the value's length in UTF-8 bytes, a colon and the value; integers are decimal."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the encoded values, one after the other."""
    return F.sha2(F.concat(*[encoded(value) for value in values]), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's hex digest and its proof lead to."""
    count = (F.length(steps) / STEP).cast("int")

    def up(node: Column, at: Column) -> Column:
        side = F.substring(steps, at * STEP + 1, F.lit(1)).cast("string")
        sibling = F.lower(F.hex(F.substring(steps, at * STEP + 2, F.lit(STEP - 1))))
        pair = F.when(side == "l", F.concat(sibling, node)).when(side == "r", F.concat(node, sibling)).otherwise(node)
        return F.sha2(pair, 256)

    return F.when(count > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), leaf, up)).otherwise(leaf)


def siblings(steps: Column) -> Column:
    """The proof's digests in hex, concatenated from the leaf to the root; levels without a sibling add nothing."""
    return F.regexp_replace(F.lower(F.hex(steps)), "2d0{64}|(?:6c|72)([0-9a-f]{64})", "$1")


@dataclass(frozen=True)
class Forest:
    """Numbered leaves (tree, pos, n, node, *payload) and the trees built over them."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame


def numbered(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """`rows` with `pos`, a gapless number from 0 inside each `tree` in the given order, and `n`, the tree's rows.

    Ranges of the whole order are numbered apart and shifted by the sizes of the ranges before them, so no tree needs to
    fit a task. `order` starts with the tree and should tell all rows apart.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = Staged(ranged, "leaf-ranges").df
    sizes = parts.groupBy("_part", tree).agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", tree, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"), F.sum("_rows").over(whole).alias("n"))
    local = parts.withColumn("_row", F.row_number().over(Window.partitionBy("_part", tree).orderBy(*order)) - 1)
    placed = local.join(offsets, ["_part", tree])
    return placed.withColumn("pos", F.col("_row") + F.col("_offset")).drop("_part", "_row", "_offset")


def depth_of(n: int) -> int:
    return (n - 1).bit_length()


def subtree(block: pd.DataFrame) -> pd.DataFrame:
    """All nodes above the neighbouring nodes of one block, up to `LEVELS` levels or the tree's root.

    A node with a parent here carries its step; the topmost one carries none and is the next round's leaf, or the root.
    """
    block = block.sort_values("pos")
    tree, n, base = block["tree"].iloc[0], int(block["n"].iloc[0]), int(block["level"].iloc[0])
    first, row = int(block["pos"].iloc[0]), block["node"].tolist()
    levels, out = min(LEVELS, depth_of(n) - base), []
    for level in range(base, base + levels):
        above = []
        for at in range(0, len(row), 2):
            pair = row[at : at + 2]
            if len(pair) == 2:
                out.append((tree, level, first + at, n, pair[0], b"r" + bytes.fromhex(pair[1])))
                out.append((tree, level, first + at + 1, n, pair[1], b"l" + bytes.fromhex(pair[0])))
            else:
                out.append((tree, level, first + at, n, pair[0], b"-" + bytes(STEP - 1)))
            above.append(hashlib.sha256("".join(pair).encode()).hexdigest())
        first, row = first // 2, above
    out.append((tree, base + levels, first, n, row[0], None))
    return pd.DataFrame(out, columns=["tree", "level", "pos", "n", "node", "steps"])


NODES = "tree string, level int, pos bigint, n bigint, node string, steps binary"


def build(leaves: DataFrame) -> Forest:
    """The trees over `leaves` (tree, pos, n, node, ...): every node with its step, and each tree's root in `tops`."""
    level = leaves.select("tree", F.lit(0).alias("level"), "pos", "n", "node")
    rounds: list[DataFrame] = []
    while True:
        block = F.floor(F.col("pos") / BLOCK).alias("_block")
        built = Staged(level.groupBy("tree", block).applyInPandas(subtree, NODES), "subtrees").df
        rounds.append(built)
        tops = built.where("steps IS NULL")
        unfinished = tops.where(F.pow(F.lit(2.0), F.col("level")) < F.col("n"))
        if unfinished.isEmpty():
            break
        level = unfinished.drop("steps")
    nodes, roots = rounds[0].where("steps IS NOT NULL"), []
    for built in rounds:
        roots.append(built.where("steps IS NULL").where(F.pow(F.lit(2.0), F.col("level")) >= F.col("n")))
    for built in rounds[1:]:
        nodes = nodes.unionByName(built.where("steps IS NOT NULL"))
    tops = roots[0]
    for more in roots[1:]:
        tops = tops.unionByName(more)
    return Forest(leaves, nodes, tops.select("tree", "n", F.col("node").alias("top")))


def jump(forest: Forest, payload: list[str]) -> DataFrame:
    """(tree, pos, n, node, *payload, steps): every leaf with its whole way to its tree's root.

    After the join at distance d a node sees 2 d levels, so only nodes at every (2 d)-th level are still needed. Of a
    distance above `LEVELS`, an ancestor is laid out once per block of its leaves, so that no join key is hot.
    """
    deepest = forest.tops.agg(F.max("n")).head()[0] or 0
    inner = forest.nodes.where("level > 0").select("tree", "level", "pos", "n", "steps")
    own = forest.nodes.where("level = 0").select("tree", "pos", "steps")
    leaves = forest.leaves.select("tree", "pos", "n", "node", *payload).join(own, ["tree", "pos"], "left")
    leaves = leaves.withColumn("steps", F.coalesce("steps", F.lit(b"")))
    distance = 1
    while distance < depth_of(deepest):
        blocks = 1 << max(0, distance - LEVELS)
        seen = inner.where(F.col("level") % distance == 0)
        upper = seen.select(
            "tree", F.col("level").alias("_level"), F.col("pos").alias("_pos"), F.col("steps").alias("_more"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"),
        )

        def longer(nodes: DataFrame, level: Column, reach: int = distance, upper: DataFrame = upper, blocks: int = blocks) -> DataFrame:
            aimed = nodes.withColumn("_level", level + reach).withColumn("_pos", F.shiftright("pos", reach))
            aimed = aimed.withColumn("_block", F.shiftright("pos", LEVELS) % blocks)
            joined = aimed.join(upper, ["tree", "_level", "_pos", "_block"], "left")
            steps = F.concat("steps", F.coalesce("_more", F.lit(b"")))
            return joined.withColumn("steps", steps).drop("_level", "_pos", "_block", "_more")

        leaves = Staged(longer(leaves, F.lit(0)), "jumped").df
        distance *= 2
        if distance < depth_of(deepest):
            inner = Staged(longer(inner.where(F.col("level") % distance == 0), F.col("level")), "jumped-nodes").df
    return leaves


def proofs(df: DataFrame, leaf: str, group: str, key: str, payload: list[str]) -> DataFrame:
    """(*payload, leaf, subroot, root, steps) per row of `df`; `leaf` is a column of hex digests.

    Leaves ascend by key inside their group (null first), then by digest; groups ascend bytewise, null first. Rows that
    repeat are leaves of their own, in any order among themselves. An empty table has no rows and no root. Other columns
    are left out, whatever their names.
    """
    named = F.when(F.col(group).isNull(), "!").otherwise(F.concat(F.lit("+"), F.col(group)))
    kept = F.struct(*[F.col(name).alias(f"c{i}") for i, name in enumerate(payload)])
    rows = df.select(named.alias("tree"), F.col(key).alias("_key"), F.col(leaf).alias("node"), kept.alias("_kept"))
    rows = Staged(rows.withColumn("_tie", F.monotonically_increasing_id()), "leaves").df
    placed = Staged(numbered(rows, "tree", [F.col(name) for name in ("tree", "_key", "node", "_tie")]), "numbered").df
    forest = build(placed)
    jumped = jump(forest, ["_kept"])
    tops = Staged(forest.tops, "tops").df
    above = tops.select(F.lit("").alias("tree"), F.col("tree").alias("_tree"), F.col("n").alias("_n"), F.col("top").alias("node"))
    high = build(Staged(numbered(above, "tree", [F.col("tree"), F.col("_tree")]), "groups").df)
    over = jump(high, ["_tree", "_n"]).join(high.tops.select("tree", F.col("top").alias("root")), "tree")
    over = over.select(
        F.col("_tree").alias("tree"), F.col("node").alias("subroot"), "root", F.col("steps").alias("_over"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("_n") - 1, LEVELS))).alias("_block"),
    )
    joined = jumped.withColumn("_block", F.shiftright("pos", LEVELS)).join(over, ["tree", "_block"])
    return joined.select(
        *[F.col(f"_kept.c{i}").alias(name) for i, name in enumerate(payload)],
        F.col("node").alias("leaf"), "subroot", "root", F.concat("steps", "_over").alias("steps"),
    )
