"""Weighted rendezvous hashing: every record goes to the shard with the highest keyed draw.

The draw of a record for a shard depends on the record's key and the shard's number alone. A new shard
therefore only takes the records for which it wins; no record moves between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrace.scratch import Staged

BITS = 52


def draw(key: Column, purpose: str) -> Column:
    """Uniform number in (0, 1) from a key and a purpose: 52 bits of an MD5, exact in a double."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{purpose}"))
    number = F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("double")
    return (number + 0.5) / float(2**BITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard with the smallest -ln(draw) / weight; ties go to the smaller number.

    A shard's share of the keys is its weight over the sum of weights; all weights must be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    bids = [F.struct((-F.log(draw(key, str(shard))) / float(w)).alias("bid"), F.lit(shard).alias("shard")) for shard, w in enumerate(weights)]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """`df` with its shard. Rows of equal keys, null keys included, share a shard; nothing is shuffled."""
    return df.withColumn(name, rendezvous(F.col(key), weights))


def number_slots(df: DataFrame, group: str, key: str, spread: str, rows_per_bucket: int = 100_000, name: str = "slot") -> DataFrame:
    """`df` with a gapless number from 0 inside each `group`, in the order of a draw from `key` and `spread`.

    A group is cut into buckets by the draw, rows are numbered inside their bucket and shifted by the sizes of
    the buckets before it, so no task holds a group. The number of buckets follows the number of rows. `df` is
    read twice. `spread` should tell apart the rows of a key, which then lie in different buckets, however many they are;
    rows equal in both are numbered in any order. Other columns may have any names.
    """
    buckets = max(1, -(-df.count() // rows_per_bucket))
    both = F.concat_ws("/", F.col(key).cast("string"), F.col(spread).cast("string"))
    packed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_all"), F.col(group).alias("_group"), draw(both, "slot").alias("_draw"))
    cut = packed.withColumn("_bucket", F.floor(F.col("_draw") * buckets).cast("int"))
    sizes = cut.groupBy("_group", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_group", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_group", "_bucket").orderBy("_draw")
    shifted = cut.withColumn("_row", F.row_number().over(inside) - 1).join(offsets, ["_group", "_bucket"])
    return shifted.select(*[F.col("_all")[c].alias(c) for c in df.columns], (F.col("_row") + F.col("_offset")).cast("long").alias(name))


def shard_table(df: DataFrame, key: str, weights: Sequence[float], text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) per row of `df`.

    `size` is the text's UTF-8 bytes (null: none) plus 16; `grown_shard` is the shard if one more of the last
    weight is added. Empty and repeated rows are placed like all others; an empty table stays empty.
    """
    grown = [*weights, weights[-1]]
    narrow = df.select(
        key,
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(assign_shards(narrow, key, weights), key, grown, "grown_shard")
    stored = Staged(placed.withColumn("_id", F.monotonically_increasing_id()), "shards").df
    return number_slots(stored, "shard", key, "_id").drop("_id")


def write_shards(df: DataFrame, key: str, weights: Sequence[float], path: str) -> None:
    """Write `df` as Parquet, one folder `shard=n` per shard; big shards become several files."""
    assign_shards(df, key, weights).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
