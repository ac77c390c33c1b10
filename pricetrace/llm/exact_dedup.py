"""Exact duplicates by heavy-hitter split.

Misra-Gries counters find the digests that hold a large share of the rows. Their exact size and first row
are counted and broadcast, so rows of hot groups are settled where they are read. All other digests are
grouped by an ordinary shuffle, in which by then no group is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrace.scratch import Staged

WHITESPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Text with each run of ASCII whitespace as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def misra_gries(values: Iterator[pd.Series], counters: int) -> pd.Series:
    """Misra-Gries summary of a stream: at most `counters` values, each undercounted by at most n / (counters + 1)."""
    summary = pd.Series(dtype="int64")
    for batch in values:
        summary = summary.add(batch.value_counts(), fill_value=0).astype("int64")
        if len(summary) > counters:
            cut = summary.nlargest(counters + 1).iloc[-1]
            summary = summary[summary > cut] - cut
    return summary


def frequent_values(df: DataFrame, column: str, share: float) -> DataFrame:
    """Column `column`: every non-null value that fills at least `share` of the rows, and at most 4 / (3 * share) values.

    Each task keeps 4 / share counters; the summaries are added up. A value with n >= share * rows then counts at
    least 3/4 * share * rows, and the counts of all values together are at most the number of rows.
    """
    counters = int(4 / share)
    schema = T.StructType([df.schema[column], T.StructField("_seen", T.LongType())])

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = misra_gries((batch[column] for batch in batches), counters)
        yield pd.DataFrame({column: found.index, "_seen": found.to_numpy()})

    least = df.count() * 0.75 * share
    seen = df.select(column).mapInPandas(summarise, schema).groupBy(column).agg(F.sum("_seen").alias("_seen"))
    return seen.where(F.col("_seen") >= least).select(column)


def heavy_groups(table: DataFrame, key: str, digest: str, share: float) -> DataFrame:
    """(digest, _keep, _size) of the digests that fill `share` of the rows: smallest key and exact size.

    At most 4 / (3 * share) rows whatever the input, so the result may be broadcast.
    """
    frequent = frequent_values(table, digest, share)
    groups = table.join(F.broadcast(frequent), digest, "left_semi").groupBy(digest)
    return Staged(groups.agg(F.min(key).alias("_keep"), F.count("*").alias("_size")), "heavy-digests").df


def exact_groups(table: DataFrame, key: str, digest: str, share: float = 0.001) -> DataFrame:
    """(key, digest, keep_key, group_size) for every row of `table`; the smallest key of equal digests is kept.

    Rows without a digest are left out. Null keys are kept only where a group has no other; repeated rows each
    count. `table` is read several times, so it should be a stored one.
    """
    heavy = heavy_groups(table, key, digest, share)
    marked = table.select(key, digest).join(F.broadcast(heavy), digest, "left")
    settled = marked.where(F.col("_size").isNotNull()).select(key, digest, "_keep", "_size")
    rest = marked.where(F.col("_size").isNull() & F.col(digest).isNotNull()).select(key, digest)
    groups = rest.groupBy(digest).agg(F.min(key).alias("_keep"), F.count("*").alias("_size"))
    other = rest.join(groups, digest).select(key, digest, "_keep", "_size")
    return settled.unionByName(other).withColumnsRenamed({"_keep": "keep_key", "_size": "group_size"})


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(normalised(F.col(text)), 256))


def digests(df: DataFrame, text: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """`columns` and `_digest`, the SHA-256 of the normalised text as 32 bytes."""
    return df.select(*columns, digest_of(text).alias("_digest"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.001) -> DataFrame:
    """Rows of `df` that stay: of equal normalised texts the row with the smallest key, columns unchanged.

    A null text is an empty one; a null key stays only where its group has no other; of rows that repeat the
    smallest key one stays; an empty table stays empty; columns may have any names. Rows of hot groups that go are removed
    before the shuffle, and each task keeps one row per digest before it, so no group of copies meets in one task.
    """
    rows = df.select(F.struct(*[F.col(name) for name in df.columns]).alias("_all"), F.col(key).alias("_key"), digest_of(text).alias("_digest"))
    heavy = heavy_groups(Staged(rows.select("_key", "_digest"), "digests").df, "_key", "_digest", share)
    marked = rows.join(F.broadcast(heavy), "_digest", "left")
    left = marked.where(F.col("_size").isNull() | F.col("_key").eqNullSafe(F.col("_keep")))
    first = Window.partitionBy("_digest").orderBy(F.asc_nulls_last("_key"))
    kept = left.withColumn("_row", F.row_number().over(first)).where(F.col("_row") == 1)
    return kept.select(*[F.col("_all")[name].alias(name) for name in df.columns])
