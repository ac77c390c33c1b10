"""The exact most frequent terms of every month without sending every term across the cluster.

Three rounds with a uniform threshold. Every task counts its own terms, in one part or, where they are too many to hold, in
several, and keeps the counts where it made them. First the leaders of all parts are sent; the n-th largest sum of a month
is a bound that the true n-th cannot fall below. A term that is to reach it must have at least its m-th part in one of the
m parts that saw the month, so then only counts of that size are sent, and with them an upper limit of every term is known.
At last the counts of those whose limit reaches the bound are looked up everywhere. What the tail of rare terms costs is
one local pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetrace.operators.ranking import top_rows
from pricetrace.scratch import stage

#: Rows after which a task adds up what it has.
_ADD_UP = 250_000
#: Distinct terms at which a task stores what it has as one part and begins the next.
_PART_TERMS = 500_000


@dataclass(frozen=True)
class Rounds:
    """The rows that each round sends, and the result (month, term, freq, df, rank)."""

    leaders: DataFrame
    large: DataFrame
    survivors: DataFrame
    result: DataFrame


def _summed(tables: list[pa.Table]) -> pa.Table:
    grouped = pa.concat_tables(tables).group_by(["month", "term"]).aggregate([("freq", "sum"), ("df", "sum")])
    return pa.table({"month": grouped["month"], "term": grouped["term"], "freq": grouped["freq_sum"], "df": grouped["df_sum"]})


def _part(total: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, month, term, freq, df, place) of one part's sums."""
    total = total.take(pc.sort_indices(total, [("month", "ascending"), ("freq", "descending"), ("term", "ascending")]))
    months = total["month"].combine_chunks()
    codes = months.dictionary_encode(null_encoding="encode").indices.to_numpy()
    places = np.arange(len(codes)) - np.flatnonzero(np.diff(codes, prepend=-1))[codes] + 1
    columns = [pa.array(np.full(len(codes), number)), months, total["term"], total["freq"], total["df"], pa.array(places.astype(np.int32))]
    yield from pa.table(columns, names=["part", "month", "term", "freq", "df", "place"]).to_batches(100_000)


def local_counts(grams: DataFrame) -> DataFrame:
    """(part, month, term, freq, df, place) of every part's own terms, stored; `place` is the term's rank there.

    `grams` is (month, doc, grams array<struct<term, tf>>). Nothing is shuffled; a task holds about `_PART_TERMS` distinct
    terms at most, however many it reads.
    """
    rows = grams.select("month", F.inline("grams")).select("month", "term", F.col("tf").cast("long").alias("freq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept: list[pa.Table] = []
        size, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept.append(table.append_column("df", pa.array([1] * len(table), pa.int64())))
            size += len(table)
            if size >= _ADD_UP:
                kept, size = [_summed(kept)], 0
                if len(kept[0]) >= _PART_TERMS:
                    yield from _part(kept.pop(), number)
                    number += 1
        if kept:
            yield from _part(_summed(kept), number)

    return stage(rows.mapInArrow(run, "part bigint, month string, term string, freq bigint, df bigint, place int"), "local-counts")


def _nth(sums: DataFrame, n: int) -> DataFrame:
    """(month, bound): the n-th largest `low` of every month; months with fewer than n terms are left out."""
    order = Window.partitionBy("month").orderBy(F.desc("low"), F.asc("term"))
    return sums.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).where(F.col("_r") == n).select("month", F.col("low").alias("bound"))


def top_terms(local: DataFrame, n: int) -> Rounds:
    """The n most frequent terms of every month in `local_counts`, ties in alphabetical order."""
    leaders = local.where(F.col("place") <= n)
    first = _nth(leaders.groupBy("month", "term").agg(F.sum("freq").alias("low")), n)
    parts = local.where("place = 1").groupBy("month").agg(F.count("*").alias("m"))
    least = F.greatest(F.lit(1), F.coalesce(F.ceil(F.col("bound") / F.col("m")), F.lit(1))).cast("long")
    limits = stage(parts.join(first, "month", "left").select("month", "m", least.alias("least")), "limits")
    large = local.join(limits, "month").where((F.col("place") <= n) | (F.col("freq") >= F.col("least")))
    # A part that did not send the term has at most one less than the threshold of it.
    limit = F.col("low") + (F.col("m") - F.col("_sent")) * (F.col("least") - 1)
    sums = large.groupBy("month", "term", "m", "least").agg(F.sum("freq").alias("low"), F.count("*").alias("_sent"))
    sums = stage(sums.select("month", "term", "low", limit.alias("high")), "limits-of-terms")
    chosen = sums.join(_nth(sums, n), "month", "left").where(F.col("high") >= F.coalesce("bound", F.lit(0))).select("month", "term")
    survivors = local.join(chosen, ["month", "term"], "left_semi")
    totals = survivors.groupBy("month", "term").agg(F.sum("freq").alias("freq"), F.sum("df").alias("df"))
    return Rounds(leaders, large, survivors, top_rows(totals, ["month"], [F.desc("freq"), F.asc("term")], n))


def vocab_cap_by_threshold(grams: DataFrame, n: int) -> DataFrame:
    """(month, term, freq, df, rank) as `tfidf.vocab_cap` gives it. Rows with a null month are left out."""
    return top_terms(local_counts(grams.where(F.col("month").isNotNull())), n).result.select("month", "term", "freq", "df", "rank")
