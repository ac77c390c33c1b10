"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrace.scratch import Staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node that can be reached.

    Large and small stars in turn: each node's larger neighbours, then its smaller ones, are linked to its smallest one,
    until nothing changes. Rounds grow with the logarithm of the nodes; each is a stored table, and no group is collected.
    """
    edges = Staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.df.unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = Staged(joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        edges.discard()
        edges = after
        now = edges.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).head()
        if now == state:
            roots = edges.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        state = now
