"""Mixing sources to target weights with Sainte-Laguë quotas.

Targets share all words of the corpus by weight, none above `repeat` times its source. Equal blocks of words are
allocated to the sources by the highest quotients, then each source's blocks to its shards in the same way. The
documents of a source are dealt to parts in a seeded order; as many neighbouring parts as it takes to hold enough words
are a shard, a line of words cut into equal blocks; a seeded permutation of the block numbers says which blocks the
quota takes once more than the others. Everything but per-source and per-part sums stays with the rows, and the
documents are dealt out once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrace.scratch import Staged

WORD = r"[^\x20\x09-\x0D]+"
#: Prime above any line's number of blocks, so that multiples of it visit every block.
STRIDE = 2_147_483_647


@dataclass(frozen=True)
class Mix:
    """`weights` repeat over the sources in code point order, null last.

    A source has at most `parts` shards, and one per `shard_words` words, so that rounding to whole blocks stays small.
    """

    weights: tuple[int, ...] = (1, 2, 3)
    repeat: int = 3
    block_words: int = 32
    parts: int = 128
    shard_words: int = 4_096
    seed: int = 7


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(votes: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    """`votes` (group, item, votes, seats) with `quota`: the group's `seats` go to the highest votes / (2 s + 1).

    Equal quotients go to the smaller item. Only the last seats are ranked: with n items, votes * (seats - n/2) / total
    rounded is below every quota and votes * (seats + n/2) / total above, at most 2 n seats apart in a group.
    """
    whole = Window.partitionBy(*group)
    half, total = F.count("*").over(whole) / 2, F.greatest(F.sum("votes").over(whole), F.lit(1e-300))
    share = F.col("votes") / total
    bounds = votes.withColumn("_low", F.greatest(F.lit(0), F.ceil(share * (F.col("seats") - half) - 0.5)).cast("long"))
    bounds = bounds.withColumn("_high", F.greatest(F.col("_low"), F.floor(share * (F.col("seats") + half) + 0.5).cast("long")))
    bounds = bounds.withColumn("_left", F.col("seats") - F.sum("_low").over(whole))
    offered = bounds.where(F.col("_high") > F.col("_low")).select(
        *group, *item, "votes", "_left", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_s")
    )
    order = Window.partitionBy(*group).orderBy(F.desc(F.col("votes") / (2 * F.col("_s") + 1)), *item)
    won = offered.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("_left"))
    more = won.groupBy(*group, *item).agg(F.count("*").alias("_more"))
    joined = bounds.join(more, [*group, *item], "left")
    return joined.withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).select(*votes.columns, "quota")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(_null, _source, source_size, target) from per-source sizes: min(repeat * size, level * weight), adding up to all words.

    The level is the highest one that the sources give when those with the smallest size per weight are taken as full.
    """
    named = Window.partitionBy(F.lit(0)).orderBy("_null", "_source")
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    weighed = sizes.withColumn("_w", F.get(weights, (F.row_number().over(named) - 1) % len(mix.weights)))
    everything = Window.partitionBy(F.lit(0))
    rising = everything.orderBy(F.col("source_size") / F.col("_w"), "_null", "_source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * mix.repeat
    level = (F.sum("source_size").over(everything) - full) / F.sum("_w").over(after)
    levels = weighed.withColumn("_level", level)
    target = F.least(F.col("source_size") * float(mix.repeat), F.max("_level").over(everything) * F.col("_w"))
    return levels.select("_null", "_source", "source_size", target.alias("target"))


def keyed(df: DataFrame, mix: Mix, key: str, source: str, text: str) -> DataFrame:
    """`_row` (all columns of `df`) with its words, its part (_null, _source, _part) and its seeded place in it."""
    place = F.xxhash64(F.lit(mix.seed), F.col(key), F.xxhash64(text))
    return df.select(
        F.struct(*[F.col(name) for name in df.columns]).alias("_row"),
        count_words(F.col(text)).alias("size"),
        F.col(source).isNull().alias("_null"),
        F.coalesce(F.col(source), F.lit("")).alias("_source"),
        F.pmod(place, F.lit(mix.parts)).cast("int").alias("_part"),
        place.alias("_place"),
    )


def quotas(placed: DataFrame, mix: Mix) -> DataFrame:
    """(_null, _source, _part, _shard, _offset, line, blocks, quota, source_size, target) per part.

    `_offset` is where the part begins in its shard; `line`, `blocks` and `quota` are the shard's words, its blocks and
    how many of them to take. A shard's votes are its blocks and a source's its target in blocks, so no quota is more than
    `repeat` times the blocks but for the last seat of a source at its limit, which is then not taken.
    """
    source, shard = ["_null", "_source"], ["_null", "_source", "_shard"]
    parts = Staged(placed.groupBy(*source, "_part").agg(F.sum("size").alias("_words")), "parts").df
    sizes = parts.groupBy(*source).agg(F.sum("_words").alias("source_size"))
    aims = targets(sizes, mix)
    shards = F.least(F.lit(mix.parts), F.greatest(F.lit(1), F.floor(F.col("source_size") / mix.shard_words)))
    dealt = parts.join(aims, source).withColumn("_shard", F.floor(F.col("_part") * shards / mix.parts).cast("int"))
    whole = Window.partitionBy(*shard)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_offset", F.coalesce(F.sum("_words").over(before), F.lit(0))).withColumn("line", F.sum("_words").over(whole))
    dealt = dealt.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("line") / mix.block_words)).cast("long"))
    lines = dealt.groupBy(*shard, "line", "blocks", "source_size", "target").agg(F.count("*").alias("_parts"))
    totals = lines.groupBy(*source, "source_size", "target").agg(F.sum("blocks").alias("_blocks"))
    votes = totals.withColumn("votes", F.expr("coalesce(try_divide(target * _blocks, source_size), 0D)"))
    seats = F.round(F.sum("votes").over(Window.partitionBy(F.lit(0)))).cast("long")
    by_source = sainte_lague(votes.select(F.lit(0).alias("_all"), *source, "_blocks", "votes", seats.alias("seats")), ["_all"], source)
    seats = by_source.select(*source, F.least("quota", F.col("_blocks") * mix.repeat).alias("seats"))
    by_shard = sainte_lague(lines.join(seats, source).withColumn("votes", F.col("blocks").cast("double")), source, ["_shard"])
    return dealt.join(by_shard.select(*shard, "quota"), shard).drop("_words")


def laid_out(placed: DataFrame, table: DataFrame, mix: Mix) -> DataFrame:
    """Rows with `_start`, their first word in the line, and `_picked`, the blocks they touch that are taken once more."""
    keys = ["_null", "_source", "_part"]
    before = Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0))).join(table, keys)
    rows = rows.withColumn("_start", F.col("_before") + F.col("_offset"))
    shifted = rows.withColumn("_shift", F.pmod(F.xxhash64(F.lit(mix.seed), "_null", "_source", "_shard"), "blocks"))
    touched = "sequence(((_start + 1) * blocks - 1) div line, ((_start + size) * blocks - 1) div line)"
    chosen = f"filter({touched}, j -> (j * ({STRIDE}L % blocks) + _shift) % blocks < quota % blocks)"
    return shifted.withColumn("_picked", F.expr(f"CASE WHEN size > 0 THEN {chosen} ELSE array() END"))


#: Words of a row in block j: from FIRST, counted in the line, up to LAST.
FIRST = "greatest(_start, (j * line) div blocks)"
LAST = "least(_start + size, ((j + 1) * line) div blocks)"
PARTIAL = f"aggregate(_picked, 0L, (s, j) -> s + {LAST} - {FIRST})"


def mix_table(df: DataFrame, mix: Mix = Mix(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, size, source_size, target, taken) per row: `taken` words of it go into the mix, repeats counted.

    Null and empty texts have size 0 and take nothing; a source without words has target 0. Rows that repeat in every
    column lie next to each other in their line and each take their own share. An empty table stays empty.
    """
    placed = keyed(df.select(key, source, text), mix, key, source, text)
    narrow = Staged(placed.select(F.col("_row")[key].alias(key), *placed.columns[1:]), "placed").df
    rows = laid_out(narrow, quotas(narrow, mix), mix)
    taken = F.expr(f"(quota div blocks) * size + {PARTIAL}")
    return rows.select(key, "size", "source_size", "target", taken.alias("taken"))


def mixed_texts(df: DataFrame, mix: Mix = Mix(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself, with the columns of `df`: a row for each time a document is taken, whole or as its chosen blocks.

    A row taken in part has the words of its blocks in their order, each with the whitespace before it; a row taken as
    a whole keeps its text. Rows of which nothing is taken, those without words among them, are left out.
    """
    placed = keyed(df, mix, key, source, text)
    rows = laid_out(placed, quotas(placed, mix), mix).withColumn("_text", F.col("_row")[text])
    words = "regexp_extract_all(_text, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0)"
    blocks = f"transform(_picked, j -> array_join(slice(_words, int({FIRST} - _start + 1), int({LAST} - {FIRST})), ''))"
    some = rows.withColumn("_whole", F.expr("quota div blocks")).withColumn("_part", F.expr(PARTIAL))
    some = some.where("size > 0 AND (_whole > 0 OR _part > 0)")
    some = some.withColumn("_words", F.expr(f"CASE WHEN _part > 0 AND _part < size THEN {words} END"))
    part = f"CASE WHEN _part = size THEN _text ELSE array_join({blocks}, '') END"
    copies = F.expr(f"concat(array_repeat(_text, int(_whole)), CASE WHEN _part > 0 THEN array({part}) ELSE array() END)")
    taken = some.select("_row", F.explode(copies).alias("_taken"))
    return taken.select(*[F.col("_taken").alias(text) if name == text else F.col("_row")[name].alias(name) for name in df.columns])
