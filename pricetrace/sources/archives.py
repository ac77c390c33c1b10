"""Which files are whole: compressed files are read to their end and checked against their trailer."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE, CUT_OFF, DAMAGED, TOO_LARGE = "whole", "cut off", "damaged", "too large"
#: Bytes handed to the decompressor at once, and files above which none is read whole into a task.
CHUNK = 1 << 20
MOST_BYTES = 1 << 30


def inspect(content: bytes) -> tuple[str, int, int, int]:
    """(state, bytes used, bytes unpacked, line ends) of a gzip file, member by member.

    The decompressor checks each member's length and checksum; a file whose last member has no end was cut off.
    """
    used = unpacked = lines = 0
    member = None
    while used < len(content):
        if member is None:
            if not content[used:].strip(b"\0"):
                return WHOLE, len(content), unpacked, lines
            member = zlib.decompressobj(wbits=31)
        part = content[used : used + CHUNK]
        try:
            rest = part
            while rest and not member.eof:
                out = member.decompress(rest, CHUNK)
                unpacked, lines, rest = unpacked + len(out), lines + out.count(b"\n"), member.unconsumed_tail
        except zlib.error:
            return DAMAGED, used, unpacked, lines
        used += len(part) - len(member.unused_data)
        if member.eof:
            member = None
    return (WHOLE if member is None else CUT_OFF), used, unpacked, lines


def archive_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, length, state, bytes_read, bytes_unpacked, line_ends) of every file below `path`.

    `state` is `whole`, `cut off`, `damaged` (a wrong byte, length or checksum) or, for compressed files of more than
    `MOST_BYTES`, which are not opened, `too large`. Plain files cannot be damaged in this way and are whole; files
    without a byte are not listed. One task looks at a file, streaming through its unpacked content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select(F.col("path").alias("file"), "length", F.endswith(F.lower("path"), F.lit(".gz")).alias("packed"))
    nothing = F.lit(None).cast("long")
    plain = named.where("NOT packed").select("file", "length", F.lit(WHOLE).alias("state"), F.col("length").alias("bytes_read"), nothing.alias("bytes_unpacked"), nothing.alias("line_ends"))
    large = named.where(F.col("packed") & (F.col("length") > MOST_BYTES)).select("file", "length", F.lit(TOO_LARGE).alias("state"), F.lit(0).cast("long").alias("bytes_read"), nothing.alias("bytes_unpacked"), nothing.alias("line_ends"))
    opened = files.where((F.col("length") <= MOST_BYTES) & F.endswith(F.lower("path"), F.lit(".gz")))
    schema = "file string, length bigint, state string, bytes_read bigint, bytes_unpacked bigint, line_ends bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame([(row.path, row.length, *inspect(bytes(row.content)))], columns=[field.split(" ")[0] for field in schema.split(", ")])

    return opened.select("path", "length", "content").mapInPandas(run, schema).unionByName(plain).unionByName(large)


def damaged_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The files of `archive_states` that are not known to be whole, with what can still be read of them."""
    return archive_states(spark, path).where(F.col("state") != WHOLE)
