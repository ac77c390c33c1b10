"""CSV files with line breaks inside quotes, read in splits.

Spark's multi-line reader streams such a file in one task, because a split cannot tell whether it begins inside quotes.
Here the lines of all splits are read as text. The number of quotes in each split gives, summed up along a file, whether
the next split begins inside quotes (a doubled quote counts twice, so it changes nothing). With that, every task glues the
lines of its splits into records by itself; only the pieces of records that cross the end of a split are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a glued text is: a record, or a piece that ends a record of an earlier split, begins one that goes on, or lies inside one.
RECORD, END, BEGIN, MIDDLE = range(4)
_SPLIT = ["file", "split"]
_GLUED = "file string, split bigint, kind int, first boolean, text string"


def split_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, line, quotes, text): the lines of all files below `path`, `split` being the first byte of their split."""
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"), quotes.alias("quotes"), F.col("value").alias("text"),
    )


def open_splits(lines: DataFrame) -> DataFrame:
    """(file, split, inside): whether a split begins inside quotes, from the quotes of the splits before it."""
    counts = lines.groupBy(*_SPLIT).agg(F.sum("quotes").alias("_quotes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*_SPLIT, (F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


class _Gluer:
    """Goes along one split's lines."""

    def __init__(self, inside: bool, start: int):
        self.inside, self.began_inside, self.kept, self.first = inside, inside, [], start == 0

    def add(self, text: str, quotes: int) -> tuple[int, bool, str] | None:
        self.kept.append(text)
        self.inside ^= bool(quotes % 2)
        return None if self.inside else self._cut(END if self.began_inside else RECORD)

    def _cut(self, kind: int) -> tuple[int, bool, str]:
        out = (kind, self.first, "\n".join(self.kept))
        self.kept, self.began_inside, self.first = [], False, False
        return out

    def rest(self) -> tuple[int, bool, str] | None:
        return self._cut(MIDDLE if self.began_inside else BEGIN) if self.kept else None


def glued(lines: DataFrame) -> DataFrame:
    """(file, split, kind, first, text): records and pieces of records; `first` marks the first record of a file.

    Fails if the splits are not those that were counted, as when files change in between.
    """
    known = F.when(F.col("inside").isNull(), F.raise_error(F.lit("the files were split in another way when their quotes were counted"))).otherwise(F.col("inside"))
    rows = lines.join(open_splits(lines), _SPLIT, "left").withColumn("inside", known).sortWithinPartitions(*_SPLIT, "line")
    names = [field.split(" ")[0] for field in _GLUED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, gluer, out = None, None, []

        def made(found: tuple[int, bool, str] | None) -> None:
            if found is not None:
                out.append((*place, *found))

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in (*_SPLIT, "inside", "quotes", "text")]
            for file, split, inside, quotes, text in zip(*columns, strict=True):
                if place != (file, split):
                    if gluer is not None:
                        made(gluer.rest())
                    place, gluer = (file, split), _Gluer(inside, split)
                made(gluer.add(text, quotes))
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out) if out else [[]] * 5, strict=True)), schema=_ARROW)
            out.clear()
        if gluer is not None:
            made(gluer.rest())
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out) if out else [[]] * 5, strict=True)), schema=_ARROW)

    return rows.select(*_SPLIT, "inside", "quotes", "text").mapInArrow(run, _GLUED)


_ARROW = pa.schema([("file", pa.string()), ("split", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])


def quoted_records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """(file, record): the records of all CSV files below `path`, headers and empty lines left out.

    Records end with a line feed, with or without a carriage return. Quotes that are never closed reach to the file's end.
    A compressed file is one split.
    """
    pieces = glued(split_lines(spark, path))
    order = Window.partitionBy("file").orderBy("split", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = pieces.where(F.col("kind") != RECORD).withColumn("_chain", F.sum((F.col("kind") == BEGIN).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("split", "kind", "first", "text")))
    joined = crossing.groupBy("file", "_chain").agg(parts.alias("_parts")).select(
        "file", F.exists("_parts", lambda part: part["first"]).alias("first"), F.array_join(F.transform("_parts", lambda part: part["text"]), "\n").alias("text")
    )
    records = pieces.where(F.col("kind") == RECORD).select("file", "first", "text").unionByName(joined)
    records = records.select("file", "first", F.regexp_replace("text", "\r$", "").alias("record")).where("record <> ''")
    return (records.where(~F.col("first")) if header else records).select("file", "record")


def parsed(record: Column, schema: T.StructType) -> Column:
    """A record's fields, read as the CSV files of the articles are written."""
    return F.from_csv(record, schema.simpleString()[len("struct<") : -1].replace(":", " "), {"quote": '"', "escape": '"', "multiLine": "true"})
