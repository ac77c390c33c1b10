"""A corpus made ready for training: harmful texts go, copies go, sources are mixed and the rest is packed into windows.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read back as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricetrace.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from pricetrace.llm.queries import toxicity_model
from pricetrace.scratch import Staged
from pricetrace.sources.tables import read_table

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: The shingles of this stage; registered near-duplicate queries may take other lengths.
FIVE_WORDS = near_dedup.Forest(width=5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5, by a model learned from the labelled ones among them."""
    return toxicity.keep_harmless(docs, toxicity_model(spark, sf_dir, docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, but for whitespace, the document with the smallest id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return near_dedup.keep_one(docs, FIVE_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of words that the sources' targets ask for, a row for each time a document is taken."""
    mixed = mixing.mixed_texts(docs)
    return mixed.selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as bigint) AS n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in windows of 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The fit, the forest and the tokens have no SQL; the stages are tested against plain versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from the documents table to the packed pieces."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet", DOCUMENTS)
    for name, stage in STAGES:
        docs = Staged(stage(spark, docs, sf_dir), name.replace(" ", "-")).df
    return docs
