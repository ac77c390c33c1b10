"""Intermediate tables in the folder all executors share.

`stage` writes a DataFrame once and reads it back. A plan that needs an expensive input twice
(document frequencies and then scores) pays for it once, a lost executor costs no recomputation, and
the planner sees the real file size, so no join here needs a hint. `discard` empties a staged table
as soon as nothing reads it any more; the shuffle files of a staging job go when the job ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application below `spark.checkpoint.dir`; a temporary one only in local mode without that setting."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if base:
        return f"{base.rstrip('/')}/pricetrace-{context.applicationId}"
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="pricetrace-")
    return _local_roots[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session setting `key` for the length of a block; afterwards it is as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Staged:
    """A table in the scratch folder: `df` scans it, `discard` empties it."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = new_path(self.spark, label)
        with setting(self.spark, _CLEANUP, "true"):
            df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def discard(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self.path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a Parquet table in the scratch folder and return a scan of it."""
    return Staged(df, label).df
