"""Row filters and cleaning steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HANGUL = "[가-힣]"  # fixed value: default script range


def drop_required_nulls(df: DataFrame, columns: list[str], mode: str = "any") -> DataFrame:
    """`any` drops a row when one of the columns is null, `all` only when every one is.

    With `all`, the columns count independently of each other: a null title does not lose its body.
    """
    return df.dropna(how="any" if mode == "any" else "all", subset=columns)


def script_filter(df: DataFrame, column: str = "content_text", characters: str = HANGUL) -> DataFrame:
    """Rows whose text holds at least one character of the range."""
    return df.where(F.col(column).rlike(characters))


def policy_rank_filter(ranked: DataFrame, policy: int | str, top: int = 3, policy_col: str = "policy", rank_col: str = "rank") -> DataFrame:
    """Rows of one policy with rank ≤ `top`; a rank that is no number (the literal "None") never passes."""
    return ranked.where((F.col(policy_col) == policy) & (F.col(rank_col).try_cast("int") <= top))


def semi_join(articles: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Articles whose key is in `ids`; nothing is collected."""
    return articles.join(ids.select(*on), on, "left_semi")


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by column name; prefer one scan of the common directory where the inputs are files."""
    first, *rest = frames
    for other in rest:
        first = first.unionByName(other)
    return first
