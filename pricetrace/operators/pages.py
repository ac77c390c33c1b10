"""Links, ids and article fields from stored web pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrace.functions.markup import ARTICLE_RULES, FieldRule, decode_entities, field_columns, node_table, page_pieces, parsed_fields

# Addresses of article pages.
LINK_PATTERN = r"https://n\.news\.naver\.com/mnews/article/\d{3}/\d+"
ID_PATTERN = r"/article/(\d+)/(\d+)"

# One class per quote kind: Java matches such a repetition without recursion, however long the value.
_HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*\\?("[^"]*"|'[^']*'|[^\s"'>]+)"""


def link_array(html: Column, pattern: str = LINK_PATTERN) -> Column:
    """Sorted distinct link targets that match `pattern`: outer quotes stripped, entities decoded, then without backslashes and double quotes."""
    found = F.transform(F.regexp_extract_all(html, F.lit(_HREF), F.lit(1)), lambda u: decode_entities(F.regexp_replace(u, r"""^["']|["']$""", "")))
    wanted = F.filter(found, lambda u: F.regexp_like(u, F.lit(pattern)))
    bare = F.transform(wanted, lambda u: F.translate(u, '\\"', ""))
    return F.array_sort(F.array_distinct(bare))


def extract_links(pages: DataFrame, pattern: str = LINK_PATTERN) -> DataFrame:
    """(page_id, position, link), position counted from 1 in sorted order."""
    return pages.select("page_id", F.posexplode(link_array(F.col("html"), pattern)).alias("pos", "link")).select(
        "page_id", (F.col("pos") + 1).alias("position"), "link"
    )


def url_ids(url: Column, pattern: str = ID_PATTERN) -> tuple[Column, Column]:
    """(newspaper id, article id); both null when the address holds none."""
    return tuple(F.nullif(F.regexp_extract(url, pattern, g), F.lit("")) for g in (1, 2))


def extract_fields(pages: DataFrame, rules: Iterable[FieldRule] = ARTICLE_RULES, engine: str = "native") -> DataFrame:
    """Page columns plus one column per rule. Both engines give the same values: `native` cuts a page into pieces once and looks
    all rules up in the table of its nodes, `parser` runs an HTML parser once per page and also copes with attribute values that hold a `>`."""
    rules = list(rules)
    if engine == "native":
        pieces = pages.select("page_id", "url", page_pieces(F.col("html")).alias("_pieces"))
        nodes = pieces.withColumn("_nodes", node_table("_pieces", [rule.tag for rule in rules]))
        fields = nodes.select("page_id", "url", field_columns("_pieces", "_nodes", rules).alias("_fields"))
        return fields.select("page_id", "url", *[F.get("_fields", F.lit(at)).alias(rule.field) for at, rule in enumerate(rules)])
    if engine == "parser":
        return pages.select("page_id", "url", parsed_fields(F.col("html"), rules).alias("f")).select("page_id", "url", "f.*")
    raise ValueError(f"unknown engine: {engine}")


def with_section_ids(df: DataFrame, sections: DataFrame, name_col: str = "section") -> DataFrame:
    """Section and sub-section id by name; unknown names get nulls."""
    return df.join(sections.withColumnRenamed("name", name_col), name_col, "left")
