"""Explicit schemas: nothing is inferred, so zero-padded ids stay text."""

from pyspark.sql import types as T

ARTICLE_COLUMNS = [
    "article_id",
    "section_id",
    "sub_section_id",
    "newspaper_id",
    "newspaper_name",
    "title",
    "journalist_name",
    "created_at",
    "updated_at",
    "content_origin",
    "content_text",
]

ARTICLES = T.StructType([T.StructField(name, T.StringType()) for name in ARTICLE_COLUMNS])

# Header names of the trade files.
TRADE_AMOUNT = "거래금액(만원)"
TRADE_AREA = "전용면적(㎡)"
TRADE_MONTH = "계약년월"

# Header names of the policy map file.
MAP_MONTH = "월"
MAP_POLICY = "정책type"
