"""Column expressions for month keys, labels, ids, numbers and URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label wording and article address used by the outputs.
POLICY_PREFIX = "정책 "
NO_POLICY = "None"
ARTICLE_URL_PREFIX = "https://n.news.naver.com/mnews/article"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`, which may use it many times inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def month_index(month: Column) -> Column:
    """YYYYMM text as a running month number, so month distances are plain subtractions; null for a malformed month."""
    return (F.substring(month, 1, 4).try_cast("int") * 12 + F.substring(month, 5, 2).try_cast("int")).cast("int")


def month_of_index(index: Column) -> Column:
    year = F.floor((index - 1) / 12).cast("int")
    return F.format_string("%04d%02d", year, (index - year * 12).cast("int"))


def month_start(month: Column) -> Column:
    return F.to_date(month, "yyyyMM")


def shift_month(month: Column, months: int) -> Column:
    return F.date_format(F.add_months(month_start(month), months), "yyyyMM")


def previous_day(day: Column) -> Column:
    """yyyyMMdd text one day earlier."""
    return F.date_format(F.date_sub(F.to_date(day, "yyyyMMdd"), 1), "yyyyMMdd")


def parse_number(text: Column) -> Column:
    """Number with thousands separators; anything else becomes null."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def pad_id(article_id: Column, width: int = 10) -> Column:
    """Zero-pad to `width`; longer ids are kept whole, which `lpad` alone would cut."""
    text = article_id.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def article_url(newspaper_id: Column, article_id: Column, prefix: str = ARTICLE_URL_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.lit("/"), newspaper_id, F.lit("/"), article_id)


def policy_label(policy: Column) -> Column:
    """Policy number to its text label; null becomes the literal used at sinks."""
    return F.coalesce(F.concat(F.lit(POLICY_PREFIX), policy.cast("string")), F.lit(NO_POLICY))


def policy_number(label: Column) -> Column:
    """Text label to policy number; null when the label names no policy."""
    return F.regexp_extract(label, rf"^\s*{POLICY_PREFIX.strip()}\s*(\d+)", 1).try_cast("int")


def round_key(value: Column, digits: int = 9) -> Column:
    """Rounded sort key, so that a different summation order can neither make nor break a tie."""
    return F.round(value, digits)
