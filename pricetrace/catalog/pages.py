"""Web pages: links, ids, fields and sections."""

from pyspark.sql import functions as F

from pricetrace.catalog.bindings import pages
from pricetrace.catalog.registry import query
from pricetrace.functions.markup import FieldRule
from pricetrace.keyword_sets import sections_df
from pricetrace.operators import pages as operators

_LINK = r"^/[A-Za-z]"
_IDS = r"/([a-z]{2})/([0-9]+)"
_RULES = (
    FieldRule("lang", "html", (), "lang"),
    FieldRule("charset", "meta", (("charset", "utf-8"),), "charset"),
    FieldRule("title", "title"),
    FieldRule("headline", "h1"),
    FieldRule("advert", "div", (("class", "ad"),)),
    FieldRule("content_text", "article"),
    FieldRule("content_origin", "article", (), "raw"),
)

# The check SQL reads the pages by plain string functions, which their regular form allows.
_ENTITIES = (("&quot;", 34), ("&copy;", 169), ("&middot;", 183), ("&amp;", 38))


def _between(opening: str, closing: str) -> str:
    return f"split_part(split_part(html, '{opening}', 2), '{closing}', 1)"


def _text_sql(opening: str, closing: str) -> str:
    parts = f"string_split({_between(opening, closing)}, '<')"
    text = f"array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i = 1 THEN p ELSE substr(p, strpos(p, '>') + 1) END), '')"
    for entity, code in _ENTITIES:
        text = f"replace({text}, '{entity}', chr({code}))"
    return f"trim({text}, ' ' || chr(10) || chr(160))"


@query("page_links", rf"""
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY link) AS position, link FROM (
    SELECT DISTINCT page_id, link FROM (
      SELECT page_id, unnest(list_transform(string_split(html, '<a href="')[2:], lambda p: split_part(p, '"', 1))) AS link FROM pages)
    WHERE regexp_matches(link, '{_LINK}'))""")
def page_links(spark, sf):
    links = operators.extract_links(pages(spark, sf), _LINK)
    return links.select("page_id", F.col("position").cast("long").alias("position"), "link")


@query("url_ids", f"""
  SELECT page_id, nullif(regexp_extract(url, '{_IDS}', 1), '') AS newspaper_id,
    nullif(regexp_extract(url, '{_IDS}', 2), '') AS article_id FROM pages""")
def url_ids(spark, sf):
    newspaper, article = operators.url_ids(F.col("url"), _IDS)
    return pages(spark, sf).select("page_id", newspaper.alias("newspaper_id"), article.alias("article_id"))


@query("page_fields", f"""
  SELECT page_id, url, {_between('<html lang="', '"')} AS lang, {_between('<meta charset="', '"')} AS charset,
    {_text_sql("<title>", "</title>")} AS title, {_text_sql("<h1>", "</h1>")} AS headline,
    {_text_sql('<div class="ad">', "</div>")} AS advert, {_text_sql("<article>", "</article>")} AS content_text,
    '<article>' || {_between("<article>", "</article>")} || '</article>' AS content_origin
  FROM pages""")
def page_fields(spark, sf):
    return operators.extract_fields(pages(spark, sf), _RULES)


@query("page_fields_parser", f"""
  SELECT page_id, {_text_sql("<title>", "</title>")} AS title, {_text_sql('<div class="ad">', "</div>")} AS advert,
    {_text_sql("<article>", "</article>")} AS content_text
  FROM pages""")
def page_fields_parser(spark, sf):
    return operators.extract_fields(pages(spark, sf), _RULES, "parser").select("page_id", "title", "advert", "content_text")


@query("section_lookup", f"""
  SELECT page_id, section, CASE section WHEN 'en' THEN '101' WHEN 'fr' THEN '101' WHEN 'de' THEN '100' END AS section_id,
    CASE section WHEN 'en' THEN '260' WHEN 'fr' THEN '259' WHEN 'de' THEN '266' END AS sub_section_id
  FROM (SELECT page_id, nullif(regexp_extract(url, '{_IDS}', 1), '') AS section FROM pages)""")
def section_lookup(spark, sf):
    names = pages(spark, sf).select("page_id", operators.url_ids(F.col("url"), _IDS)[0].alias("section"))
    table = sections_df(spark, [("en", "101", "260"), ("fr", "101", "259"), ("de", "100", "266")])
    return operators.with_section_ids(names, table).select("page_id", "section", "section_id", "sub_section_id")
