"""HTML fields as native expressions, and the same fields by a parser."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from html import unescape
from html.entities import name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrace.functions.columns import let


@dataclass(frozen=True)
class FieldRule:
    """How to read one field: first `tag` whose `where` attributes match, then text, an attribute or raw markup."""

    field: str
    tag: str
    where: tuple[tuple[str, str], ...] = ()
    take: str = "text"  # text | raw | name of an attribute


# Nodes of the article pages.
ARTICLE_RULES = (
    FieldRule("newspaper_name", "meta", (("name", "twitter:creator"),), "content"),
    FieldRule("title", "h2", (("id", "title_area"),)),
    FieldRule(
        "created_at",
        "span",
        (("class", "media_end_head_info_datestamp_time _ARTICLE_DATE_TIME"),),
        "data-date-time",
    ),
    FieldRule(
        "updated_at",
        "span",
        (("class", "media_end_head_info_datestamp_time _ARTICLE_MODIFY_DATE_TIME"),),
        "data-modify-date-time",
    ),
    FieldRule("journalist_name", "em", (("class", "media_end_head_journalist_name"),)),
    FieldRule("content_text", "article", (("id", "dic_area"),)),
    FieldRule("content_origin", "article", (("id", "dic_area"),), "raw"),
)

#: Named character references of HTML 4; numeric ones are computed.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())}
_REFERENCE = r"&(?!amp;)(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r\u00a0"))


def _constant_map(pairs: dict[str, str]) -> Column:
    """A map of literals from two of them: it costs the planner little, which folds it into one."""
    return F.map_from_arrays(*[F.split(F.lit("\n".join(side)), "\n") for side in (pairs.keys(), pairs.values())])


def _character(reference: Column) -> Column:
    """Text of one character reference; one that names no character stays as it is."""
    body = F.substring(reference, F.lit(2), F.length(reference) - 2)
    hexadecimal = F.regexp_like(body, F.lit("^#[xX]"))
    digits = F.when(hexadecimal, F.substring(body, F.lit(3), F.length(body))).otherwise(F.substring(body, F.lit(2), F.length(body)))
    code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
    known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    # Numbers of the Windows code page stand for its characters, other numbers of no character for the replacement one.
    windows = F.try_element_at(_constant_map({str(n): unescape(f"&#{n};") for n in range(0x80, 0xA0)}), code.cast("string"))
    numeric = F.coalesce(windows, F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), F.lit("\ufffd"))
    named = F.try_element_at(_constant_map(ENTITIES), body)
    return F.coalesce(F.when(F.startswith(body, F.lit("#")), numeric).otherwise(named), reference)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references decoded once, from left to right.

    `&amp;` is decoded last, by a plain replacement: what the others leave cannot be read as one of them. Each distinct
    one of the others is looked up once per text.
    """

    def known(references: Column) -> Column:
        distinct = F.array_distinct(references)
        return F.struct(references.alias("references"), F.map_from_arrays(distinct, F.transform(distinct, _character)).alias("known"))

    def rebuilt(text: Column) -> Column:
        def with_ends(found: Column) -> Column:
            ends = F.concat(F.transform(found["references"], lambda one: found["known"][one]), F.array(F.lit("")))
            return F.array_join(F.flatten(F.zip_with(F.split(text, _REFERENCE, -1), ends, lambda a, b: F.array(a, b))), "")

        others = let(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(known(found), with_ends)).otherwise(text))
        return F.when(F.contains(text, F.lit("&")), F.replace(others, F.lit("&amp;"), F.lit("&"))).otherwise(text)

    return let(text, rebuilt)


#: A page in pieces: comments, scripts and styles with their content, tags, text. The one pattern that reads whole pages.
_PIECE = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[/!?a-z][^>]*>|[^<]+|<"
# Elements of HTML that have no closing tag.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
def page_pieces(html: Column) -> Column:
    """The page as an array of pieces that join to it again; a script or style element and a comment are one piece each."""
    return F.regexp_extract_all(html, F.lit(_PIECE), F.lit(0))


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once for a body which may name it many times."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _alternatives(names: Iterable[str]) -> str:
    return "|".join(re.escape(name) for name in sorted({name.lower() for name in names}))


def node_table(pieces: str, tags: Iterable[str]) -> Column:
    """Array of (tag, opening, start, end, depth) in the order of `start`: the elements of the given tags in the column `pieces`.

    `start` and `end` are the numbers of the opening and the closing piece; a closing tag closes the last open element of
    its name. `end` is null for elements that are never closed, `depth` counts the open ones of the given tags around.
    """
    marks = rf"""transform(filter(transform({pieces}, (text, at) -> struct(text, at)), x -> x.text rlike r'(?i)^</?(?:{_alternatives(tags)})(?=[\s/>])'),
      x -> struct(lower(regexp_extract(x.text, r'^</?([^\s/>]+)', 1)) AS tag, x.text AS text, x.at AS at, startswith(x.text, '</') AS closing))"""
    node = "named_struct('tag', one.tag, 'opening', one.text, 'start', one.at, 'end', {0}, 'depth', size(state.open))"
    empty = "CAST(array() AS array<struct<tag string, opening string, start int, end int, depth int>>)"
    void = f"one.tag rlike '^(?:{_alternatives(VOID_TAGS)})$'"
    # From 0, the place of the innermost open element of the name; below 0 if none is open.
    place = "size(state.open) - array_position(reverse(transform(state.open, x -> x.tag)), one.tag)"
    ended = "named_struct('tag', was.tag, 'opening', was.opening, 'start', was.start, 'end', one.at, 'depth', was.depth)"
    closed = _let("get(state.open, int(place))", "was", f"struct(filter(state.open, (x, i) -> i <> place) AS open, array_append(state.done, {ended}) AS done)")
    step = f"""CASE
      WHEN one.closing AND {void} THEN state
      WHEN one.closing THEN {_let(place, "place", f"CASE WHEN place < size(state.open) THEN {closed} ELSE state END")}
      WHEN {void} THEN struct(state.open AS open, array_append(state.done, {node.format("one.at")}) AS done)
      ELSE struct(array_append(state.open, {node.format("CAST(NULL AS int)")}) AS open, state.done AS done) END"""
    finish = "array_sort(concat(state.done, state.open), (a, b) -> a.start - b.start)"
    return F.expr(f"aggregate({marks}, struct({empty} AS open, {empty} AS done), (state, one) -> {step}, state -> {finish})")


#: An attribute with its value, in double, single or no quotes.
_ATTRIBUTE = r"(?is)\s{0}\s*=\s*(?:\x22{1}\x22|\x27{1}\x27|{1}(?=[\s>]))"
_ANY_VALUE = r"(?is)\s{0}\s*=\s*(\x22[^\x22]*\x22|\x27[^\x27]*\x27|[^\s\x22\x27>]+)"


def _pattern(template: str, *parts: str) -> str:
    """SQL literal of a pattern with parts to be matched as they are."""
    escaped = [re.escape(part).replace("'", r"\x27").replace('"', r"\x22") for part in parts]
    return "r'" + template.format(*escaped) + "'"


def _found(pieces: str, nodes: str, rule: FieldRule) -> str:
    """Markup or attribute value (entities as they are) of the first node that fits; one never closed ends with the page."""
    fits = "".join(f" AND x.opening rlike {_pattern(_ATTRIBUTE, name, value)}" for name, value in rule.where)
    node = f"get(filter({nodes}, x -> x.tag = {_pattern('{0}', rule.tag.lower())}{fits}), 0)"
    if rule.take in ("text", "raw"):
        body = f"slice({pieces}, node.start + 1, coalesce(node.end, size({pieces}) - 1) - node.start + 1)"
        # Tags, comments, scripts and styles are pieces of their own, so text is what is left without them.
        body = f"array_join({body if rule.take == 'raw' else f"filter({body}, x -> x = '<' OR NOT startswith(x, '<'))"}, '')"
    else:
        body = f"regexp_replace(nullif(regexp_extract(node.opening, {_pattern(_ANY_VALUE, rule.take)}, 1), ''), r'^[\\x22\\x27]|[\\x22\\x27]$', '')"
    return _let(node, "node", f"CASE WHEN node.start IS NOT NULL THEN {body} END")


def field_columns(pieces: str, nodes: str, rules: list[FieldRule]) -> Column:
    """Array of the rules' fields, looked up in the columns of a page's pieces and nodes; a missing node gives null.

    Texts are the node's markup without tags and outer blanks; texts and attribute values are decoded by one expression.
    """
    texts, plain = [rule for rule in rules if rule.take == "text"], [rule for rule in rules if rule.take == "raw"]
    values = [rule for rule in rules if rule.take not in ("text", "raw")]

    def found(some: list[FieldRule]) -> Column:
        return F.expr(f"array({', '.join(_found(pieces, nodes, rule) for rule in some)})").cast("array<string>")

    decoded = F.transform(F.concat(found(texts), found(values)), decode_entities)
    whole = F.concat(F.transform(F.slice(decoded, 1, len(texts)), strip_blanks), found(plain), F.slice(decoded, len(texts) + 1, len(values)))
    order = [*texts, *plain, *values]
    return let(whole, lambda all_: F.array(*[F.get(all_, F.lit(order.index(rule))) for rule in rules]))


class _NodeReader:
    """First node that fits a rule, with same-named tags nested inside it kept in balance."""

    def __init__(self, rule: FieldRule):
        self.rule, self.depth, self.skip = rule, 0, 0
        self.done, self.attribute, self.parts = False, None, None

    def start(self, tag: str, attributes: dict, raw: str) -> None:
        if self.done:
            return
        if self.parts is None:
            if tag != self.rule.tag or any(attributes.get(a) != v for a, v in self.rule.where):
                return
            self.attribute, self.parts = attributes.get(self.rule.take), []
            self.done = self.rule.take not in ("text", "raw")
        self.depth += tag == self.rule.tag
        self.skip += tag in ("script", "style")
        self._raw(raw)

    def end(self, tag: str) -> None:
        if self.done or self.parts is None:
            return
        self._raw(f"</{tag}>")
        self.skip -= tag in ("script", "style") and self.skip > 0
        self.depth -= tag == self.rule.tag
        self.done = self.depth == 0

    def data(self, raw: str, text: str) -> None:
        if self.parts is not None and not self.done:
            if self.rule.take == "raw":
                self.parts.append(raw)
            elif not self.skip:
                self.parts.append(text)

    def _raw(self, text: str) -> None:
        if self.rule.take == "raw":
            self.parts.append(text)

    def value(self):
        if self.parts is None:
            return None
        if self.rule.take not in ("text", "raw"):
            return self.attribute
        return "".join(self.parts) if self.rule.take == "raw" else "".join(self.parts).strip()


class _PageReader(HTMLParser):
    """All fields of a page from one parse. Ampersands are hidden from the parser, so that both engines decode by one rule."""

    def __init__(self, rules: list[FieldRule], ampersand: str):
        super().__init__(convert_charrefs=False)
        self.readers, self.ampersand = [_NodeReader(rule) for rule in rules], ampersand

    def shown(self, text: str | None) -> str | None:
        return text and text.replace(self.ampersand, "&")

    def handle_starttag(self, tag, attrs):
        values = {name: decoded(self.shown(value)) for name, value in attrs}
        for reader in self.readers:
            reader.start(tag, values, self.shown(self.get_starttag_text()))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        for reader in self.readers:
            reader.end(tag)

    def handle_data(self, data):
        raw = self.shown(data)
        text = decoded(raw)
        for reader in self.readers:
            reader.data(raw, text)


def decoded(text: str | None) -> str | None:
    """`decode_entities` for one text in Python."""
    return text and re.sub(_REFERENCE, lambda one: _named(one[0]), text).replace("&amp;", "&")


def _named(reference: str) -> str:
    body = reference[1:-1]
    if not body.startswith("#"):
        return ENTITIES.get(body, reference)
    code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
    windows = 0x80 <= code < 0xA0
    known = 1 <= code <= 0xD7FF or 0xE000 <= code <= 0x10FFFF
    return unescape(f"&#{code};") if windows else chr(code) if known else "\ufffd"


def parsed_fields(html: Column, rules: list[FieldRule]) -> Column:
    """Struct of all fields by an HTML parser in Arrow batches, one parse per page."""
    names = [rule.field for rule in rules]

    def read_one(markup: str | None) -> list[str | None]:
        if markup is None:
            return [None] * len(names)
        ampersand = next(chr(code) for code in range(0xE000, 0xF8FF) if chr(code) not in markup)
        page = _PageReader(rules, ampersand)
        page.feed(markup.replace("&", ampersand))
        page.close()
        return [reader.value() for reader in page.readers]

    @F.pandas_udf(T.StructType([T.StructField(name, T.StringType()) for name in names]))
    def read(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_one(markup) for markup in batch], columns=names, dtype=object)

    return read(html)
