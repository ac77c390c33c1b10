"""Secrets by trigram index: only texts that hold a rule's mandatory trigrams are searched with its pattern.

Each pattern yields a Boolean query over lower-case trigrams. The texts of a block are indexed by the trigrams that the
queries name; postings are intersected and united, and the candidates are verified with the pattern itself. Rules
without a mandatory trigram search every text. A block and its index live in one task, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts are indexed in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Alternatives up to which a piece of a pattern is followed exactly.
EXACT = 64


@dataclass(frozen=True)
class Rule:
    """`group` of a match must have `least` characters; matches that fail are dropped after they were found."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The patterns every scan has.
BASE = (
    Rule("assign", r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[^\s/:@]{1,64}:[^\s/@]{1,64}@"),
)
RULES = BASE + MORE

#: A query is an OR of ANDs of trigrams; None stands for every text.
Query = frozenset[frozenset[str]] | None


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > EXACT:
        return min(a, b, key=len)  # a weaker query keeps every text that the stronger one does
    return simpler(frozenset(x | y for x in a for y in b))


def either(a: Query, b: Query) -> Query:
    return None if a is None or b is None or len(a | b) > EXACT else simpler(a | b)


def simpler(query: frozenset[frozenset[str]]) -> frozenset[frozenset[str]]:
    return frozenset(x for x in query if not any(y < x for y in query))


def of_strings(strings: frozenset[str]) -> Query:
    """Query that holds wherever one of the strings occurs."""
    if any(len(s) < 3 for s in strings):
        return None
    return simpler(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def derive(items: Sequence) -> tuple[frozenset[str] | None, Query]:
    """(strings, query) of a parsed pattern: all strings it matches if they are few, else None; what a match must hold."""
    exact, query, whole = frozenset([""]), None, True
    for kind, value in items:
        strings, needed = piece(kind, value)
        if strings is not None and len(strings) * len(exact) <= EXACT:
            exact = frozenset(a + b for a in exact for b in strings)
            continue
        query, whole = both(query, of_strings(exact)), False
        query = both(query, of_strings(strings) if strings is not None else needed)
        exact = strings if strings is not None else frozenset([""])
    return (exact if whole else None), both(query, of_strings(exact))


def fold(char: int) -> str:
    return chr(char).lower() if char < 128 else chr(char)


def piece(kind, value) -> tuple[frozenset[str] | None, Query]:
    if kind is op.LITERAL and value < 128:
        return frozenset([fold(value)]), None
    if kind is op.IN and all(k is op.LITERAL and v < 128 for k, v in value):
        return frozenset(fold(v) for _, v in value), None
    if kind is op.AT:
        return frozenset([""]), None
    if kind is op.SUBPATTERN:
        return derive(value[3])
    if kind is op.BRANCH:
        parts = [derive(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in parts):
            return frozenset().union(*(strings for strings, _ in parts)), None
        return None, reduce(either, (of_strings(strings) if strings is not None else query for strings, query in parts))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, query = derive(inner)
        if low == 0:
            return (strings | {""} if high == 1 and strings is not None else None), None
        if low == high == 1:
            return strings, query
        return None, of_strings(strings) if strings is not None else query
    return None, None


def trigram_query(pattern: str) -> Query:
    """Boolean trigram query of a pattern, over ASCII lower case; None if no trigram is mandatory."""
    strings, query = derive(parser.parse(pattern))
    return of_strings(strings) if strings is not None else query


class Index:
    """Postings of a block: for every trigram asked for, the sorted numbers of the texts that hold it."""

    fold = np.array([ord(fold(i)) if i < 128 else i for i in range(256)], dtype=np.uint8)

    def __init__(self, trigrams: frozenset[str]):
        self.codes = np.array(sorted((ord(a) << 16) | (ord(b) << 8) | ord(c) for a, b, c in trigrams), dtype=np.uint32)
        self.asked = np.zeros(1 << 24, dtype=bool)
        self.asked[self.codes] = True
        self.postings: dict[int, np.ndarray] = {}

    def build(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """`data` are the texts' UTF-8 bytes, text n from offsets[n] to offsets[n + 1]."""
        found = []
        for start in range(0, max(0, len(data) - 2), BLOCK_BYTES):
            part = self.fold[data[start : start + BLOCK_BYTES + 2]].astype(np.uint32)
            codes = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
            places = np.flatnonzero(self.asked[codes])
            found.append((places + start, codes[places]))
        places = np.concatenate([p for p, _ in found] or [np.array([], dtype=np.int64)])
        codes = np.concatenate([c for _, c in found] or [np.array([], dtype=np.uint32)])
        texts = np.searchsorted(offsets, places, side="right") - 1
        inside = places + 2 < offsets[texts + 1]
        pairs = np.unique(codes[inside].astype(np.int64) * len(offsets) + texts[inside])
        owner, number = pairs // len(offsets), pairs % len(offsets)
        bounds = np.searchsorted(owner, self.codes), np.searchsorted(owner, self.codes, side="right")
        self.postings = {int(c): number[a:b] for c, a, b in zip(self.codes, *bounds, strict=True)}

    def posting(self, trigram: str) -> np.ndarray:
        a, b, c = map(ord, trigram)
        return self.postings[(a << 16) | (b << 8) | c]

    def search(self, query: Query, texts: int) -> np.ndarray:
        if query is None:
            return np.arange(texts)
        hits = [reduce(np.intersect1d, sorted(map(self.posting, alternative), key=len)) for alternative in query]
        return reduce(np.union1d, hits)


def blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for at, length in enumerate(lengths):
        if at > start and size + length > BLOCK_BYTES:
            yield start, at
            start, size = at, 0
        size += length
    if start < len(lengths):
        yield start, len(lengths)


def scan(df: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `spans`: (kind, start, end) of every finding, in code points, end exclusive, by start, then rule.

    Per rule the leftmost non-overlapping matches, of which those too short are dropped. Null texts count as empty; empty
    texts have no findings; rows repeat as in the input.
    """
    schema = f"{df.select(key).schema[0].simpleString().replace(':', ' ', 1)}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    queries = [trigram_query(rule.pattern) for rule in rules]
    trigrams = frozenset(t for query in queries if query for alternative in query for t in alternative)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, index = [re.compile(verifier(rule)) for rule in rules], Index(trigrams)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last in blocks(sizes):
                part = texts.slice(first, last - first)
                raw = [value.as_buffer() for value in part]
                data = np.frombuffer(b"".join(x or b"" for x in raw), dtype=np.uint8)
                index.build(data, np.concatenate([[0], np.cumsum(sizes[first:last])]))
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(last - first)]
                plain: dict[int, str] = {}
                for order, (rule, query, pattern) in enumerate(zip(rules, queries, compiled, strict=True)):
                    for number in index.search(query, last - first).tolist():
                        if number not in plain:
                            plain[number] = part[number].as_py()
                        for match in pattern.finditer(plain[number]):
                            if len(match[rule.group]) >= rule.least:
                                found[number].append((match.start(), order, match.end()))
                rows = [[{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in sorted(row)] for row in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(rows, spans)], names=[key, "spans"])

    return df.select(key, text).mapInArrow(run, schema)


def verifier(rule: Rule) -> str:
    """Pattern with the same findings as the rule's. A lone repeated class finds its maximal runs either way, so the
    least length may be part of the pattern, which then rejects short runs faster."""
    items = parser.parse(rule.pattern)
    if len(items) == 1 and rule.group == 0 and rule.least and items[0][0] is op.MAX_REPEAT and rule.pattern.endswith("]+"):
        return f"{rule.pattern[:-1]}{{{rule.least},}}"
    return rule.pattern
