"""Tokens, keyword hits, n-grams and per-document term counts as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetrace.functions.columns import let

# Letters and digits of every script plus underscore; Java's own \w covers ASCII only.
WORD_PATTERN = r"[\p{L}\p{N}_]+"


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """Case-sensitive words; null and blank text give an empty list, so the row survives."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def is_single_word(word: str) -> bool:
    """True when `word` can equal a token. Phrases with blanks never can and count nothing."""
    return bool(word) and all(c == "_" or unicodedata.category(c)[0] in "LN" for c in word)


def keep_words(token_list: Column, words: Iterable[str]) -> Column:
    """Tokens that belong to `words`, duplicates and order kept."""
    singles = sorted({w for w in words if is_single_word(w)})
    if not singles:
        return _no_strings()
    return F.filter(token_list, lambda t: t.isin(singles))


def phrase_of(words: str) -> str | None:
    """A keyword of several tokens in the form that `phrase_hits` gives; null for single tokens and for none."""
    found = regex.findall(WORD_PATTERN, words)
    return " ".join(found) if len(found) > 1 else None


def phrase_hits(token_list: Column, words: Iterable[str]) -> Column:
    """The phrases among `words` that occur as consecutive tokens, each occurrence once, in text order.

    What stands between the tokens does not matter. Phrases are known by their first token; only where one of those stands
    are the following tokens looked at, once per length of a phrase. Occurrences may overlap.
    """
    phrases = sorted({phrase for phrase in map(phrase_of, words) if phrase})
    if not phrases:
        return _no_strings()
    firsts, lengths = sorted({p.split(" ")[0] for p in phrases}), sorted({p.count(" ") + 1 for p in phrases})

    def found(toks: Column) -> Column:
        starts = F.filter(F.transform(toks, lambda t, i: F.when(t.isin(firsts), i)), lambda i: i.isNotNull())

        def at(i: Column) -> Column:
            fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: i + n <= F.size(toks))
            return F.filter(F.transform(fitting, lambda n: F.array_join(F.slice(toks, i + 1, n), " ")), lambda p: p.isin(phrases))

        return F.flatten(F.transform(starts, at))

    return let(token_list, found)


def drop_words(token_list: Column, words: Iterable[str]) -> Column:
    """Stopword removal that keeps duplicates of the remaining tokens; null list entries go too."""
    unwanted = sorted(set(words))
    return F.filter(token_list, lambda t: ~t.isin(unwanted)) if unwanted else token_list


def restrict_tokens(token_list: Column, words: Iterable[str], placeholder: str | None = None) -> Column:
    """`keep_words`, with a one-word placeholder list where nothing is left."""
    kept = keep_words(token_list, words)
    if placeholder is None:
        return kept
    return let(kept, lambda k: F.when(F.size(k) == 0, F.array(F.lit(placeholder))).otherwise(k))


def joined(token_list: Column) -> Column:
    return F.array_join(token_list, " ")


def word_ngrams(token_list: Column, lo: int, hi: int) -> Column:
    """All n-grams of lo..hi consecutive tokens, joined by blanks."""

    def of_length(toks: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(toks) - n + 1)
        grams = F.transform(starts, lambda i: F.array_join(F.slice(toks, i, n), " "))
        return F.when(F.size(toks) >= n, grams).otherwise(_no_strings())

    return let(token_list, lambda toks: F.concat(*[of_length(toks, n) for n in range(lo, hi + 1)]))


def term_counts(terms: Column) -> Column:
    """array<struct<term, tf>> of one document, without leaving the row.

    The list is sorted once; the distance between the starts of equal runs is the term frequency.
    This costs O(k log k) per document and no shuffle.
    """

    def runs(s: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(positions, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).cast("long").alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(terms) == 0, empty).otherwise(let(F.array_sort(terms), runs))
