"""Word shingles of many texts at once, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed together up to about so many bytes; a longer text is hashed alone.
CHUNK_BYTES = 2 << 20
_random = np.random.Generator(np.random.PCG64(20240229))
LETTERS = _random.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LETTERS[ord("A") : ord("Z") + 1] = LETTERS[ord("a") : ord("z") + 1]
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACES = _random.integers(1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each run of bytes that are not whitespace; A-Z count as a-z."""
    blank = BLANK[data]
    edges = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(LETTERS[data] * powers(BASE, len(data)), dtype=np.uint64)])
    return starts, mix((sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts])


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than `width` words are one shingle, no words are none."""
    raw = [value.as_buffer() if value.is_valid else b"" for value in texts]
    first, size = 0, 0
    for at, text in enumerate(raw):
        if at > first and size + len(text) > CHUNK_BYTES:
            yield from _sets(raw[first:at], width)
            first, size = at, 0
        size += len(text) + 1
    if first < len(raw):
        yield from _sets(raw[first:], width)


def _sets(raw: list, width: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
    begins = np.cumsum([0] + [len(text) + 1 for text in raw])
    starts, words = word_hashes(data)
    bounds = np.searchsorted(starts, begins)
    count = max(0, len(words) - width + 1)
    rolled = np.zeros(count, dtype=np.uint64)
    for place in range(width):
        rolled += words[place : place + count] * PLACES[place]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            parts = np.append(words[a:b] * PLACES[: b - a], PLACES[-1:] * np.uint64(b - a))
            yield mix(parts.sum(dtype=np.uint64, keepdims=True))
        else:
            yield np.array([], dtype=np.uint64)
