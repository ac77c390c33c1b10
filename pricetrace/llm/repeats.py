"""Repeated passages by a depth-limited radix sort of all suffixes.

Only the first `depth` bytes of a suffix count, and only groups of equal ones matter, so the sort goes digit by digit from
the front and drops a suffix as soon as it is alone. A digit is a block of bytes, known by its hash. The first pass keeps
the suffixes of a run together: every window of `depth` bytes names its digit with the smallest hash (equal windows name
the same one), and all windows that name one place form a chunk. Where that digit is alone in the corpus the whole
chunk is. Chunks that are equal as a whole repeat with all their windows; only those that share their digit with
different chunks, at the ends of passages, are sorted on: first in blocks of neighbouring windows, by the bytes that all
windows of a block have, then, where blocks agree in these but not as a whole, window by window to the full depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrace.llm.shingles import BASE, INVERSE, mix, powers
from pricetrace.scratch import Staged

#: Texts are sorted together up to about so many bytes; a longer text is cut, with overlap, at so many.
CHUNK_BYTES = 1 << 20
_random = np.random.Generator(np.random.PCG64(7))
BYTES = _random.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEPS = _random.integers(1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Depth:
    """Windows of `depth` bytes; `digit` is the digit of the first pass, a power of two, `block` the windows of a block."""

    depth: int = 200
    digit: int = 64
    block: int = 8


def digit_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each position on; `size` must be a power of two."""
    out, width = BYTES[data], 1
    while width < size:
        out = out[:-width] * STEPS[width.bit_length()] + out[width:]
        width *= 2
    return mix(out)


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out if width == size else np.minimum(out[: len(out) - (size - width)], out[size - width :])


def prefix_sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(BYTES[data] * powers(BASE, len(data)), dtype=np.uint64)])


def chunks(data: np.ndarray, ends: np.ndarray, spec: Depth) -> tuple[np.ndarray, ...]:
    """(digit hash, chunk hash, first window, windows, place of the digit after it) of every chunk; `ends` are the ends of the texts in `data`."""
    if len(data) < spec.depth:
        return (np.array([], dtype=np.uint64),) * 2 + (np.array([], dtype=np.int64),) * 3
    hashes = digit_hashes(data, spec.digit)
    ranked = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    named = (sliding_least(ranked, spec.depth - spec.digit + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(named))
    inside = starts + spec.depth <= ends[np.searchsorted(ends, starts, side="right")]
    starts, named = starts[inside], named[inside]
    if not len(starts):
        return (np.array([], dtype=np.uint64),) * 2 + (np.array([], dtype=np.int64),) * 3
    cut = np.flatnonzero((np.diff(named) != 0) | (np.diff(starts) != 1)) + 1
    first, last = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    place = named[np.concatenate([[0], cut])]
    sums, back = prefix_sums(data), powers(INVERSE, len(data))
    whole = mix((sums[last + spec.depth] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    return hashes[place], whole, first, last - first + 1, place - first


def find_chunks(docs: DataFrame, spec: Depth) -> DataFrame:
    """(node, same, digit, chunk, start, windows, lead) per chunk of rows (node, same, text); starts count from the text's first byte."""
    schema = f"{docs.select('node').schema[0].simpleString().replace(':', ' ', 1)}, same bigint, digit bigint, chunk bigint, start bigint, windows int, lead int"

    def jobs(texts: list) -> Iterator[tuple[list[tuple[int, int]], bytes, list[int]]]:
        """(parts (text, offset), their bytes, their ends)"""
        parts, data, ends = [], bytearray(), []
        for number, text in enumerate(texts):
            for offset in range(0, max(1, len(text) - spec.depth + 1), CHUNK_BYTES):
                piece = text[offset : offset + CHUNK_BYTES + spec.depth - 1]
                if data and len(data) + len(piece) > CHUNK_BYTES:
                    yield parts, bytes(data), ends
                    parts, data, ends = [], bytearray(), []
                if len(piece) >= spec.depth:
                    parts.append((number, offset - len(data)))
                    data += piece
                    ends.append(len(data))
        if data:
            yield parts, bytes(data), ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [memoryview(value.as_buffer()) if value.is_valid else b"" for value in batch.column("text")]
            for parts, data, ends in jobs(texts):
                bounds = np.array([*ends, np.iinfo(np.int64).max])
                digit, chunk, first, windows, lead = chunks(np.frombuffer(data, dtype=np.uint8), bounds, spec)
                owner = np.searchsorted(bounds, first, side="right")
                numbers, shifts = np.array([p for p, _ in parts])[owner], np.array([s for _, s in parts])[owner]
                picked = pa.array(numbers, pa.int64())
                columns = [batch.column("node").take(picked), batch.column("same").take(picked), pa.array(digit.view(np.int64)), pa.array(chunk.view(np.int64))]
                columns += [pa.array(first + shifts, pa.int64()), pa.array(windows.astype(np.int32)), pa.array(lead.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "same", "digit", "chunk", "start", "windows", "lead"])

    return docs.select("node", "same", "text").mapInArrow(run, schema)


def opened(rows: DataFrame, schema: str, read: Callable[[np.ndarray, list[dict]], list[np.ndarray]]) -> DataFrame:
    """`node`, `same` and the columns that `read` makes of each row's bytes and parts; rows have (node, same, text, parts)."""
    names = ["node", "same", *[field.split(" ")[0] for field in schema.split(", ")]]
    types = [pa.int32() if field.endswith(" int") else pa.int64() for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                last, made, owner = min(batch.num_rows, first + 64), [], []
                for at in range(first, last):
                    data = np.frombuffer(batch.column("text")[at].as_buffer(), dtype=np.uint8)
                    made.append(read(data, batch.column("parts")[at].as_py()))
                    owner.append(np.full(len(made[-1][0]), at))
                own = pa.array(np.concatenate(owner))
                columns = [batch.column("node").take(own), batch.column("same").take(own)]
                columns += [pa.array(np.concatenate(column), kind) for column, kind in zip(zip(*made, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"{rows.select('node').schema[0].simpleString().replace(':', ' ', 1)}, same bigint, {schema}")


def block_reader(spec: Depth) -> Callable[[np.ndarray, list[dict]], list[np.ndarray]]:
    """(digit, place, core, content, start, windows) of the blocks of chunks.

    `place` is the block's distance from the chunk's digit, `content` the hash of all bytes of its windows here, `core` that
    of the bytes which every window of such a block has: windows of blocks with different cores are different.
    """
    back, core = powers(INVERSE, 4 * spec.depth), spec.depth - spec.block + 1

    def read(data: np.ndarray, parts: list[dict]) -> list[np.ndarray]:
        made = []
        for part in parts:
            begin, count, lead = part["start"], part["windows"], part["lead"]
            sums = prefix_sums(data[begin : begin + count + spec.depth - 1])
            places = (lead - np.arange(count)) // spec.block
            a = np.concatenate([[0], np.flatnonzero(places[1:] != places[:-1]) + 1])
            b = np.append(a[1:], count)
            inner = lead - places[a] * spec.block
            content = mix((sums[b - 1 + spec.depth] - sums[a]) * back[a] + (b - a).astype(np.uint64))
            shared = mix((sums[inner + core] - sums[inner]) * back[inner])
            made.append((np.full(len(a), part["digit"]), places[a], shared.view(np.int64), content.view(np.int64), begin + a, b - a))
        return [np.concatenate(column) for column in zip(*made, strict=True)]

    return read


def window_reader(spec: Depth) -> Callable[[np.ndarray, list[dict]], list[np.ndarray]]:
    """(start, hash) of the windows of blocks."""
    back = powers(INVERSE, 4 * spec.depth)

    def read(data: np.ndarray, parts: list[dict]) -> list[np.ndarray]:
        starts, hashes = [], []
        for part in parts:
            some = np.arange(part["windows"])
            sums = prefix_sums(data[part["start"] : part["start"] + len(some) + spec.depth - 1])
            starts.append(part["start"] + some)
            hashes.append(mix((sums[some + spec.depth] - sums[some]) * back[some]).view(np.int64))
        return [np.concatenate(starts), np.concatenate(hashes)]

    return read


def repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """One pass: the rows whose digit, the value of the columns, occurs at least twice."""
    groups = rows.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1").select(*columns)
    return rows.join(groups, [*columns])


def repeated_spans(df: DataFrame, spec: Depth = Depth(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, same, start, windows) of the windows that also start anywhere else; `same` is the text's hash."""
    docs = df.select(F.col(key).alias("node"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))
    found = Staged(find_chunks(docs, spec), "chunks")
    shared = Staged(repeated(found.df, "digit"), "shared-digits")
    found.discard()
    one = F.first(F.struct("node", "same", "start", "windows", "lead")).alias("one")
    kinds = Staged(shared.df.groupBy("digit", "chunk").agg(F.count("*").alias("n"), one), "chunk-kinds")
    span = ["node", "same", "start", "windows"]
    whole = Staged(shared.df.join(kinds.df.where("n > 1").select("digit", "chunk"), ["digit", "chunk"]).select(*span), "whole-chunks").df
    shared.discard()
    long = docs.where(F.octet_length("text") >= spec.depth)
    fits = F.col("m.node").eqNullSafe(F.col("d.node")) & (F.col("m.same") == F.col("d.same"))

    def with_texts(pieces: DataFrame, *columns: str) -> DataFrame:
        """One row per text with its pieces; a row that stands for equal ones meets each of them."""
        lists = pieces.groupBy("node", "same").agg(F.collect_set(F.struct(*columns)).alias("parts"))
        return long.alias("d").join(lists.alias("m"), fits).select("d.node", "d.same", "d.text", "m.parts")

    mixed = repeated(kinds.df.select("digit", "one.*"), "digit")
    fields = "digit bigint, place int, core bigint, content bigint, start bigint, windows int"
    blocks = Staged(opened(with_texts(mixed, "start", "windows", "lead", "digit"), fields, block_reader(spec)), "blocks")
    kinds.discard()
    group = ["digit", "place", "core"]
    one = F.first(F.struct(*span)).alias("one")
    groups = Staged(repeated(blocks.df, *group).groupBy(*group, "content").agg(F.count("*").alias("n"), one), "block-kinds")
    content = ["digit", "place", "content"]
    equal = Staged(blocks.df.join(groups.df.where("n > 1").select(*content), content).select(*span), "equal-blocks").df
    blocks.discard()
    apart = repeated(groups.df.select(*group, "one.*"), *group)
    windows = Staged(opened(with_texts(apart, "start", "windows"), "start bigint, hash bigint", window_reader(spec)), "windows").df
    groups.discard()
    single = repeated(windows, "hash").select("node", "same", "start", F.lit(1).alias("windows"))
    return whole.unionByName(equal).unionByName(single)


def remove_repeats(df: DataFrame, spec: Depth = Depth(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) per row, without the bytes that repeated windows cover.

    `kept` are the remaining bytes (binary: a cut may fall inside a character). Null texts count as empty; texts shorter
    than the depth lose nothing; rows with equal keys and texts are each other's repeats. An empty table stays empty.
    """
    spans = repeated_spans(df, spec, key, text).groupBy("node", "same").agg(F.collect_list(F.struct("start", "windows")).alias("parts"))
    docs = df.select(F.col(key).alias("node"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))
    fits = F.col("m.node").eqNullSafe(F.col("d.node")) & (F.col("m.same") == F.col("d.same"))
    rows = docs.alias("d").join(spans.alias("m"), fits, "left").select("d.node", "d.text", "m.parts")
    kind = df.select(key).schema[0].simpleString().replace(":", " ", 1)
    schema = f"{kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value, parts in zip(batch.column("text"), batch.column("parts"), strict=True):
                raw = value.as_buffer() if value.is_valid else b""
                size = len(raw)
                if parts.is_valid:
                    starts = np.asarray(parts.values.field("start"))
                    ends = starts + np.asarray(parts.values.field("windows")) + spec.depth - 1
                    depth = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
                    gone = np.cumsum(depth)[:size] > 0
                    left = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                    runs = int(gone[:1].sum() + (np.diff(gone.astype(np.int8)) == 1).sum())
                else:
                    left, runs = bytes(raw), 0
                out.append((size, size - len(left), runs, hashlib.sha256(left).hexdigest(), left))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("node"), *columns], names=[f.split(" ")[0] for f in schema.split(", ")])

    return rows.mapInArrow(run, schema)
