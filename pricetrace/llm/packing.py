"""Packing token pieces into windows: repeat counts of length combinations by non-negative least squares.

A document is tokenised once and cut into whole windows and one rest. Rests are binned by length; how often each
shallow combination of bins that fills a window is used comes from a least-squares fit to the histogram, whose size
depends on the window only. The fit is rounded down and what is left is packed greedily, again on the histogram.
Pieces find their place by their running number within their bin, so they never meet before they share a window.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetrace.scratch import Staged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@cache
def rank_encoder(ranks: str):
    """Encoder of a rank file; the same ids as the `tokenizers` file of the same vocabulary for texts without added tokens, at several times its speed."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@cache
def json_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def added_tokens(path: str) -> tuple[str, ...]:
    """Tokens that the `tokenizers` file takes as one id wherever a text holds them; the rank file has none."""
    return tuple(token.content for token in json_encoder(path).get_added_tokens_decoder().values())


#: Characters beyond which a text goes through `tokenizers`: the rank encoder's matcher keeps state per character of a run.
LONG_TEXT = 500_000


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """Ids of a text and the end mark 0. `vocabulary` is the path of the files without `.json` and `.tiktoken`."""
    if len(text) > LONG_TEXT or any(token in text for token in added_tokens(f"{vocabulary}.json")):
        ids = json_encoder(f"{vocabulary}.json").encode(text, add_special_tokens=False).ids
    else:
        ids = rank_encoder(f"{vocabulary}.tiktoken").encode_ordinary(text)
    return np.array([*ids, 0], dtype="<u4")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k")


def cut_pieces(df: DataFrame, key: str, text: str, window: int, unit: int, vocabulary: str, with_ids: bool) -> DataFrame:
    """A row per piece: (key, start, length, ids_crc32, doc_tokens, [ids,] _bin, _task, _rank).

    Whole windows first, then the rest of the document. `_rank` numbers the pieces of a bin inside a task from 0; it is
    the same when the task runs again, as a task's input and order are.
    """
    fields = [df.schema[key].simpleString().replace(":", " ", 1), "start bigint", "length bigint", "ids_crc32 bigint", "doc_tokens bigint"]
    fields += ["ids binary"] * with_ids + ["_bin int", "_task int", "_rank bigint"]
    bins = window // unit

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(bins + 1, dtype=np.int64)
        for batch in batches:
            keys, columns = batch.column(0), {name: [] for name in ("at", "start", "length", "crc", "total", "ids", "bin", "rank")}
            for at, value in enumerate(batch.column(1)):
                ids = token_ids(value.as_py() or "", vocabulary)
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window].tobytes()
                    place = -(-(len(piece) // 4) // unit)
                    row = (at, start, len(piece) // 4, zlib.crc32(piece), len(ids), piece if with_ids else None, place, seen[place])
                    for column, cell in zip(columns.values(), row, strict=True):
                        column.append(cell)
                    seen[place] += 1
            size = len(columns["at"])
            out = [keys.take(pa.array(columns["at"], pa.int64()))] + [pa.array(columns[c], pa.int64()) for c in ("start", "length", "crc", "total")]
            out += [pa.array(columns["ids"], pa.binary())] * with_ids
            out += [pa.array(columns["bin"], pa.int32()), pa.array([task] * size, pa.int32()), pa.array(columns["rank"], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[f.split(" ")[0] for f in fields])

    return df.select(key, text).mapInArrow(cut, ", ".join(fields))


def fillings(bins: int, depth: int) -> np.ndarray:
    """Combinations of 1 to `depth` bins that add up to `bins`, as columns of counts per bin (row 0 is unused)."""
    found: list[list[int]] = []

    def extend(parts: list[int], left: int) -> None:
        if left == 0:
            found.append(parts)
        elif len(parts) < depth:
            for part in range(min(left, parts[-1] if parts else bins), 0, -1):
                if part * (depth - len(parts)) >= left:
                    extend([*parts, part], left - part)

    extend([], bins)
    table = np.zeros((bins + 1, len(found)))
    for column, parts in enumerate(found):
        for part in parts:
            table[part, column] += 1
    return table


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets; at most as many entries are positive as `a` has rows."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    limit = tolerance * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= limit * a.shape[0]:
            break
        active[best] = True
        while active.any():
            chosen = np.flatnonzero(active)
            solved = np.linalg.lstsq(a[:, chosen], b, rcond=None)[0]
            if solved.min() > limit:
                x[:] = 0
                x[chosen] = solved
                break
            low = solved <= limit
            step = min(1.0, float((x[chosen][low] / np.maximum(x[chosen][low] - solved[low], 1e-300)).min()))
            x[chosen] += step * (solved - x[chosen])
            leave = chosen[low & (x[chosen] <= limit)]
            leave = leave if len(leave) else chosen[low][:1]
            x[leave] = 0
            active[leave] = False
    return x


def window_plan(histogram: np.ndarray, depth: int = 4) -> list[tuple[np.ndarray, int]]:
    """[(bins used, repeats)] that together use the histogram (entry n: pieces of n units) exactly; no window overflows."""
    bins, left, plan = len(histogram) - 1, histogram.astype(np.int64).copy(), []
    table = fillings(bins, depth)
    repeats = np.floor(nnls(table, histogram.astype(float)) + 1e-6).astype(np.int64)
    for column in np.flatnonzero(repeats):
        use = table[:, column].astype(np.int64)
        times = int(min(repeats[column], (left[use > 0] // use[use > 0]).min()))
        if times:
            plan.append((use, times))
            left -= use * times
    while left.any():  # the largest piece, then ever the largest that still fits; each turn empties a bin
        use, room = np.zeros(bins + 1, dtype=np.int64), bins
        for size in range(bins, 0, -1):
            use[size] = min(left[size], room // size)
            room -= use[size] * size
        times = int((left[use > 0] // use[use > 0]).min())
        plan.append((use, times))
        left -= use * times
    return plan


def pack(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 1024, unit: int = 8, depth: int = 4,
    vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset): every token of every row in one piece.

    Null texts count as empty; an empty text is its end mark alone. Repeated rows are packed like any others; an empty
    table gives no piece. Sequence ids are gapless from 0, and so are the offsets in a sequence, of at most `window` tokens.
    """
    spark = df.sparkSession
    pieces = Staged(cut_pieces(df, key, text, window, unit, vocabulary or default_vocabulary(), with_ids), "pieces").df
    counts = pieces.groupBy("_task", "_bin").agg(F.count("*").alias("_n"))
    histogram = np.zeros(window // unit + 1, dtype=np.int64)
    for row in counts.groupBy("_bin").agg(F.sum("_n").alias("n")).collect():  # at most one row per bin
        histogram[row["_bin"]] = row["n"]
    slots, base, used = [], 0, np.zeros_like(histogram)
    for use, times in window_plan(histogram, depth):
        slot = 0
        for size in np.flatnonzero(use)[::-1]:
            slots.append((int(size), int(used[size]), int(used[size] + use[size] * times), int(use[size]), slot, base))
            used[size] += use[size] * times
            slot += int(use[size])
        base += times
    # At most two plans per bin, each of fewer than sqrt(2 * bins) different bins: a few thousand rows whatever the input.
    places = spark.createDataFrame(slots, "_bin int, _from bigint, _to bigint, _each bigint, _slot int, _base bigint")
    before = Window.partitionBy("_bin").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = pieces.join(offsets, ["_task", "_bin"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = numbered.alias("p").join(F.broadcast(places.withColumnRenamed("_bin", "_b")), (F.col("p._bin") == F.col("_b")) & inside)
    step = F.col("_rank") - F.col("_from")
    placed = placed.withColumn("sequence_id", F.expr("_base + (_rank - _from) div _each")).withColumn("_slot", F.col("_slot") + step % F.col("_each"))
    earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    located = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    return located.select(key, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces with ids: one row per window, little-endian 32-bit ids without padding."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.reduce(parts, F.lit(b""), lambda all_, part: F.concat(all_, part["ids"])).alias("ids"))
