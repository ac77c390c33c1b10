"""Toxicity as multiple-instance learning: a document is toxic if any of its sentences is.

Only documents are labelled. A sentence's probability is logistic in its word and letter-sequence features, a document's
is the noisy-or of its sentences, 1 - prod(1 - p), and the weights are fitted to the document labels through it. The
fitted model scores sentences, so it also says which ones offend.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"\w+")
#: Words whose weight a task remembers.
MEMORY = 300_000
#: Feature numbers the fit handles at once, and counts by which it tells rare features.
BLOCK, HASHES = 1 << 18, 1 << 24


@dataclass(frozen=True)
class Fit:
    """`sample_rows` bounds the labelled documents the fit sees, `features` the size of the model."""

    sample_rows: int = 5_000
    features: int = 4_096
    least_documents: int = 3
    rounds: int = 300
    penalty: float = 1e-4


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def features(word: str) -> set[str]:
    """The word itself and its runs of four and five letters, with the word's ends marked."""
    marked = f"<{word}>"
    return {marked, *(marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1))}


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each sentence that has a word."""
    for found in SENTENCE.finditer(text):
        words = TOKEN.findall(found[0].lower())
        if words:
            yield found.start(), found.end(), words


@dataclass
class Bags:
    """Documents as sentences of numbered features, flat: of each document the sentences, of each sentence the columns, then all columns in a row."""

    sentences: np.ndarray
    widths: np.ndarray
    columns: np.ndarray


@dataclass
class Texts:
    """Documents as sentences of numbered words; four bytes a word of text, and each different word once."""

    words: dict[str, int] = field(default_factory=dict)
    tokens: array = field(default_factory=lambda: array("i"))
    lengths: array = field(default_factory=lambda: array("i"))
    sentences: array = field(default_factory=lambda: array("i"))

    def add(self, text: str) -> None:
        before = len(self.lengths)
        for _, _, words in sentences(text):
            self.tokens.extend([self.words.setdefault(w, len(self.words)) for w in words])
            self.lengths.append(len(words))
        self.sentences.append(len(self.lengths) - before)

    def documents(self) -> Iterator[np.ndarray]:
        """The numbers of each document's different words."""
        tokens = np.asarray(self.tokens)
        ends = np.append(0, np.cumsum(self.lengths, dtype=np.int64))[np.cumsum(self.sentences, dtype=np.int64)]
        for start, end in zip(np.append(0, ends), ends):
            yield np.unique(tokens[start:end])


@dataclass
class Lists:
    """One list of numbers per word, one after the other."""

    starts: np.ndarray
    sizes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, lists: Iterator[list[int]]) -> Lists:
        values, ends = array("i"), array("q", [0])
        for found in lists:
            values.extend(found)
            ends.append(len(values))
        return cls(np.asarray(ends)[:-1], np.diff(ends).astype(np.int32), np.asarray(values))

    def joined(self, words: np.ndarray) -> np.ndarray:
        """The lists of `words`, end to end."""
        sizes = self.sizes[words]
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        return self.values[np.repeat(self.starts[words] - before, sizes) + np.arange(sizes.sum())]


def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of entries whose sizes add up to `BLOCK` at most, or of one larger entry."""
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        yield start, end
        start = end


def noisy_or_fit(bags: Bags, labels: np.ndarray, size: int, fit: Fit) -> tuple[np.ndarray, float]:
    """Weights and bias with the least cross-entropy of noisy-or over each bag of sentences, by full-batch Adam."""
    count, widths = len(bags.sentences), bags.widths
    sentence_of = np.repeat(np.arange(count, dtype=np.int32), bags.sentences)
    place = np.append(0, np.cumsum(widths, dtype=np.int64))
    runs = [(start, end, place[start], place[end]) for start, end in blocks(widths)]
    value = np.append(np.zeros(size), -4.0)
    mean, spread = np.zeros(size + 1), np.zeros(size + 1)
    truth = labels[sentence_of]
    z = np.zeros(len(widths))
    for turn in range(1, fit.rounds + 1):
        for start, end, first, last in runs:
            rows = np.repeat(np.arange(end - start), widths[start:end])
            z[start:end] = np.clip(value[-1] + np.bincount(rows, value[bags.columns[first:last]], end - start), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(sentence_of, np.log1p(np.exp(z)), count)  # -log of no sentence being toxic
        pull = -1 / np.maximum(np.expm1(np.clip(none, 1e-9, 50)), 1e-9)
        slope = np.where(truth == 1, p * pull[sentence_of], p) / count
        gradient = np.zeros(size + 1)
        for start, end, first, last in runs:  # added one by one, so the sums are those of one block
            np.add.at(gradient, bags.columns[first:last].astype(np.intp), np.repeat(slope[start:end], widths[start:end]))
        gradient[-1] = slope.sum()
        gradient[:-1] += fit.penalty * value[:-1]
        mean, spread = 0.9 * mean + 0.1 * gradient, 0.99 * spread + 0.01 * gradient**2
        value -= 0.1 * (mean / (1 - 0.9**turn)) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
    return value[:-1], float(value[-1])


def frequent_features(texts: Texts, labels: np.ndarray, least: int) -> dict[str, tuple[int, int]]:
    """(documents of label 0, of label 1) of the features in `least` documents or more.

    Most features are rare, so a count per hash, which is never below that of a feature, first says which are worth a number.
    """
    hashes = Lists.of([hash(f) % HASHES for f in features(word)] for word in texts.words)
    counts, enough = np.zeros(HASHES, np.uint8), min(least, 255)
    for words in texts.documents():
        seen = np.unique(hashes.joined(words))
        counts[seen] += counts[seen] < enough
    del hashes
    number: dict[str, int] = {}

    def numbered(word: str) -> list[int]:
        return [number.setdefault(f, len(number)) for f in features(word) if counts[hash(f) % HASHES] >= enough]

    lists = Lists.of(map(numbered, texts.words))
    seen = np.zeros((2, len(number)), np.int64)
    for words, label in zip(texts.documents(), labels, strict=True):
        seen[label, np.unique(lists.joined(words))] += 1
    return {name: (n0, n1) for name, n0, n1 in zip(number, *seen.tolist(), strict=True) if n0 + n1 >= least}


def train(rows: Iterable[tuple[str, int]], fit: Fit = Fit()) -> Model:
    """Model from texts and their labels. Features are those whose documents differ most between the labels.

    The rows are read once. Of their texts four bytes a word are kept, then two more for each chosen feature of each word.
    """
    texts, labels = Texts(), array("b")
    for text, label in rows:
        texts.add(text)
        labels.append(label)
    truth = np.array(labels, dtype=int)
    n0, n1 = int((truth == 0).sum()), int((truth == 1).sum())
    if not n0 or not n1:
        return Model()
    seen = frequent_features(texts, truth, fit.least_documents)

    def contrast(name: str) -> float:
        a, b = seen[name][1] / n1, seen[name][0] / n0
        return (a - b) ** 2 / (a + b)

    chosen = heapq.nsmallest(fit.features, seen, key=lambda name: (-contrast(name), name))
    number = {name: i for i, name in enumerate(chosen)}
    del seen
    known = Lists.of([number[f] for f in features(word) if f in number] for word in texts.words)
    tokens, lengths = np.asarray(texts.tokens), np.asarray(texts.lengths)
    sizes = known.sizes[tokens]
    columns = np.empty(sizes.sum(), np.min_scalar_type(len(chosen)))
    place = 0
    for start, end in blocks(sizes + 1):
        found = known.joined(tokens[start:end])
        columns[place : (place := place + len(found))] = found
    bags = Bags(np.asarray(texts.sentences), np.add.reduceat(sizes, np.cumsum(lengths) - lengths), columns)
    del texts, tokens, sizes
    weights, bias = noisy_or_fit(bags, truth, len(chosen), fit)
    return Model({name: float(w) for name, w in zip(chosen, weights, strict=True) if abs(w) > 1e-3}, bias)


def held_out(key: Column) -> Column:
    """Rows kept from learning: CRC-32 of the key as text divisible by 5. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_model(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit: Fit = Fit()) -> Model:
    """Model from the labelled documents that are not held out, at most `fit.sample_rows` of them, chosen by a hash of the key.

    Only the sample's keys and the finished weights pass through the driver; the texts of the sample meet in one task, which
    reads them batch by batch.
    Null labels and keys are left out. Without labels of both kinds every sentence is taken as harmless.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    sample = known.groupBy(key).agg(F.max(label).alias("_label")).orderBy(F.xxhash64(key), key).limit(fit.sample_rows)
    rows = documents.select(key, text).join(F.broadcast(sample), key).groupBy(key).agg(F.min(F.coalesce(text, F.lit(""))).alias("_text"), F.max("_label").alias("_label"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((text.as_py(), int(label.as_py() > 0)) for batch in batches for text, label in zip(batch["_text"], batch["_label"], strict=True))
        model = train(pairs, fit)
        names, weights = ["", *model.weights], [model.bias, *model.weights.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(weights, pa.float64())], names=["feature", "weight"])

    ordered = rows.repartition(1).sortWithinPartitions(key)
    found = ordered.mapInArrow(learn, "feature string, weight double").collect()  # at most fit.features + 1 rows
    weights = {row["feature"]: row["weight"] for row in found}
    bias = weights.pop("", Model.bias)
    return Model(weights, bias)


class Scorer:
    """Scores texts with a model and remembers the weights of words it has met."""

    def __init__(self, model: Model):
        self.model, self.memory = model, {}

    def weight(self, word: str) -> float:
        if word not in self.memory:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[word] = self.model.word(word)
        return self.memory[word]

    def read(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and (start, end, score) of each sentence."""
        quiet, found = 0.0, []
        for start, end, words in sentences(text):
            z = min(max(self.model.bias + sum(map(self.weight, words)), -500.0), 500.0)
            quiet += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
            found.append((start, end, 1 / (1 + math.exp(-z))))
        return -math.expm1(-quiet), found


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """`key`, `score` (0 to 1) and `offending`: (start, end, score) of the sentences at or above `threshold`, in code points.

    A null, empty or wordless text has score 0. Rows repeat as in the input; the whole text is read.
    """
    fields = "array<struct<start: bigint, end: bigint, score: double>>"
    schema = f"{df.select(key).schema[0].simpleString().replace(':', ' ', 1)}, score double, offending {fields}"
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            totals, bad = [], []
            for value in batch.column(1):
                total, found = scorer.read(value.as_py() or "")
                totals.append(total)
                bad.append([{"start": s, "end": e, "score": p} for s, e, p in found if p >= threshold])
            columns = [batch.column(0), pa.array(totals, pa.float64()), pa.array(bad, spans)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "score", "offending"])

    return df.select(key, text).mapInArrow(run, schema)


def keep_harmless(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of `df`, unchanged, whose score is below `threshold`; null, empty and wordless texts stay."""
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            keep = [scorer.read(value.as_py() or "")[0] < threshold for value in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
