"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader (FTRL-proximal) updates.

A text becomes space-separated tokens. Features are the hashed tokens and pairs of neighbours, and the same over the
tokens' shapes (letter case, and all trailing punctuation), with a mark for a token equal to the one before it.
A feature's value is its share of the text's features times ``SCALE``, so long and short texts weigh alike.

Training reads a bounded sample of labelled rows (``sample`` documents, those with the smallest id hashes): their
features are made on the executors, and one task runs the updates over them in id-hash order, ``epochs`` times. The model is
one float32 vector of ``2 ** BITS`` weights, whatever the size of the corpus. Scores are sparse dot products.

Nulls and empty texts: scored by the bias alone. Long texts: a text is held whole in its task with about 60 bytes a word; its features are at most ``2 ** BITS``. Ties: documents with equal id hashes are ordered by id. Labels that are null, or have a null id, teach nothing; of several labels
for an id the smallest counts, of several texts the one with the smallest features. Repeated rows come back as often as
they occur. No labels: every score is 0.5. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from string import ascii_lowercase, ascii_uppercase, digits, punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import RUN_BYTES, as_bytes, bounded_batches, fields, hashed, slices

BITS = 18
SCALE = 24.0
THRESHOLD = 0.3
#: Stands for no feature.
NONE = (1 << BITS) + 1
_MARKS = punctuation.encode()
_SPACED = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_UPPER, _LOWER, _DIGIT, _PUNCTUATION = (np.isin(np.arange(256), list(x.encode())) for x in (ascii_uppercase, ascii_lowercase, digits, punctuation))


def _before(kinds: list[np.ndarray], data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """How many bytes of each kind lie before each place (places sorted), a block of bytes at a time."""
    out, carried = [np.zeros(len(at), np.int64) for _ in kinds], [0] * len(kinds)
    for low in range(0, max(1, len(data)), RUN_BYTES):
        part = data[low : low + RUN_BYTES]
        here = slice(np.searchsorted(at, low, side="right") if low else 0, np.searchsorted(at, low + len(part), side="right"))
        for k, kind in enumerate(kinds):
            total = np.zeros(len(part) + 1, np.int64)
            np.cumsum(kind[part], out=total[1:])
            out[k][here] = carried[k] + total[at[here] - low]
            carried[k] += int(total[-1])
    return out


def shapes(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word's shape: the case of its ASCII letters (none, lower, capital, upper, mixed; digits alone), and
    the ASCII punctuation that it ends in, up to four bytes as they are and more by their hash."""
    data = np.frombuffer(text, np.uint8)
    if not len(begin):
        return np.zeros(0, np.uint64)
    kinds = [_UPPER, _LOWER, _DIGIT]
    upper, lower, figures = (x[1::2] - x[::2] for x in _before(kinds, data, np.stack([begin, end], axis=1).ravel()))
    capital = _UPPER[data[begin]]
    case = np.select([(upper == 0) & (lower > 0), (upper > 1) & (lower == 0), capital & (upper == 1), (upper > 0) & (lower > 0), figures > 0], [1, 2, 3, 4, 5], 0)
    tail, on = np.zeros(len(begin), np.uint64), np.ones(len(begin), bool)
    for k in range(1, 5):
        byte = data[np.maximum(end - k, 0)]
        on &= (end - k >= begin) & _PUNCTUATION[byte]
        tail = tail * np.uint64(257) + np.where(on, byte.astype(np.uint64) + np.uint64(1), np.uint64(0))
    on &= (end - 5 >= begin) & _PUNCTUATION[data[np.maximum(end - 5, 0)]]
    for k in np.flatnonzero(on).tolist():
        word = text[begin[k] : end[k]]
        tail[k] = xxh64_intdigest(word[len(word.rstrip(_MARKS)) :], 7)
    return tail * np.uint64(8) + case.astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


class Featurizer:
    """Hashed features of texts."""

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all texts' tokens, a row for each token: itself, its shape, and the pair with the next token and
        its shape (``NONE`` at a text's last token); and where each text's rows begin, with the count of all."""
        joined, begin, end, word, stops = hashed([x.translate(_SPACED) for x in texts])
        kind, step = shapes(joined, begin, end), np.uint64(0x100000001B3)
        out = np.full((len(word), 4), NONE, np.int32)
        out[:, 0], out[:, 1] = _mix(word), _mix(kind + np.uint64(1 << 50))
        if len(word) > 1:
            pair = word[:-1] * step + word[1:]
            pair[word[:-1] == word[1:]] = np.uint64(7)
            out[:-1, 2], out[:-1, 3] = _mix(pair ^ np.uint64(1 << 62)), _mix((kind[:-1] * step + kind[1:]) ^ np.uint64(1 << 61))
            last = stops[1:][stops[1:] > stops[:-1]] - 1
            out[last, 2:] = NONE
        return out, stops


def features(found: np.ndarray) -> np.ndarray:
    """The features of one text's rows, with repeats."""
    return found[found != NONE]


def margins(weights: np.ndarray, found: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The sparse dot product of each text; the last weight is the bias, ``NONE`` weighs nothing."""
    total = np.concatenate([[0.0], np.cumsum(np.append(weights, np.float32(0))[found].sum(axis=1, dtype=np.float64))])
    many = np.maximum(4 * np.diff(stops) - 2, 1)
    return float(weights[-1]) + SCALE * (total[stops[1:]] - total[stops[:-1]]) / many


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; the bias is coordinate ``2 ** BITS``."""

    def __init__(self, alpha: float = 0.5, beta: float = 0.05, l1: float = 0.002, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, features binary: distinct int32 features, then their float32 values)."""
    featurizer = Featurizer()
    for batch in slices(batches, 256):
        rows = []
        every, stops = featurizer(as_bytes(batch.column(2)))
        for a, b in pairwise(stops.tolist()):
            found = features(every[a:b])
            at, many = np.unique(found, return_counts=True)
            rows.append(at.astype("<i4").tobytes() + (SCALE * many / max(1, len(found))).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["id", "label", "features"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, seen = Ftrl(), 0
    for batch in batches:
        for label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            half = len(raw) // 2
            at = np.r_[np.frombuffer(raw[:half], "<i4").astype(np.int64), 1 << BITS]
            model.update(at, np.r_[np.frombuffer(raw[half:], "<f4").astype(np.float64), 1.0], label)
            seen += 1
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000, epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", where=None) -> np.ndarray:
    """Weights from the labelled rows of ``docs``.

    sample: at most so many labelled documents are read, those with the smallest hashes of their id.
    where: a condition on ``id`` that says which labels may be learnt.
    """
    bounded_batches(docs.sparkSession)
    ids = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label is not null")
    if where is not None:
        ids = ids.where(where)
    ids = ids.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    joined = texts.join(F.broadcast(ids), "id").select("id", "label", "text")  # ``sample`` ids at most
    kind = joined.schema["id"].dataType.simpleString()
    made = joined.mapInArrow(_sparse, f"id {kind}, label int, features binary").groupBy("id").agg(F.min("label").alias("label"), F.min("features").alias("features"))
    rows = made.select(F.explode(F.array(*[F.lit(k) for k in range(epochs)])).alias("epoch"), F.xxhash64("id").alias("order"), "id", "label", "features")
    fitted = rows.repartition(1).sortWithinPartitions("epoch", "order", "id").select("label", "features").mapInArrow(_fit, "weights binary").collect()
    return np.frombuffer(fitted[0][0], "<f4") if fitted else np.zeros((1 << BITS) + 1, np.float32)


def _scores(weights: np.ndarray, texts: list[bytes], featurizer: Featurizer) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins(weights, *featurizer(texts)), -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer()
        for batch in slices(batches, 256):
            found = _scores(shared.value, as_bytes(batch.column(1)), featurizer)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    narrow = fields(docs, id_col, text_col)
    return narrow.mapInArrow(run, f"doc_id {narrow.schema[0].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer()
        for batch in slices(batches, 256):
            good = _scores(shared.value, as_bytes(batch.column(at)), featurizer) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
