"""What the operators of this subpackage share: byte-level words, Arrow batches, lineage cuts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from xxhash import xxh64_intdigest

from larkspur.shared import cut, discard, drop_path, scratch_path, shared_dir  # noqa: F401

#: A-Z to a-z; every other byte stays.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A-Z to a-z, and each ASCII byte that is neither a letter nor a digit to a space.
ASCII_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased (bytes.split knows the same six separators)."""
    return text.translate(ASCII_LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return text.translate(ASCII_WORDS).split()


#: A-Z to a-z, and the separators 09-0D to a space.
ASCII_SPACED = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Bytes of a text that are taken apart at a time; only a single longer word is taken whole.
RUN_BYTES = 1 << 20


def runs(text: bytes, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a text, whose only separators are spaces, into runs of whole words: of at most ``most`` bytes, or of one longer word."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > most:
            end = text.rfind(b" ", at, at + most) + 1 or text.find(b" ", at + most) + 1 or end
        yield at, end
        at = end


def edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between spaces."""
    found = np.flatnonzero(np.diff(np.concatenate([[True], np.frombuffer(text, np.uint8) == 32, [True]])))
    return found[::2], found[1::2]


def word_hashes(text: bytes, seed: int = 42, most: int = RUN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and XXH64 hashes of the words of a text whose only separators are spaces.

    Of a corpus of n different words any two have one hash with a chance of about n * n / 2 ** 65. Beside the result it holds what
    one run needs; a word is hashed where it stands.
    """
    starts, stops, found = [], [], []
    for at, end in runs(text, most):
        if end - at > most:
            stop = end - (text[end - 1] == 32)
            starts.append(np.array([at]))
            stops.append(np.array([stop]))
            found.append(np.array([xxh64_intdigest(memoryview(text)[at:stop], seed)], np.uint64))
            continue
        part = text[at:end]
        start, stop = edges(part)
        starts.append(start + at)
        stops.append(stop + at)
        found.append(np.fromiter(map(xxh64_intdigest, part.split(), repeat(seed)), np.uint64, len(start)))
    none = np.zeros(0, np.int64)
    return (np.concatenate(starts), np.concatenate(stops), np.concatenate(found)) if found else (none, none, none.astype(np.uint64))


def hashed(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose separators are spaces: all joined, starts, ends and hashes of the words in that, and where each
    text's words begin among them, with the count of all."""
    joined = b" ".join(texts)
    begin, end, found = word_hashes(joined)
    return joined, begin, end, found, np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in texts)]))


class Numbered:
    """An open-addressing table from 64-bit hashes to numbers, looked up for whole arrays."""

    def __init__(self, bits: int = 12):
        self.clear(bits)

    def clear(self, bits: int = 12) -> None:
        self.bits, self.count = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        mask = (1 << self.bits) - 1
        out, left, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            values = self.values[slot]
            same = self.keys[slot] == keys[left]
            done = same & (values >= 0)
            out[left[done]] = values[done]
            on = ~same & (values >= 0)
            left, slot = left[on], (slot[on] + 1) & mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in it."""
        if (self.count + len(keys)) * 2 > len(self.keys):
            used = self.values >= 0
            old = self.keys[used], self.values[used]
            self.clear(max(self.bits + 1, int(4 * (len(old[0]) + len(keys))).bit_length()))
            self.add(*old)
        self.count += len(keys)
        mask, slot = (1 << self.bits) - 1, (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.values[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            lost = self.keys[slot] != keys  # another key took or holds the slot
            # a slot that two keys wanted holds the last one's key and value
            keys, values, slot = keys[lost], values[lost], (slot[lost] + 1) & mask


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 byte strings; null becomes the empty one."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


#: Bytes of an Arrow batch between Spark and a Python worker, at most; it is held on both sides, by each task.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of Arrow batches to BATCH_BYTES, so that long texts don't fill the memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([bkmgtp]?)b?", spark.conf.get(key).lower()).groups()
    limit = int(number) << 10 * "bkmgtp".index(unit or "b")
    if not 0 < limit <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage. Spark deletes shuffles and broadcasts when the driver finds that nothing refers to them any more, by itself perhaps
    half an hour later; the rounds of an iteration leave many, on the executors' disks and in the driver's memory."""
    spark.sparkContext._jvm.java.lang.System.gc()


def gathered(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """``df``, of at most about ``rows`` narrow rows, in no more partitions than these fill: a shuffle's many small
    partitions are read by fewer tasks, and a cut of them writes fewer files."""
    return df.coalesce(8 + rows // each)


def regathered(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """As :func:`gathered`, by a shuffle of the narrow rows: for the few rows that remain of tasks with much work, which stay as many as they are."""
    return df.repartition(8 + rows // each)


def _quarter(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows of many input splits, dealt evenly to a quarter of the shuffle partitions: a cut of them then writes
    fewer and larger files."""
    return df.repartition(_quarter(df))


def fewer(df: DataFrame) -> DataFrame:
    """Narrow rows that a shuffle has made, read by a quarter of its tasks, for the same reason."""
    return df.coalesce(_quarter(df))


def fields(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the table can clash with what an operator adds."""
    bounded_batches(df.sparkSession)
    return df.select(*[df[x] for x in names])
