"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of other characters, A-Z lower-cased. A window is ``span`` consecutive words
of a benchmark item; an item with fewer words is one window. A document is hit where a window occurs in it.

Winnowing: hash every run of ``GRAM`` words and keep, of each ``span - GRAM + 1`` neighbours, the smallest (the last of equal ones).
Which one a window keeps depends on that window's words alone, so a shared span of ``span`` words always shares a kept
hash. Items shorter than ``span`` words are looked for by the hash of all their words, kept at every position.

Fingerprints of windows. A window's fingerprint is the 128-bit BLAKE2 digest of its words; two windows are the same where their digests are. The
benchmark's windows become a table (digest, whose they are) that stays distributed. A document's kept hashes are extended to the at most
``span - GRAM + 1`` windows that contain them, and the digests of these are joined with the table: by a broadcast if that is small, else by a shuffle, in
which adaptive execution splits the digests of passages that very many documents share. So that few windows of documents go into the join,
a filter of bits, made from the benchmark's kept hashes and windows on the executors, is broadcast first; it has at most ``MOST_BITS`` bits whatever the
benchmark's size, and a bit too many set only sends a window to the join that then finds no partner. The number of stages does not depend on the benchmark.

Where passages lie in a document is summed up by a running maximum over its windows; sets of items are numbered, so that a set that many documents
have is put together once.

Nulls and empty texts have no words and no hits. Long texts: a document is held whole in its task, with about 100 bytes a word. Ties: equal kept hashes and equal windows are all found. Benchmark rows with a null text, or without words, are no items; rows with equal
ids are one item. Rows with a null id are no items to ``analyse``, as its SQL has it; ``keep_clean`` looks for their passages too. Repeated documents come back as often as they occur; an empty table or benchmark gives no
hits. Other columns are ignored (``analyse``) or passed on (``keep_clean``).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, as_bytes, bounded_batches, cut, dealt, fewer, fields, hashed, slices

SPAN = 10
GRAM = 5
#: The filter has 32 bits for each window, and so many at most (32 MB).
MOST_BITS = 1 << 28
FILTER_BLOCK = 1 << 16
#: Rows of windows that are made at a time.
ROWS = 1 << 16
#: The table of windows is broadcast up to so many bytes, and the keys of texts to drop up to so many rows.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 500_000
_PLACES = np.uint64((1 << 30) - 1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes."""
    n = len(words) - k + 1
    total = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(32))


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions kept: of each w neighbours the smallest hash (by its high 34 bits), the last of equal ones."""
    at = chosen(hashes, w)
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]  # kept positions never go back
    return at[keep]


def chosen(hashes: np.ndarray, w: int) -> np.ndarray:
    """The position that each w neighbours keep."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # the low bits count down from the text's start, so the smaller of two keys is also the later of equal hashes
    best, wide = (hashes & ~_PLACES) | (_PLACES - np.arange(len(hashes), dtype=np.uint64)), 1
    while wide < w:
        step = min(wide, w - wide)
        best = np.minimum(best[:-step], best[step:])
        wide += step
    return (_PLACES - (best & _PLACES)).astype(np.int64)


def window_hashes(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` word hashes from each place."""
    total = np.full(len(at), length, np.uint64)
    for j in range(length):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F) + words[at + j]
    return total ^ (total >> np.uint64(32))


def parted(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words with single spaces between them, their starts, ends and hashes, and where each text's begin, with the count of all."""
    return hashed([b" ".join(alnum_words(x)) for x in texts])


def digests(joined: bytes, begin: np.ndarray, end: np.ndarray, at: np.ndarray, length: int) -> list[bytes]:
    """The fingerprints of the windows of ``length`` words from each place."""
    whole = memoryview(joined)
    return [blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(begin[at].tolist(), end[at + length - 1].tolist(), strict=True)]


def grams_of(length: int, span: int, gram: int) -> int:
    """Words of the hashes kept of windows of ``length`` words."""
    return min(gram, span) if length == span else length


def _windows(span: int, gram: int):
    """(name, text) to a row for each window of an item: name, length, digest, its hash, and the hash it keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            joined, begin, end, hashes, stops = parted(as_bytes(batch.column(1)))
            for name, a, b in zip(batch.column(0), stops[:-1].tolist(), stops[1:].tolist(), strict=True):
                if a == b:
                    continue
                length = min(span, b - a)
                k = grams_of(length, span, gram)
                grams = gram_hashes(hashes[a:b], k)
                own = grams[chosen(grams, length - k + 1)]
                for low in range(0, len(own), ROWS):
                    at, part = np.arange(a + low, a + min(low + ROWS, len(own))), own[low : low + ROWS]
                    columns = [pa.repeat(name, len(at)), pa.array(np.full(len(at), length, np.int32)), pa.array(digests(joined, begin, end, at, length), pa.binary()), pa.array(window_hashes(hashes, at, length).view(np.int64)), pa.array(part.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["name", "length", "digest", "key", "gram"])

    return run


def bit_places(values: np.ndarray, length: int, bits: int) -> np.ndarray:
    mixed = (values + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


class Filter:
    """2 ** bits bits, of which those of some values are set."""

    def __init__(self, bits: int):
        self.bits, self.data = bits, np.zeros(1 << (bits - 3), np.uint8)

    def add(self, values: np.ndarray, length: int) -> None:
        at = bit_places(values, length, self.bits)
        np.bitwise_or.at(self.data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def holds(self, values: np.ndarray, length: int) -> np.ndarray:
        at = bit_places(values, length, self.bits)
        return (self.data[at >> 3] >> (at & 7) & 1).astype(bool)


def _filtered(bits: int):
    """(length, key, gram) to (block, data): this task's bits, by blocks of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some = Filter(bits), False
        for batch in batches:
            lengths = batch.column(0).to_numpy()
            for length in np.unique(lengths).tolist():
                for column in (1, 2):
                    own.add(batch.column(column).to_numpy()[lengths == length].view(np.uint64), length)
                    some = True
        if some:
            for k in range(0, len(own.data), FILTER_BLOCK):
                if (part := own.data[k : k + FILTER_BLOCK]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()], pa.binary())], names=["block", "data"])

    return run


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, data) to one row for each block of this task."""
    whole: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            whole[block] = np.frombuffer(data, np.uint8) | whole.get(block, np.uint8(0))
    yield pa.RecordBatch.from_arrays([pa.array([*whole], pa.int64()), pa.array([x.tobytes() for x in whole.values()], pa.binary())], names=["block", "data"])


class Benchmark:
    """The benchmark's windows as a table (name, length, digest, key, gram), the filter, and what is known of their sizes."""

    def __init__(self, benchmark: DataFrame, span: int, gram: int, id_col: str, text_col: str, unnamed: bool):
        rows = benchmark.select(benchmark[id_col].cast("string").alias("name"), benchmark[text_col].alias("text")).dropna(subset=["text"] if unnamed else ["name", "text"])
        bounded_batches(benchmark.sparkSession)
        self.span, self.gram = span, gram
        self.rows = cut(rows.mapInArrow(_windows(span, gram), "name string, length int, digest binary, key long, gram long"))
        many, size, lengths = self.rows.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(F.octet_length("name"), F.lit(0)) + 64), F.lit(0)), F.collect_set("length")).first()
        self.lengths, self.small = sorted(lengths), size <= BROADCAST_BYTES
        self.filter = Filter(min(MOST_BITS.bit_length() - 1, max(16, (32 * many).bit_length())))
        made = self.rows.select("length", "key", "gram").mapInArrow(_filtered(self.filter.bits), "block long, data binary")
        for block, data in made.repartition("block").mapInArrow(_either, "block long, data binary").collect():  # the filter's size at most
            self.filter.data[block : block + len(data)] = np.frombuffer(data, np.uint8)

    def sized(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.small else table

    def candidates(self, texts: list[bytes]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, int, list[bytes]]]]:
        """The texts' counts of words; and (texts, first words in them, length, digests) of windows that the filter lets through, up to ROWS at a time.

        All texts' words are handled as one run; what reaches over a text's end is left out.
        """
        joined, begin, end, hashes, stops = parted(texts)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, int, list[bytes]]]:
            for length in self.lengths:
                k = grams_of(length, self.span, self.gram)
                grams = gram_hashes(hashes, k)
                at = winnow(grams, length - k + 1)
                at = at[self.filter.holds(grams[at], length)]
                if not len(at):
                    continue
                starts = np.unique((at[:, None] - np.arange(length - k + 1)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(hashes) - length)]
                text = np.searchsorted(stops, starts, side="right") - 1
                inside = starts + length <= stops[text + 1]
                starts, text = starts[inside], text[inside]
                there = self.filter.holds(window_hashes(hashes, starts, length), length)
                starts, text = starts[there], text[there]
                for low in range(0, len(starts), ROWS):
                    own, of = starts[low : low + ROWS], text[low : low + ROWS]
                    yield of, own - stops[of], length, digests(joined, begin, end, own, length)

        return np.diff(stops), found()

    def marks(self, narrow: DataFrame) -> DataFrame:
        """Of (id, text): a row for each text (row, id, n_words), and one (row, id, start, length, digest) for each window that the filter lets through."""
        shared = narrow.sparkSession.sparkContext.broadcast(_Looker(self))
        kind = narrow.schema[0].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = TaskContext.get().partitionId() << 33
            for batch in slices(batches, 256):
                n_words, found = shared.value.candidates(as_bytes(batch.column(1)))

                def rows(text: np.ndarray, start=None, length=None, digests=None, batch=batch, n_words=n_words, made=made) -> pa.RecordBatch:
                    n = len(text)
                    columns = [pa.array(made + text), batch.column(0).take(pa.array(text)), pa.array(n_words[text])]
                    columns += [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())] if digests is None else [pa.array(start), pa.array(np.full(n, length, np.int32)), pa.array(digests, pa.binary())]
                    return pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_words", "start", "length", "digest"])

                yield rows(np.arange(batch.num_rows))
                for x in found:
                    yield rows(*x)
                made += batch.num_rows

        return narrow.mapInArrow(run, f"row long, id {kind}, n_words long, start long, length int, digest binary")


class _Looker:
    """What of a Benchmark the executors need."""

    candidates = Benchmark.candidates

    def __init__(self, own: Benchmark):
        self.span, self.gram, self.lengths, self.filter = own.span, own.gram, own.lengths, own.filter


def analyse(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string> sorted, items_sha256) of every row."""
    told = Benchmark(benchmark, span, gram, item_id_col, item_text_col, unnamed=False)
    marks = cut(dealt(told.marks(fields(docs, id_col, text_col))))
    windows = told.rows.groupBy("digest").agg(F.sort_array(F.collect_set("name")).alias("names"))
    windows = cut(windows.withColumn("owners", F.xxhash64("names")))
    hits = marks.where("digest is not null").select("row", "start", (F.col("start") + F.col("length")).alias("stop"), "digest").join(told.sized(windows.select("digest", "owners")), "digest")
    before = F.max("stop").over(Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0))))
    per_row = cut(hits.select("row", "owners", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_set("owners")).alias("sets")))
    named = per_row.select("sets").distinct().select("sets", F.explode("sets").alias("owners")).join(told.sized(windows.select("owners", "names").dropDuplicates(["owners"])), "owners")
    named = named.select("sets", F.explode("names").alias("name")).groupBy("sets").agg(F.sort_array(F.collect_set("name")).alias("items"))
    found = per_row.join(named, "sets").select(F.col("row").alias("of"), "n_hit", "items")
    texts = marks.where("digest is null").join(found, F.col("row") == F.col("of"), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return texts.select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), items.alias("items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns. Passages of items without an id count too.

    Texts with hits are told by their XXH64 and length: up to BROADCAST_ROWS of these are broadcast and no text is shuffled, beyond they are joined by a shuffle.
    """
    told = Benchmark(benchmark, span, gram, item_id_col, item_text_col, unnamed=True)
    key, size = F.xxhash64(docs[text_col]), F.octet_length(docs[text_col])
    marks = told.marks(fields(docs.select(F.struct(key.alias("key"), size.alias("size")).alias("id"), docs[text_col].alias("text")), "id", "text")).where("digest is not null")
    hit = marks.select("id", "digest").join(told.sized(told.rows.select("digest").distinct()), "digest", "left_semi")
    hit = cut(fewer(hit.select(F.col("id.key").alias("_key"), F.col("id.size").alias("_size")).distinct()))
    few = hit.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(hit) if few else hit, (key == hit["_key"]) & (size == hit["_size"]), "left_anti")
