"""Order-preserving packing of documents into fixed token windows by dynamic programming.

The token streams of consecutive documents are joined, and cut into sequences of at most ``window`` tokens. Cuts are allowed
where a document ends (free) and where a sentence ends (a truncation penalty of ``SENTENCE`` tokens); a stretch of over
``STRETCH`` tokens without such an end may be cut at every ``STRETCH``-th token (penalty ``FORCED``). With p[j] the j-th allowed
place, the least cost of a packing that ends there is

    f[j] = penalty[j] + window - p[j] + min { f[i] + p[i] : p[j] - window <= p[i] < p[j] }

that is the padding plus the penalties. The minimum runs over a window whose both ends only advance, so a monotone queue
serves it and each place enters and leaves the queue once.

Documents are packed in the order in which they are stored: every task walks through its input split with a buffer of
``BUFFER`` tokens, packs it, and carries the last, still open sequence on into the next buffer. No text is shuffled; memory
is bounded by the buffer and the longest document. At the end of a split the
open sequence is closed, in lengths that are powers of two where that saves padding; sequences are then
numbered through all splits, from the number that each split made.

Nulls and empty texts are documents of no tokens but the separator. Long texts: a document of any length is held with its ids while it is
packed, its words are looked up 64 kB at a time. Ties: of packings that cost the same the first found is taken, which depends on the stored order alone. Repeated rows are packed as often as they occur. An
empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from itertools import pairwise, repeat
from string import punctuation
from unicodedata import normalize
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ASCII_SPACED, as_bytes, cut, dealt, edges, fields, runs, slices

WINDOW = 4096
SEPARATOR = 2
SENTENCE, FORCED, STRETCH = 4, 12, 32
BUFFER = 1_000_000
#: Bytes of a text that are looked up at a time. A longer word is encoded in pieces of so many characters, which share OVERLAP of them.
LONG, OVERLAP = 1 << 16, 1 << 10
#: A pool of words is full at so many bytes of words.
POOL_BYTES = 32 << 20
_SPACED = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_MARK = np.array([chr(c) in punctuation for c in range(256)])
_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_PUNCTUATION = punctuation.encode()


class Pool:
    """Token ids of words, end to end in one array."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.size = 0
        self.ids, self.filled = np.zeros(1 << 18, np.uint32), 0
        self.start, self.many = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def add(self, words: list[bytes], ids: np.ndarray, many: np.ndarray) -> None:
        """Words that are not in it, their ids end to end, and how many each has."""
        first, last, end = len(self.numbers), len(self.numbers) + len(words), self.filled + len(ids)
        while end > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        while last > len(self.start):
            self.start, self.many = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.many, np.zeros_like(self.many)]
        self.ids[self.filled : end] = ids
        self.many[first:last] = many
        self.start[first:last] = self.filled + np.cumsum(many) - many
        self.filled = end
        self.size += sum(map(len, words))
        self.numbers.update(zip(words, range(first, last), strict=True))

    def take(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that are in it, end to end, and how many each has."""
        return self.gather(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = self.many[number]
        ends = np.cumsum(many)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[number] - ends + many, many)], many


def _letters(word: bytes) -> bool:
    """Whether the tokenizer sees letters only: a letter may be taken apart into a letter and a mark, which it parts."""
    return word.isalpha() or not word.isascii() and normalize("NFC", word.decode("utf-8", "replace")).lower().isalpha()


class Encoder:
    """Token ids of whole texts, by the tokenizer of a file; equal to its ``encode`` without special tokens.

    The tokenizer lower-cases, drops white space and never looks across it, so each word between white space is encoded
    once and kept in a pool, found by its bytes, from which the ids of texts are gathered. A word of letters with a tail of ASCII
    punctuation is put together from both, as the tokenizer parts them too. New words of letters are encoded many at a time: each ends in the one id
    whose token bears the word-end mark; where that count differs they are encoded singly. When a pool is full, by words or bytes, it becomes the old one,
    from which words still in use are taken over. Words of over LONG bytes are not kept.
    """

    def __init__(self, path: str | None = None, most: int = 300_000):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.array(sorted(i for x, i in vocabulary.items() if re.fullmatch(r"[.!?…]+(</w>)?", x)), np.uint32)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.pool, self.old = Pool(), Pool()

    def encode(self, words: list[bytes]) -> None:
        """Puts new words into the pool, each whole."""
        plain = [x for x in words if _letters(x)]
        if plain:
            text = b" ".join(plain).decode("utf-8")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.closing[ids])
            if len(stops) == len(plain) and stops[-1] == len(ids) - 1:
                self.pool.add(plain, ids, np.diff(np.r_[-1, stops]))
            else:
                plain = []
        known = set(plain)
        if rest := [x for x in words if x not in known]:
            ids = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in rest], add_special_tokens=False)]
            self.pool.add(rest, np.array([y for x in ids for y in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def learn(self, words: list[bytes]) -> None:
        """Puts words into the pool, of which none is in it yet."""
        missing = words
        if self.old.numbers and (again := [x for x in words if x in self.old.numbers]):
            self.pool.add(again, *self.old.take(again))
            missing = [x for x in words if x not in self.old.numbers]
        joint, single = [], []
        for x in missing:
            core = x.rstrip(_PUNCTUATION)
            if core and len(core) < len(x) and _letters(core):
                joint.append((x, core, x[len(core) :]))
            else:
                single.append(x)
        for at in range(0, len(single), 2_000):
            self.encode(single[at : at + 2_000])
        if joint:
            self.learn([y for y in dict.fromkeys(y for x in joint for y in x[1:]) if y not in self.pool.numbers])
            ids, many = self.pool.take([y for x in joint for y in x[1:]])
            self.pool.add([x[0] for x in joint], ids, many.reshape(-1, 2).sum(axis=1))

    def long_ids(self, word: str, size: int = LONG, overlap: int = OVERLAP) -> np.ndarray:
        """The ids of a word of any length, from pieces of ``size`` characters that share ``overlap``.

        Merges go by rank, so a row of tokens is the encoding if each two neighbours are; where the two pieces agree on four tokens well inside
        of what they share, the one's tokens before and the other's from there are that row. Without such a place the pieces get longer.
        """

        def piece(at: int) -> tuple[np.ndarray, np.ndarray]:
            found = self.tokenizer.encode(word[at : at + size], add_special_tokens=False)
            return np.array(found.ids, np.uint32), np.array(found.offsets, np.int64).reshape(-1, 2) + at

        (ids, spots), end, out = piece(0), size, []
        while end < len(word):
            at, margin = end - overlap, overlap // 4
            next_ids, next_spots = piece(at)
            places = {tuple(x): k for k, x in enumerate(next_spots.tolist()) if at + margin <= x[0] and x[1] <= end - margin}
            for i in range(int(np.searchsorted(spots[:, 0], at + margin)), len(ids) - 3):
                j = places.get(tuple(spots[i].tolist()), -1)
                if j >= 0 and j + 4 <= len(next_ids) and (ids[i : i + 4] == next_ids[j : j + 4]).all() and (spots[i : i + 4] == next_spots[j : j + 4]).all() and spots[i + 3, 1] <= end - margin:
                    break
            else:
                return self.long_ids(word, 2 * size, 2 * overlap)
            out.append(ids[:i])
            ids, spots, end = next_ids[j:], next_spots[j:], at + size
        return np.concatenate([*out, ids])

    def __call__(self, texts: list[bytes], last: int | None = SEPARATOR) -> list[np.ndarray]:
        """The ids of each text, then ``last``."""
        plain = [x if b"<|" in x else x.translate(ASCII_SPACED) for x in texts]  # special tokens keep their case
        first = np.cumsum([0, *(len(x) + 1 for x in plain)])
        text = b" ".join(plain)
        if b"<|" in text:
            text = text.translate(_SPACED)
        else:  # between an ASCII letter or digit and a mark the tokenizer parts too
            data = np.frombuffer(text, np.uint8)
            marks = np.flatnonzero(_MARK[data[1:]] & _ALNUM[data[:-1]]) + 1
            text = np.insert(data, marks, 32).tobytes()
            first = first + np.searchsorted(marks, first)
        start, ids, many = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at, end in runs(text, LONG):
            part = text[at:end]
            begin, stop = edges(part)
            start.append(begin + at)
            if end - at > LONG:
                found = self.long_ids(part[: stop[0]].decode("utf-8", "replace"))
                counts = np.array([len(found)])
            else:
                found, counts = self.looked_up(part.split())
            ids.append(found)
            many.append(counts)
        start, ids, many = (np.concatenate(x) for x in (start, ids, many))
        stops = np.r_[0, np.cumsum(many)][np.searchsorted(start, first)].tolist()
        tail = np.zeros(0, np.uint32) if last is None else np.array([last], np.uint32)
        return [np.concatenate([ids[a:b], tail]) for a, b in pairwise(stops)]

    def looked_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, end to end, and how many each has."""
        if len(self.pool.numbers) > self.most or self.pool.size > POOL_BYTES:
            self.pool, self.old = Pool(), self.pool
        number = np.fromiter(map(self.pool.numbers.get, words, repeat(-1)), np.int64, len(words))
        if len(absent := np.flatnonzero(number < 0)):
            self.learn([*dict.fromkeys(words[k] for k in absent.tolist())])
            number[absent] = [self.pool.numbers[words[k]] for k in absent.tolist()]
        return self.pool.gather(number)


_ENCODERS: dict[str | None, Encoder] = {}


def worker_encoder(path: str | None) -> Encoder:
    """This Python worker's encoder of a file; a reused worker keeps the words that its earlier tasks have met."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def places(ids: np.ndarray, document_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts (positions over 0, sorted) and their penalties."""
    sentences = np.flatnonzero(np.isin(ids, sentence_ends)) + 1
    at = np.union1d(sentences, document_ends)
    at = at[at > 0]
    gap = np.diff(np.r_[0, at])
    stretch = min(STRETCH, window)
    extra = (gap - 1) // stretch
    forced = np.repeat(at - gap, extra) + stretch * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    penalty = np.r_[np.where(np.isin(at, document_ends), 0, SENTENCE), np.full(len(forced), FORCED)]
    at = np.r_[at, forced]
    order = np.argsort(at, kind="stable")
    return at[order], penalty[order]


def cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW, closing: Callable[[int], int] | None = None) -> list[int]:
    """The ends of the sequences of the cheapest packing that ends at the last place.

    With ``closing`` the packing may end earlier, where at most a window is left: that rest costs ``closing(length)``.
    """
    position, cost = [0, *at.tolist()], [0, *penalty.tolist()]
    best, back = [0] * len(position), [0] * len(position)  # best: f[i] + p[i]
    queue = deque([0])
    for j in range(1, len(position)):
        p = position[j]
        while position[queue[0]] < p - window:
            queue.popleft()
        back[j] = queue[0]
        best[j] = value = best[queue[0]] + window + cost[j]
        while queue and best[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    j = len(position) - 1
    if closing:
        near = range(bisect_left(position, position[j] - window), j + 1)
        j = min(near, key=lambda k: (best[k] - position[k] + closing(position[j] - position[k]), -k))
    out = []
    while j:
        out.append(position[j])
        j = back[j]
    return out[::-1]


def closed(start: int, end: int, window: int = WINDOW) -> tuple[int, list[int]]:
    """Cost and ends of the sequences that close a stream. A sequence whose length is a power of two needs no padding, so the
    rest is cut into such lengths, largest first, if that costs less than to pad it."""
    left = end - start
    lengths = [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
    cost = FORCED * (len(lengths) - 1)
    if left and cost < window - left:
        return cost, np.cumsum([start, *lengths])[1:].tolist()
    return (window - left, [end]) if left else (0, [])


class Packer:
    """Packs documents that come one by one; ``pieces`` holds what is done."""

    def __init__(self, sentence_ends: np.ndarray, window: int = WINDOW, buffer: int = BUFFER):
        self.sentence_ends, self.window, self.buffer = sentence_ends, window, max(buffer, 4 * window)
        self.open: list[tuple[object, int, np.ndarray, int]] = []  # id, start of what is left, ids left, tokens of the document
        self.held, self.sequence = 0, 0
        self.pieces: list[tuple] = []

    def add(self, name, ids: np.ndarray) -> None:
        self.open.append((name, 0, ids, len(ids)))
        self.held += len(ids)
        if self.held >= self.buffer:
            self.pack(final=False)

    def pack(self, final: bool) -> None:
        if not self.held:
            return
        ids = np.concatenate([x[2] for x in self.open])
        ends = np.cumsum([len(x[2]) for x in self.open])
        closing = (lambda left: closed(0, left, self.window)[0]) if final else lambda left: 0  # what is left open costs nothing yet
        stops = cuts(*places(ids, ends, self.sentence_ends, self.window), self.window, closing)
        if final and (low := stops[-1] if stops else 0) < len(ids):
            stops += closed(low, len(ids), self.window)[1]
        documents, low, rest = iter(self.open), 0, None
        for stop in stops:
            offset = 0
            while low < stop:
                name, start, left, total = rest or next(documents)
                take = min(len(left), stop - low)
                self.pieces.append((name, start, take, crc32(left[:take].astype("<u4").tobytes()), total, self.sequence, offset))
                rest = (name, start + take, left[take:], total) if take < len(left) else None
                low, offset = low + take, offset + take
            self.sequence += 1
        self.open = [*([rest] if rest else []), *documents]
        self.held -= low


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text", buffer: int = BUFFER) -> DataFrame:
    """A row for each piece of a document in a sequence: doc_id, start (ids of the document before it), length, ids_crc32 (of the
    little-endian unsigned 32-bit ids), doc_tokens, sequence_id (from 0, without gaps), offset (in the sequence)."""
    narrow = fields(docs, id_col, text_col)
    kind = narrow.schema[0].dataType
    arrow = to_arrow_type(kind)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "local", "offset", "split"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = worker_encoder(tokenizer), TaskContext.get().partitionId()
        packer = Packer(encoder.ends, window, buffer)

        def done() -> pa.RecordBatch:
            columns = [*zip(*packer.pieces, strict=True)] if packer.pieces else [()] * 7
            packer.pieces = []
            arrays = [pa.array(columns[0], arrow), *(pa.array(x, pa.int64()) for x in columns[1:])]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([split] * len(arrays[0]), pa.int64())], names=names)

        for batch in slices(batches, 256):
            for name, ids in zip(batch.column(0).to_pylist(), encoder(as_bytes(batch.column(1)), separator), strict=True):
                packer.add(name, ids)
            if len(packer.pieces) > 20_000:
                yield done()
        packer.pack(final=True)
        yield done()

    made = narrow.mapInArrow(run, f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, local long, offset long, split long")
    pieces = cut(dealt(made))
    counts = pieces.groupBy("split").agg((F.max("local") + 1).alias("made"))  # a row for each task
    before = counts.select("split", (F.sum("made").over(Window.orderBy("split")) - F.col("made")).alias("before"))
    return pieces.join(before, "split").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local")).alias("sequence_id"), "offset")
