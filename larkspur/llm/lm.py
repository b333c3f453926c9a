"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

    P(word | history) = P(class | history) * P(member | class, history) [ * P(word | member) ]

Classes and members are fixed by the training counts. The ``words`` most frequent words are dealt, by falling count, to classes with equal sums of the counts'
square roots, so that classes of frequent words are small; each word is a member of its own. All other words, seen or not, form one more class, whose
members are the ``MEMBERS`` buckets of the word's hash. Both factors are trained softmaxes over hashed features of the history: the word
before (bigram), the word before that (skip) and, for the class, both together (trigram; for the members it adds a tenth to the time and nothing to the held-out score), beside a bias. Only within a bucket of rare words is a
word's share its add-one estimate, where all unseen words of a bucket share the room of one. Each factor sums to one.

Weights lie in tables of a stated size: ``2 ** class_bits`` rows for the class, and for the members ``2 ** member_bits`` weights for each width, classes being padded to widths
that are powers of two. These sizes and ``words`` are parameters of the model; counts and statistics cover every training row and grow with it: tasks count their words
in numpy, Spark adds the counts up by word. Words are known by their 64-bit XXH64; two words of a corpus of n distinct ones clash with a chance of about n * n / 2 ** 65.

Training: biases start from the counts, all other weights from zero. Rows are dealt to shares by the hash of id and text; there are as many shares as make about ``share`` tokens
each, dealt to ``rounds`` rounds. In a round each share's replica takes the global weights over its rows, in the order of another hash, in mini-batches of gradient updates with step sizes by row
of weights (AdaGrad); the changes, weighted by how often a replica saw the row, are summed up by blocks on the executors in the order of the shares, and their mean is added to the global
weights. Every training row takes part in one round. So the model follows from the rows and the parameters alone, not from partitions or the number of cores; a lost
executor repeats a share of bounded size; and the exchange is bounded by the shares times the model's size.

Scoring: the sums over both factors come from sparse numpy batches. Of the word counts only the most frequent (at most ``HEAD``) are
broadcast; the rest of a document's words are joined with the counts by a shuffle, and all is summed by document.

Nulls and empty texts count as a text of the end token alone; rows with a null id train. Long texts: a text's hashes are held whole (24 bytes a word), all else is made a block at a time.
Ties: words of equal count are ordered by their hash. Repeated rows come back as often as they occur; those equal in id and text train in one share, one after the other.
No training rows: the base score is 0 for each token. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACED, Numbered, as_bytes, bounded_batches, cut, fields, hashed, slices

CLASSES = 32
MEMBER_BITS = 6
MEMBERS = 1 << MEMBER_BITS
#: The class of the words that are no members of their own.
RARE = CLASSES - 1
WORDS = 2048
CLASS_BITS = 16
WEIGHT_BITS = 19
HEAD = 1 << 19
SHARE = 4_000_000
ROUNDS = 2
STEP = 0.15
BATCH = 16384
#: Weights of a table that are exchanged as one row.
BLOCK = 1 << 15
#: Stand for the end token and for what lies before a text's first word.
END, BEFORE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: The bias of what pads a class to its width.
NEVER = np.float32(-1e9)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, an end after each text's; and where each text's tokens begin, with the end of all."""
    _, _, _, found, stops = hashed([x.translate(ASCII_SPACED) for x in texts])
    return np.insert(found, stops[1:], END), stops + np.arange(len(stops))


def history(found: np.ndarray, begins: np.ndarray, low: int, high: int) -> np.ndarray:
    """Hashes of the three features of the tokens from ``low`` to ``high``, a row for each feature."""
    at = np.arange(low, high)
    first = begins[np.searchsorted(begins, at, side="right") - 1]  # where each token's text begins
    last = np.where(at > first, found[np.maximum(at - 1, 0)], BEFORE)
    before = np.where(at > first + 1, found[np.maximum(at - 2, 0)], BEFORE)
    out = np.stack([last * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(1), before * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(2), last * np.uint64(0xD6E8FEB86659FD93) + before * np.uint64(0xA0761D6478BD642F)])
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - MEMBER_BITS)).astype(np.int64)


class Layout:
    """Which class, and which member of it, each frequent word is, and the tables of weights that follow.

    Table 0 chooses the class; then a table for each width that a class is padded to. A table has hashed rows, and below them a row of biases for
    each of its classes.
    """

    def __init__(self, found: np.ndarray, many: np.ndarray, class_bits: int = CLASS_BITS, weight_bits: int = WEIGHT_BITS):
        """found, many: the frequent words' hashes and counts, by falling count."""
        share = np.sqrt(many.astype(np.float64))
        middle = (share.cumsum() - share / 2) / max(share.sum(), 1.0)
        self.kind = np.unique(np.minimum((middle * (CLASSES - 1)).astype(np.int64), RARE - 1), return_inverse=True)[1]
        size = np.bincount(self.kind, minlength=CLASSES)
        self.member = np.arange(len(found)) - (np.cumsum(size) - size)[self.kind]
        size[RARE] = MEMBERS
        self.size, self.table = size, Numbered(max(12, (4 * len(found)).bit_length()))
        self.table.add(found, np.arange(len(found)))
        width = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        self.of = np.full(CLASSES, -1)  # the table of a class's members; a class of one needs none
        self.bias = np.zeros(CLASSES, np.int64)  # which row of biases there is its own
        self.tables: list[tuple[int, int, int]] = [(class_bits, CLASSES, 1)]  # bits of a hashed row, width, rows of biases
        for w in np.unique(width[size > 1]).tolist():
            own = np.flatnonzero((width == w) & (size > 1))
            bits = min(16, max(1, weight_bits - w.bit_length() + 1))
            self.of[own], self.bias[own] = len(self.tables), np.arange(len(own))
            self.tables.append((bits, w, len(own)))

    def weights(self, class_tokens: np.ndarray, word_tokens: np.ndarray, bucket_tokens: np.ndarray) -> list[np.ndarray]:
        """Zero, but for the biases: the logarithms of the counts."""
        out = [np.zeros(((1 << bits) + rows, width), np.float32) for bits, width, rows in self.tables]
        out[0][-1] = np.log((class_tokens + 1) / (class_tokens.sum() + CLASSES))
        for k in np.flatnonzero(self.of > 0).tolist():
            own = bucket_tokens if k == RARE else word_tokens[self.kind == k]
            row = out[self.of[k]][(1 << self.tables[self.of[k]][0]) + self.bias[k]]
            row[: len(own)] = np.log((own + 1) / (own.sum() + len(own)))
            row[len(own) :] = NEVER
        return out

    def targets(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's class and member."""
        number = self.table.find(found)
        known = number >= 0
        kind, member = np.full(len(found), RARE), bucket(found)
        kind[known], member[known] = self.kind[number[known]], self.member[number[known]]
        return kind, member

    def examples(self, kind: np.ndarray, member: np.ndarray, past: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice, list[np.ndarray], np.ndarray]]:
        """For each table: its number, which tokens go through it, the rows of weights that each adds up, the place that is right. The rows of features are
        uint16, which numpy sorts by their digits; the last ones, of biases, are counted from the first of these."""
        yield 0, slice(None), [*self.rows(0, past), np.zeros(len(kind), np.uint16)], kind
        of = self.of[kind]
        for k in range(1, len(self.tables)):
            at = np.flatnonzero(of == k)
            if len(at):
                mixed = (past[:2, at] ^ (kind[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))) * np.uint64(0x9FB21C651E98DF25)
                yield k, at, [*self.rows(k, mixed), self.bias[kind[at]].astype(np.uint16)], member[at]

    def rows(self, k: int, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.tables[k][0])).astype(np.uint16)


def sums(weights: np.ndarray, active: list[np.ndarray], biases: int) -> np.ndarray:
    """Of each token the sum of its rows; the last ``biases`` rows are those of the biases."""
    out = np.take(weights[len(weights) - biases :], active[-1], axis=0)
    for column in active[:-1]:
        out += np.take(weights, column, axis=0)
    return out


def exponentials(out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Of rows of sums: their exponentials, the sums of these, and what was taken off each row first: nothing, unless some sum is no ordinary number."""
    with np.errstate(over="ignore"):
        found = np.exp(out)
        total = found.sum(axis=1)
    if np.isfinite(total).all() and total.min(initial=1) > 1e-30:
        return found, total, 0.0
    top = out.max(axis=1)
    found = np.exp(out - top[:, None])
    return found, found.sum(axis=1), top


def totals(rows: np.ndarray, order: np.ndarray, first: np.ndarray, many: np.ndarray, few: int = 6) -> np.ndarray:
    """Sums of ``rows`` over runs of ``order``, of which most are short: the k-th rows of all runs at once, and what long runs have beyond that one run at a time."""
    out, k = rows[order[first]], 1
    at = np.flatnonzero(many > 1)
    while len(at) and k < few:
        out[at] += rows[order[first[at] + k]]
        k += 1
        at = at[many[at] > k]
    for j in at.tolist():
        out[j] += rows[order[first[j] + k : first[j] + many[j]]].sum(axis=0)
    return out


def probabilities(weights: np.ndarray, active: list[np.ndarray], biases: int) -> np.ndarray:
    found, total, _ = exponentials(sums(weights, active, biases))
    found /= total[:, None]
    return found


def log_probability(weights: np.ndarray, active: list[np.ndarray], biases: int, target: np.ndarray) -> np.ndarray:
    """Natural logarithm of the target's probability."""
    out = sums(weights, active, biases)
    _, total, top = exponentials(out)
    return out[np.arange(len(target)), target].astype(np.float64) - top - np.log(total)


class Replica:
    """The global weights, carried on by gradient updates of one share's rows."""

    def __init__(self, weights: list[np.ndarray], step: float = STEP):
        self.step, self.start, self.weights = step, weights, [x.copy() for x in weights]
        self.squares = [np.full((len(x), 1), 1.0, np.float32) for x in weights]
        self.seen = [np.zeros(len(x), np.float32) for x in weights]

    def update(self, k: int, active: list[np.ndarray], biases: int, target: np.ndarray) -> None:
        """One step over a mini-batch in table ``k``: the gradient at the weights before it, taken up column by column of ``active``, by its rows."""
        error = probabilities(self.weights[k], active, biases)
        error[np.arange(len(target)), target] -= 1
        for column in active:
            own = slice(len(self.weights[k]) - biases, None) if column is active[-1] else slice(None)
            weights, squares, seen = self.weights[k][own], self.squares[k][own], self.seen[k][own]
            order = np.argsort(column, kind="stable")
            ordered = column[order]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            many = np.diff(np.r_[first, len(ordered)])
            at, gradient = ordered[first], totals(error, order, first, many)
            squared = squares[at] + np.einsum("ij,ij->i", gradient, gradient)[:, None] / np.float32(error.shape[1])
            squares[at] = squared
            gradient *= np.float32(self.step) / np.sqrt(squared)
            weights[at] -= gradient
            seen[at] += many


def _counted(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """(text) to (token, c): this task's counts."""
    held, size = [], 0

    def counts() -> pa.RecordBatch:
        found, many = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(many)], names=["token", "c"])

    for batch in slices(batches, 256):
        found = tokens(as_bytes(batch.column(0)))[0]
        held.append(found)
        size += len(found)
        if size >= most:
            yield counts()
            held, size = [], 0
    if size:
        yield counts()


def word_counts(training: DataFrame, text_col: str = "text") -> DataFrame:
    """(token long, c long) over all rows, the end token included."""
    counted = training.select(training[text_col]).mapInArrow(_counted, "token long, c long")
    return counted.groupBy("token").agg(F.sum("c").alias("c"))


def blocks_of(layout: Layout) -> list[tuple[int, slice]]:
    """(table, rows) of each block of weights."""
    return [(k, slice(at, min(at + BLOCK // width, (1 << bits) + rows))) for k, (bits, width, rows) in enumerate(layout.tables) for at in range(0, (1 << bits) + rows, BLOCK // width)]


class Learner:
    """Takes a replica over the tokens of one share, in mini-batches of BATCH tokens."""

    def __init__(self, layout: Layout, weights: list[np.ndarray], step: float = STEP):
        self.layout, self.replica, self.held, self.size = layout, Replica(weights, step), [], 0

    def add(self, texts: list[bytes]) -> None:
        found, begins = tokens(texts)
        for low in range(0, len(found), 4 * BATCH):
            high = min(low + 4 * BATCH, len(found))
            self.held.append((found[low:high], history(found, begins, low, high)))
            self.size += high - low
            if self.size >= 4 * BATCH:
                self.learn(self.size // BATCH * BATCH)

    def learn(self, many: int) -> None:
        found, past = (np.concatenate(x, axis=-1) for x in zip(*self.held, strict=True))
        kind, member = self.layout.targets(found[:many])
        for low in range(0, many, BATCH):
            part = slice(low, min(low + BATCH, many))
            for k, _, active, target in self.layout.examples(kind[part], member[part], past[:, part]):
                self.replica.update(k, active, self.layout.tables[k][2], target)
        self.held, self.size = [(found[many:], past[:, many:])], self.size - many

    def moved(self, share: int) -> pa.RecordBatch:
        """Of each block that was seen (block, share, moved as half floats, seen)."""
        if self.size:
            self.learn(self.size)
        rows = []
        for number, (k, part) in enumerate(blocks_of(self.layout)):
            if (seen := self.replica.seen[k][part]).any():
                moved = (self.replica.weights[k][part] - self.replica.start[k][part]).astype(np.float16)
                rows.append((number, share, moved.tobytes(), seen.tobytes()))
        columns = [*zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "share", "moved", "seen"])


def _trained(batches: Iterator[pa.RecordBatch], shared, step: float) -> Iterator[pa.RecordBatch]:
    """(share, text) by share to (block, share, moved, seen)."""
    layout, weights = shared.value
    now, learner = None, None
    for batch in slices(batches, 256):
        shares = batch.column(0).to_numpy()
        texts = as_bytes(batch.column(1))
        edges = np.flatnonzero(np.r_[True, shares[1:] != shares[:-1], True]).tolist()
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if shares[low] != now:
                if learner:
                    yield learner.moved(now)
                now, learner = int(shares[low]), Learner(layout, weights, step)
            learner.add(texts[low:high])
    if learner:
        yield learner.moved(now)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, share, moved, seen) by block and share to (block, change, seen): the mean change of each row, weighted by how often a replica saw it."""
    now, total, weight = None, 0.0, 0.0

    def done() -> pa.RecordBatch:
        change = total / np.maximum(weight, 1)[:, None]
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([change.astype(np.float32).tobytes()], pa.binary())], names=["block", "change"])

    for batch in batches:
        for block, moved, seen in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            if block != now:
                if now is not None:
                    yield done()
                now, total, weight = block, 0.0, 0.0
            seen = np.frombuffer(seen, np.float32).astype(np.float64)
            total = total + np.frombuffer(moved, np.float16).astype(np.float64).reshape(len(seen), -1) * seen[:, None]
            weight = weight + seen
    if now is not None:
        yield done()


class Model:
    """The trained model. counts stays distributed; the rest is bounded by the sizes of the tables and HEAD."""

    def __init__(self, counts: DataFrame, layout: Layout, weights: list[np.ndarray], bucket_rest: np.ndarray, n: int, v: int, head: tuple[np.ndarray, np.ndarray], known_from: int):
        self.counts, self.layout, self.weights, self.head, self.known_from = counts, layout, weights, head, known_from
        self.bucket_rest = bucket_rest  # tokens and words of each bucket of rare words, and one for what is unseen
        self.n, self.v = n, v


def train(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, words: int = WORDS, class_bits: int = CLASS_BITS, weight_bits: int = WEIGHT_BITS, share: int = SHARE, step: float = STEP) -> Model:
    """Learns from all rows of ``training``. words: how many words are members of their own; class_bits, weight_bits: sizes of the tables; share: tokens of a replica."""
    spark = training.sparkSession
    bounded_batches(spark)
    counts = cut(word_counts(training, text_col))
    per_bucket = np.zeros((2, MEMBERS), np.int64)
    for k, c, n in counts.groupBy(F.shiftrightunsigned("token", 64 - MEMBER_BITS).cast("int").alias("k")).agg(F.sum("c"), F.count("*")).collect():
        per_bucket[:, k] = c, n
    n, v = (int(x) for x in per_bucket.sum(axis=1))
    # the least count from which at most HEAD words are left
    bin_ = F.when(F.col("c") < 1024, F.col("c")).otherwise(1014 + F.floor(F.log2("c")).cast("long"))
    bins, room, least = sorted(((b, n) for b, n in counts.groupBy(bin_.alias("b")).count().collect()), reverse=True), HEAD, None
    for b, many in bins:
        if many > room:
            break
        room, least = room - many, b if b < 1024 else 1 << (b - 1014)
    known_from = int(least or np.iinfo(np.int64).max)
    head = counts.where(F.col("c") >= known_from).toArrow()
    found, many = head["token"].to_numpy().view(np.uint64), head["c"].to_numpy()
    order = np.lexsort((found, -many))
    found, many = found[order], many[order]

    layout = Layout(found[:words], many[:words], class_bits, weight_bits)
    for k, own in enumerate((many[:words], 1)):
        np.subtract.at(per_bucket[k], bucket(found[:words]), own)
    class_tokens = np.bincount(layout.kind, weights=many[:words], minlength=CLASSES)
    class_tokens[RARE] = per_bucket[0].sum()
    weights = layout.weights(class_tokens, many[:words], per_bucket[0])
    blocks = blocks_of(layout)
    shares = max(1, ceil(n / (rounds * share)))  # of a round
    named = F.xxhash64(training[id_col].cast("string"), training[text_col])
    dealt = training.select(F.pmod(named, F.lit(rounds * shares)).alias("share"), F.xxhash64(named, F.lit(1)).alias("order"), training[text_col].alias("text"))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((layout, weights))
        own = dealt.where(F.col("share") % rounds == k).withColumn("share", F.floor(F.col("share") / rounds).cast("int"))
        own = own.repartitionById(shares, "share").sortWithinPartitions("share", "order").select("share", "text")
        moved = own.mapInArrow(partial(_trained, shared=shared, step=step), "block long, share long, moved binary, seen binary")
        mean = moved.repartition("block").sortWithinPartitions("block", "share").mapInArrow(_summed, "block long, change binary").collect()  # the model's size
        weights = [x.copy() for x in weights]
        for number, change in mean:
            table, part = blocks[number]
            weights[table][part] += np.frombuffer(change, np.float32).reshape(part.stop - part.start, -1)
        shared.destroy()
    return Model(counts, layout, weights, per_bucket.sum(axis=0) + 1, n, v, (found, many), known_from)


class _Scorer:
    """What a worker needs to score; the table of frequent words is made once in each worker."""

    def __init__(self, model: Model):
        self.layout, self.weights, self.head = model.layout, model.weights, model.head
        self.bucket_rest = np.log10(model.bucket_rest)
        self.table: Numbered | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def lift(self, found: np.ndarray, past: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """What the model's log10 probability of each token is over ``gain``, log10(c + 1) where c is known here; of a rare word that is yet to come."""
        kind, member = self.layout.targets(found)
        out = np.zeros(len(found))
        for k, at, active, target in self.layout.examples(kind, member, past):
            out[at] += log_probability(self.weights[k], active, self.layout.tables[k][2], target)
        rare = kind == RARE
        return out / np.log(10) - np.where(rare, self.bucket_rest[np.where(rare, member, 0)], gain)

    def rows(self, batches: Iterator[pa.RecordBatch], block: int = 1 << 13) -> Iterator[pa.RecordBatch]:
        """(id, text) to a row for each text (tf 0) and one for each of its words beyond the head, all named by ``row``."""
        made, kind = TaskContext.get().partitionId() << 33, None
        if self.table is None:
            self.table = Numbered(max(12, (4 * len(self.head[0])).bit_length() - 1))
            self.table.add(self.head[0], np.arange(len(self.head[0])))
        logs = np.append(np.log10(self.head[1] + 1.0), 0.0)
        for batch in slices(batches, 256):
            n, kind = batch.num_rows, batch.column(0).type
            found, begins = tokens(as_bytes(batch.column(1)))
            known, gain, lift, rare = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), []
            for low in range(0, len(found), block):
                part = found[low : low + block]
                text = np.searchsorted(begins, np.arange(low, low + len(part)), side="right") - 1
                number = self.table.find(part)
                gained = logs[number]  # of -1: the 0 at the end
                lifted = self.lift(part, history(found, begins, low, low + len(part)), gained)
                known += np.bincount(text[number >= 0], minlength=n)
                gain += np.bincount(text, weights=gained, minlength=n)
                lift += np.bincount(text, weights=lifted, minlength=n)
                at = np.flatnonzero(number < 0)
                rare.append(np.stack([text[at] + made, part[at].view(np.int64)], axis=1))
            row = made + np.arange(n)
            yield self.batch(batch.column(0), row, found[begins[1:] - 1] ^ row.astype(np.uint64), np.zeros(n), np.diff(begins), known, gain, lift)
            made += n
            pairs = np.concatenate(rare)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            new = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)][: len(pairs)])
            many = np.diff(np.r_[new, len(pairs)])
            none = np.zeros(len(new))
            yield self.batch(pa.nulls(len(new), kind), pairs[new, 0], pairs[new, 1].view(np.uint64), many, none, none, none, none)

    def batch(self, ids, row, token, tf, n_tokens, known, gain, lift) -> pa.RecordBatch:
        whole = [pa.array(np.asarray(x).astype(np.int64)) for x in (row, token.view(np.int64), tf, n_tokens, known)]
        return pa.RecordBatch.from_arrays([ids, *whole, pa.array(gain), pa.array(lift)], names=["id", "row", "token", "tf", "n_tokens", "known", "gain", "lift"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    narrow = fields(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(_Scorer(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shared.value.rows(batches)

    kind = narrow.schema[0].dataType.simpleString()
    rows = narrow.mapInArrow(run, f"id {kind}, row long, token long, tf long, n_tokens long, known long, gain double, lift double")
    rare = model.counts.where(F.col("c") < model.known_from).withColumnRenamed("token", "of")
    seen = rows.join(rare, F.col("token") == F.col("of"), "left")
    c = F.coalesce("c", F.lit(0))
    total = seen.groupBy("row").agg(
        F.max("id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("gain") + F.col("tf") * F.log10(c + 1)).alias("gain"),
        F.sum("lift").alias("lift"),
    )
    unit = log10(model.n + model.v + 1)
    base: Column = F.col("gain") - F.col("n_tokens") * F.lit(unit)
    return total.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("gain") + F.col("lift")).alias("score"))
