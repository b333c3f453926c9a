"""SimHash near-duplicate detection with Burkhard-Keller trees.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two fingerprints link when at
most ``RADIUS`` bits differ; documents reachable over links form a component.

Search. A corpus's fingerprints have no size bound, so no tree of all of them is broadcast. They are cut into shards
by the pigeonhole principle: of four 16-bit blocks at least one is equal in any linked pair, so each distinct
fingerprint goes to four shards, ``(block number, block value)``, and every link lies whole in one shard. In each shard
the fingerprints form a tree whose children are keyed by their integer Hamming distance to the parent; a query
follows only edges whose key lies within the radius of its own distance to the node. All trees of a batch are built
and searched level by level in numpy.

A crowded shard (more than ``CROWDED`` distinct fingerprints) is split the same way on the bits not yet used, as a pair
in it differs by at most the radius there too; this repeats until nothing is crowded or few bits are left. A shard
emits a spanning forest of its links, never all pairs.

Nulls, empty texts: a null text counts as empty, has fingerprint zero and links like any other. Long texts: a text is held whole in its task, with some 60 bytes a word. Ties: the smallest
doc_id names the component; null doc_ids never do unless all are null (then the component is null). Repeated rows come
back as often as they occur. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACED, as_bytes, cut, dealt, discard, fewer, fields, gathered, hashed, regathered, slices, space_words, tidy
from .decontam import gram_hashes

RADIUS = 3
CROWDED = 8192
BROADCAST_IDS = 500_000
#: Splits of the fingerprint by level: four blocks of so many bits, taken from the bits that no level above has fixed.
LEVELS = (16, 12, 9, 6)
#: Near copies: words of a shingle, least Jaccard similarity of the sets of shingles.
COPY_SHINGLE = 5
SIMILARITY = 0.8
#: Bits that candidates' wide fingerprints may differ in, of 256: 39 are expected at a similarity of 0.8, 128 between strangers.
WIDE_RADIUS = 60
#: (distinct texts at most, bits of a shard's name, number of shards a text goes to).
TABLES = ((2_000_000, 12, 24), (1 << 62, 16, 48))

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xBF58476D1CE4E5B9], np.uint64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    words = space_words(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n = len(words) - shingle + 1
    planes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), "<u8", n).view(np.uint8).reshape(n, 8)
    if n < 600:
        ones = np.unpackbits(planes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(planes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; fp holds the fingerprint's 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.fromiter((simhash(x, shingle) for x in as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    narrow = fields(docs, id_col, text_col)
    return narrow.mapInArrow(run, f"doc_id {narrow.schema[0].dataType.simpleString()}, fp long")


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from low to below high, one such range after the other."""
    many = high - low
    return np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)


class Forest:
    """A Burkhard-Keller tree for each run of equal keys; ``keys`` are sorted, fingerprints differ within a key. A fingerprint is a 64-bit
    number, or a row of several. Children come after their parent in the order of the points."""

    def __init__(self, keys: np.ndarray, points: np.ndarray):
        n = len(points)
        self.words = list(np.ascontiguousarray(points.T)) if points.ndim > 1 else [points]
        self.span = 64 * len(self.words) + 1
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        codes, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, left = self.root.copy(), np.setdiff1d(np.arange(n), first)
        while len(left):
            code = at[left] * self.span + self.apart(left, at[left])
            edge, where, inverse = np.unique(code, return_index=True, return_inverse=True)
            child = left[where]
            codes.append(edge)
            children.append(child)
            at[left] = child[inverse]
            left = np.setdiff1d(left, child, assume_unique=True)
        codes, children = np.concatenate(codes), np.concatenate(children)
        order = np.argsort(codes)
        self.codes, self.children = codes[order], children[order]
        self.edges, self.begin = self.codes % self.span, np.searchsorted(self.codes, np.arange(n + 1) * self.span)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.zeros(len(a), np.int64)
        for x in self.words:
            d += np.bitwise_count(x[a] ^ x[b])
        return d

    def near(self, queries: np.ndarray, radius: int, earlier: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, other point of its tree at most ``radius`` bits apart, and their distance; ``earlier``: only points before the query."""
        found = [(queries[:0], queries[:0], queries[:0])]
        q, node = queries, self.root[queries]
        while True:
            if earlier:
                q, node = (x[node < q] for x in (q, node))
            if not len(q):
                return tuple(np.concatenate(x) for x in zip(*found, strict=True))
            d = self.apart(q, node)
            near = (d <= radius) & (q != node)
            found.append((q[near], node[near], d[near]))
            inner = self.begin[node] < self.begin[node + 1]
            q, node, d = q[inner], node[inner], d[inner]
            low, high = self.begin[node], self.begin[node + 1]
            some = np.flatnonzero((self.edges[low] < d - radius) | (self.edges[high - 1] > d + radius))  # elsewhere all edges are within
            low[some] = np.searchsorted(self.codes, node[some] * self.span + np.maximum(d[some] - radius, 0))
            high[some] = np.searchsorted(self.codes, node[some] * self.span + np.minimum(d[some] + radius, self.span - 1), side="right")
            q, node = np.repeat(q, high - low), self.children[_ranges(low, high)]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, other point of its tree) at most ``radius`` bits apart."""
        return self.near(queries, radius)[:2]

    def pairs(self, radius: int, visits: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All (point, earlier point of its tree, distance) at most ``radius`` bits apart, in the points' order; so many points at a time
        that they have ``visits`` earlier ones at most, or one."""
        n = len(self.root)
        load, at = np.cumsum(np.arange(n) - self.root), 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + visits, side="right")))
            yield self.near(np.arange(at, end), radius, earlier=True)
            at = end

    def components(self, radius: int, block: int = 2048) -> np.ndarray:
        """For each point the first point of its component within its tree."""
        label = np.arange(len(self.root))
        for at in range(0, len(label), block):
            a, b = self.within(np.arange(at, min(at + block, len(label))), radius)
            while True:
                x, y = label[a], label[b]
                differ = x != y
                if not differ.any():
                    break
                a, b = a[differ], b[differ]
                np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
                while (label != (jumped := label[label])).any():
                    label = jumped
        return label


def _forest_links(radius: int, rows: int):
    """Over rows (shard, fp) sorted by shard: links (a, b), a spanning forest of each shard."""

    def links(keys: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        label = Forest(keys, points).components(radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        a, b = points[linked].view(np.int64), points[label[linked]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, points = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            points = np.r_[points, batch.column(1).to_numpy().view(np.uint64)]
            if len(keys) >= rows:
                whole = int(np.searchsorted(keys, keys[-1]))  # the last shard may go on in the next batch
                if whole:
                    yield links(keys[:whole], points[:whole])
                    keys, points = keys[whole:], points[whole:]
        yield links(keys, points)

    return run


def _block(level: int, k: int):
    """The level's k-th block of ``rest``, and ``rest`` without it. ``rest`` holds the bits not yet fixed, lowest first."""
    width = LEVELS[level]
    value = F.shiftrightunsigned("rest", width * k).bitwiseAND((1 << width) - 1)
    low = F.col("rest").bitwiseAND((1 << width * k) - 1)
    return value, low.bitwiseOR(F.shiftleft(F.shiftrightunsigned("rest", width * (k + 1)) if k < 3 else F.lit(0).cast("long"), width * k))


def _spread(shards: DataFrame, level: int) -> DataFrame:
    """Each (shard, fp, rest) into four shards by the level's blocks. Shards of one level differ in their 64-bit name;
    a clash of two names only puts strangers together, it loses no link."""
    parts = [F.struct(F.xxhash64("shard", F.lit(level * 4 + k), (b := _block(level, k))[0]).alias("shard"), "fp", b[1].alias("rest")) for k in range(4)]
    return shards.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def near_links(points: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of ``points``, enough to connect each component."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks find links up to three differing bits")
    shards = _spread(points.select(F.lit(0).cast("long").alias("shard"), "fp", F.col("fp").alias("rest")), 0)
    parts = []
    for level in range(1, len(LEVELS) + 1):
        hot = shards.groupBy("shard").count().where(F.col("count") > crowded).select("shard")
        if level == len(LEVELS) or (hot := cut(hot)).isEmpty():
            parts.append(shards)
            break
        parts.append(shards.join(hot, "shard", "left_anti"))
        shards = cut(_spread(shards.join(hot, "shard", "left_semi"), level))
    todo = parts[0]
    for part in parts[1:]:
        todo = todo.union(part)
    todo = todo.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp")
    return todo.mapInArrow(_forest_links(radius, 100_000), "a long, b long")


def loose(table: DataFrame, key: str) -> DataFrame:
    """An aggregate by ``key``, ready to be joined by it: the join deals its rows anew instead of running where the groups were made, and so
    adaptive execution can split hot keys of the other side. It merges, as a broadcast of so many rows would be built by the driver."""
    return table.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long"))).hint("merge")


def components(links: DataFrame, nodes: int, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links, by alternating large-star and small-star rounds. nodes: at least as many
    as there are, to size the partitions.

    Stars are made by a minimum per node (combined before the shuffle) joined back to the links, so that a node with
    very many neighbours is never collected in one place; adaptive execution splits such keys in the join.
    """

    def star(both: DataFrame, large: bool) -> DataFrame:
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        seen = both.join(loose(least, "a"), "a")
        if large:
            return seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return seen.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")).where("a <> b")).distinct()

    now = cut(gathered(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), nodes))
    state = None
    for _ in range(most_rounds):
        # equal count and sums mean equal links here: a round never raises a parent
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == state:
            tidy(links.sparkSession)
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        before, now = now, cut(gathered(star(star(both, large=True), large=False), nodes))
        discard(before)
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of ``docs``."""
    marked = cut(dealt(fingerprints(docs, id_col, text_col, shingle)))
    rows = marked.count()
    classes = cut(gathered(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), rows))
    joined = components(near_links(classes, radius, crowded), rows)
    rooted = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(loose(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root"), "root").select("fp", "component_id")
    return gathered(marked.join(named, "fp").select("doc_id", "fp", "component_id"), rows)


def shingle_sets(texts: list[bytes], shingle: int = COPY_SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a shorter text is one shingle."""
    _, _, _, words, stops = hashed([x.translate(ASCII_SPACED) for x in texts])
    parts = (words[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True))
    return [np.unique(gram_hashes(x, min(shingle, len(x)))) if len(x) else np.zeros(1, np.uint64) for x in parts]


def wide_simhash(grams: np.ndarray) -> np.ndarray:
    """The bitwise majority over four 64-bit hashes of each shingle, as 32 bytes."""
    mixed = grams[:, None] * _MIX
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    planes = (mixed ^ (mixed >> np.uint64(29))).view(np.uint8)
    if len(grams) < 600:
        ones = np.unpackbits(planes, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    else:
        ones = np.concatenate([np.bincount(planes[:, k], minlength=256) @ _BITS for k in range(32)])
    return np.packbits(2 * ones > len(grams), bitorder="little")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of rows sorted by the first one, the shard, in pieces of whole shards; without shards of one row."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        table = pa.Table.from_batches(parts)
        shards = table.column(0).to_numpy()
        sizes = np.diff(np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True]))
        if (sizes > 1).any():
            yield [c.combine_chunks() for c in table.filter(pa.array(np.repeat(sizes > 1, sizes))).columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        shards = batch.column(0).to_numpy()
        if held[0].column(0)[0].as_py() != shards[-1]:  # the last shard may go on in the next batch
            end = int(np.searchsorted(shards, shards[-1]))
            yield from whole([*held[:-1], batch.slice(0, end)])
            held = [batch.slice(end)]
    if held:
        yield from whole(held)


class Shards:
    """Rows of whole shards, in the order of the shards: a Burkhard-Keller tree of each shard's distinct fingerprints, whose nodes are
    numbered by the first of their rows."""

    def __init__(self, shards: np.ndarray, points: pa.Array):
        words = np.frombuffer(b"".join(points.to_pylist()), np.uint64).reshape(len(shards), -1)
        order = np.lexsort((*words.T, shards))
        new = np.r_[True, (shards[order[1:]] != shards[order[:-1]]) | (words[order[1:]] != words[order[:-1]]).any(axis=1)]
        self.first, number = np.unique(order[new], return_inverse=True)
        self.node = np.empty(len(shards), np.int64)
        self.node[order] = number[np.cumsum(new) - 1]
        self.rows = np.argsort(self.node, kind="stable")
        self.begin = np.searchsorted(self.node[self.rows], np.arange(len(self.first) + 1))
        self.forest = Forest(shards[self.first], words[self.first])

    def of(self, nodes: np.ndarray) -> np.ndarray:
        """The rows of the nodes."""
        return self.rows[_ranges(self.begin[nodes], self.begin[nodes + 1])]

    def bounds(self, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest root among each node's rows."""
        return np.minimum.reduceat(roots[self.rows], self.begin[:-1]), np.maximum.reduceat(roots[self.rows], self.begin[:-1])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, key, fp) sorted by shard to pairs (a, b): of each text and the nearest one before it, at most WIDE_RADIUS bits apart; and
    (a, a) of each text that is a candidate's partner but in no pair."""
    for shard, keys, points in _by_shard(batches):
        keys, group = keys.to_numpy(), Shards(shard.to_numpy(), points)
        some = np.diff(group.begin) > 1
        again = np.flatnonzero(group.first[group.node] != np.arange(len(keys)))  # rows whose fingerprint an earlier one has
        x, y = [again], [group.first[group.node[again]]]
        for q, node, d in group.forest.pairs(WIDE_RADIUS):
            some[q] = some[node] = True
            order = np.lexsort((node, d, q))
            best = order[np.r_[True, q[order[1:]] != q[order[:-1]]]] if len(q) else order
            x.append(group.first[q[best]])
            y.append(group.first[node[best]])
        x, y = np.concatenate(x), np.concatenate(y)
        left = some[group.node]
        left[x] = left[y] = False
        a, b, left = keys[x], keys[y], keys[left]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.minimum(a, b), left]), pa.array(np.r_[np.maximum(a, b), left])], names=["a", "b"])


def _undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, key, fp, root) sorted by shard to (shard, key) of each text that has a candidate with another root in that shard."""
    for shard, keys, points, roots in _by_shard(batches):
        shard, roots = shard.to_numpy(), roots.to_numpy()
        group = Shards(shard, points)
        least, most = group.bounds(roots)
        low, high = least.copy(), most.copy()  # of the node and all its candidates
        for q, node, _ in group.forest.pairs(WIDE_RADIUS):
            for a, b in ((q, node), (node, q)):
                np.minimum.at(low, a, least[b])
                np.maximum.at(high, a, most[b])
        some = (low[group.node] != roots) | (high[group.node] != roots)
        yield pa.RecordBatch.from_arrays([pa.array(shard[some]), pa.array(keys.to_numpy()[some])], names=["shard", "key"])


def _decided(similarity: float):
    """Over rows (shard, key, fp, root, grams) sorted by shard: links (a, b) of similar texts, a spanning forest of each shard over its roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, points, roots, grams in _by_shard(batches):
            shard, keys, links = shard.to_numpy(), keys.to_numpy(), []
            group = Shards(shard, points)
            distinct, flat = np.unique(grams.flatten().to_numpy(), return_inverse=True)
            sizes = grams.value_lengths().to_numpy()
            stops, mark = np.cumsum(np.r_[0, sizes]), np.zeros(len(distinct), np.int64)
            # a root is one label within a shard only
            label = np.unique(np.stack([shard, roots.to_numpy()]), axis=1, return_inverse=True)[1].reshape(-1)
            least, most = group.bounds(label)

            def settle(i: int, near: np.ndarray) -> None:
                near = near[label[near] != label[i]]
                if not len(near):
                    return
                mark[flat[stops[i] : stops[i + 1]]] = 1
                both = np.add.reduceat(mark[np.concatenate([flat[stops[j] : stops[j + 1]] for j in near])], np.cumsum(np.r_[0, sizes[near][:-1]]))
                mark[flat[stops[i] : stops[i + 1]]] = 0
                for j in near[both >= (similarity - 1e-9) * (sizes[near] + sizes[i] - both)].tolist():
                    if label[j] != label[i]:
                        links.append((keys[i], keys[j]))
                        label[label == label[j]] = label[i]

            for k in np.flatnonzero(least != most):  # one fingerprint, several roots
                own = group.of(np.array([k]))
                for at in range(1, len(own)):
                    settle(own[at], own[:at])
            for q, node, _ in group.forest.pairs(WIDE_RADIUS):
                open_ = (np.minimum(least[q], least[node]) != np.maximum(most[q], most[node])).nonzero()[0]
                open_ = open_[np.argsort(q[open_], kind="stable")]
                for part in np.split(open_, np.flatnonzero(np.diff(q[open_])) + 1) if len(open_) else []:
                    near = group.of(node[part])
                    for i in group.of(q[part[:1]]).tolist():
                        settle(i, near)
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``: texts link whose sets of 5-word shingles have a Jaccard similarity of
    at least ``similarity``.

    Each distinct text has a SimHash of 256 bits and goes to shards, each named by some of the bits, drawn at random; the fingerprints of a
    shard form a Burkhard-Keller tree. Pairs that it finds at most WIDE_RADIUS bits apart are candidates, and their sets of shingles decide. The first round takes
    a text's nearest candidate in each shard; the second, of the texts that have candidates at all, in the shards all candidates that the links so far leave in different components; sets of shingles go only to those
    shards in which a text has such a candidate. Rows and links grow with the texts, the comparisons within a shard with the square of its texts. A pair that shares no shard is missed: of pairs at a similarity of just 0.8 about 3 %, fewer above.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    narrow = fields(docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")), "doc_id", "key", "text")
    kind = narrow.schema[0].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [wide_simhash(x).tobytes() for x in shingle_sets(as_bytes(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "key", "fp"])

    marked = cut(dealt(narrow.mapInArrow(mark, f"doc_id {kind}, key long, fp binary")))
    rows = marked.count()
    classes = cut(gathered(marked.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")), rows))
    distinct = classes.count()
    width, tables = next((w, t) for most, w, t in TABLES if distinct <= most)
    rng = np.random.default_rng(1)
    chosen = [rng.permutation(256)[:width] for _ in range(tables)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            points = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 32)
            bits = np.unpackbits(points, axis=1, bitorder="little").astype(np.int64)
            for k, at in enumerate(chosen):
                shard = (k << width) + (bits[:, at] << np.arange(width)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], names=["shard", *batch.schema.names])

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [x.view(np.int64) for x in shingle_sets(as_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["key", "grams"])

    def sharded(points: DataFrame) -> DataFrame:
        return points.mapInArrow(spread, f"shard long, {', '.join(f'{x} {kind}' for x, kind in points.dtypes)}").repartition("shard").sortWithinPartitions("shard")

    def sets_of(nodes: DataFrame) -> DataFrame:
        nodes = cut(gathered(nodes.toDF("node").distinct(), rows))
        few = nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        own = narrow.join(F.broadcast(nodes) if few else nodes, narrow["key"] == F.col("node"), "left_semi")
        sets = cut(gathered(own.select("key", "text").dropDuplicates(["key"]).mapInArrow(taken_apart, "key long, grams array<long>"), rows, 10_000))
        discard(nodes)
        return sets

    def then_without(made: DataFrame, *used: DataFrame) -> DataFrame:
        """``made``, cut; what it was made from is deleted."""
        made = cut(made)
        for x in used:
            discard(x)
        tidy(docs.sparkSession)
        return made

    def first_links(found: DataFrame) -> DataFrame:
        pairs = found.where("a <> b")
        sets = sets_of(pairs.select(F.explode(F.array("a", "b"))))
        first, second = sets.select(F.col("key").alias("a"), F.col("grams").alias("x")), sets.select(F.col("key").alias("b"), F.col("grams").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return then_without(pairs.join(first, "a").join(second, "b").where(both >= F.lit(similarity - 1e-9) * (F.size("x") + F.size("y") - both)).select("a", "b").transform(gathered, rows), sets)

    def last_links(points: DataFrame) -> DataFrame:
        spots = cut(regathered(sharded(points).mapInArrow(_undecided, "shard long, key long"), rows))
        sets = sets_of(spots.select("key"))
        own = spots.join(points, "key").join(sets, "key").select("shard", "key", "fp", "root", "grams").repartition("shard").sortWithinPartitions("shard")
        return then_without(regathered(own.mapInArrow(_decided(similarity), "a long, b long"), rows), sets, spots)

    def with_roots(links: DataFrame) -> DataFrame:
        joined = components(links, rows)
        return classes.join(joined, classes["key"] == joined["node"], "left").select("key", "fp", F.coalesce("root", "key").alias("root"), "least")

    found = cut(gathered(sharded(classes.select("key", "fp")).mapInArrow(_nearest, "a long, b long").distinct(), rows))
    links = first_links(found)
    near = cut(gathered(found.select(F.explode(F.array("a", "b")).alias("near")).distinct(), rows))  # only these texts have candidates
    points = cut(gathered(with_roots(links).join(near, F.col("key") == F.col("near"), "left_semi").select("key", "fp", "root"), rows))
    links = then_without(links.union(last_links(points)), found, near, points)
    rooted = with_roots(links)
    named = rooted.join(loose(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root"), "root").select("key", "component_id")
    return gathered(marked.join(named, "key").select("doc_id", "component_id"), rows)


def fingerprint_text(fp) -> F.Column:
    """16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, find=near_duplicates, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component that ``find`` tells the document with the smallest id stays.

    Rows that share an id and a text are one document, of which one row stays; rows that share an id only are several. Of a component in
    which several texts have the smallest id, the one with the smallest hash stays. Rows without an id come after all others, and stay only
    where their component has no document with an id.

    What goes is told by two narrow sets of ids and text hashes: those of no component's smallest document, and those that stay but occur
    more than once. Up to ``broadcast_ids`` of them are broadcast and no text is shuffled but that of repeated rows; beyond,
    they are joined by a shuffle.
    """
    own, key = docs[id_col], F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    found = find(docs.select(F.struct(own.isNull().alias("none"), own.alias("id"), key.alias("key")).alias("_row"), docs[text_col].alias("_text")), "_row", "_text", **options)
    per_row = found.groupBy(F.col("doc_id.id").alias("_id"), F.col("doc_id.key").alias("_key")).agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_stays"), F.count("*").alias("_n"))
    told = cut(fewer(per_row.where("not _stays or _n > 1")))
    few = told.limit(broadcast_ids + 1).count() <= broadcast_ids
    tidy(docs.sparkSession)
    gone, again = (told.where(x).select("_id", "_key") for x in ("not _stays", "_stays"))
    if few:
        gone, again = F.broadcast(gone), F.broadcast(again)

    def among(rows: DataFrame, named: DataFrame, how: str) -> DataFrame:
        return rows.join(named, own.eqNullSafe(named["_id"]) & (key == named["_key"]), how)

    named = among(docs, gone, "left_anti")
    if again.isEmpty():
        return named
    once = among(named, again, "left_anti")
    return once.unionByName(among(named, again, "left_semi").withColumn("_keep_one_key", key).dropDuplicates([id_col, "_keep_one_key"]).drop("_keep_one_key"))
