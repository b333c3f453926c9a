import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import decontam as D
from larkspur.llm.common import alnum_words


def slow(text, items, span=10):
    words = alnum_words((text or "").encode())
    hit, names = set(), set()
    for name, item in items:
        if name is None or item is None:
            continue
        own = alnum_words(item.encode())
        n = min(span, len(own))
        windows = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if n else set()
        for s in range(len(words) - n + 1 if n else 0):
            if tuple(words[s : s + n]) in windows:
                hit |= set(range(s, s + n))
                names.add(str(name))
    return len(words), len(hit), sorted(names)


class Items(D.Benchmark):
    """The windows of items, made without Spark; all of them are known by their digests."""

    def __init__(self, items, span, bits=16):
        self.span, self.gram, self.filter, self.known = span, D.GRAM, D.Filter(bits), {}
        names, texts = [str(k) for k, _ in items], [x.encode() for _, x in items]
        batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["name", "text"])
        for made in D._windows(span, D.GRAM)(iter([batch])):
            for name, length, digest, key, gram in zip(*(x.to_pylist() for x in made.columns), strict=True):
                self.known.setdefault(digest, (length, set()))[1].add(name)
                self.filter.add(np.array([key, gram]).view(np.uint64), length)
        self.lengths = sorted({n for n, _ in self.known.values()})

    def hits(self, texts):
        counts, found = self.candidates([x.encode() for x in texts])
        out = [(int(n), set(), set()) for n in counts]
        for text, start, length, digests in found:
            for t, s, x in zip(text.tolist(), start.tolist(), digests, strict=True):
                if x in self.known:
                    assert self.known[x][0] == length
                    out[t][1].update(range(s, s + length))
                    out[t][2].update(self.known[x][1])
        return [(n, len(places), sorted(names)) for n, places, names in out]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab c", max_size=40), max_size=4), st.lists(st.text("ab c", max_size=120), max_size=4), st.integers(1, 7))
def test_hits_like_brute_force(items, texts, span):
    named = [(k, x) for k, x in enumerate(items)]
    for bits in (16, 3):  # a filter of eight bits lets nearly all through
        assert Items(named, span, bits).hits(texts) == [slow(x, named, span) for x in texts]


def test_winnowing_keeps_one_of_each_window():
    rng = np.random.default_rng(0)
    for w in (1, 2, 3, 6, 7):
        hashes = rng.integers(0, 9, 200).astype(np.uint64) << np.uint64(40)
        kept = set(D.winnow(hashes, w).tolist())
        for s in range(200 - w + 1):
            least = hashes[s : s + w].min()
            assert s + max(k for k in range(w) if hashes[s + k] == least) in kept


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    long = texts[10].split()
    rows = [(1, " ".join(long[5:30])), (2, "Three little words"), (3, None), (None, "one"), (5, ""), (6, "..."), (7, "two WORDS"), (7, "one"), (10, " ".join(long[20:60]).upper()), (11, "same same same same same same same same same same same")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_analyse(docs, benchmark, monkeypatch, broadcast):
    """With the table of windows broadcast, and joined by a shuffle."""
    monkeypatch.setattr(D, "BROADCAST_BYTES", broadcast)
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    want = sorted(((r.doc_id, *slow(r.text, items)) for r in docs.collect()), key=repr)
    found = D.analyse(docs, benchmark)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in found.collect()), key=repr) == want
    assert all(r.items_sha256 == sha256(",".join(r["items"]).encode()).hexdigest() for r in found.collect())
    assert any(n for _, _, n, _ in want)


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_keep_clean(docs, benchmark, no_docs, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast)
    items = [(r.item_id if r.item_id is not None else -1, r.text) for r in benchmark.collect()]
    kept = D.keep_clean(docs, benchmark)
    assert kept.schema == docs.schema
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if not slow(r.text, items)[1])
    assert D.keep_clean(no_docs, benchmark).count() == 0
    assert D.analyse(docs, benchmark.where("false")).where("n_hit > 0").count() == 0
    assert D.keep_clean(docs, benchmark.where("false")).count() == docs.count()


def test_the_plan_does_not_grow_with_the_benchmark(spark, docs, monkeypatch):
    """Items by the thousand, and a join by shuffle: as many exchanges and Python stages as for one item."""
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    plans = []
    for n in (1, 2000):
        items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(120))) for k in range(n)], "item_id long, text string")
        found = D.analyse(docs, items)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        plans.append((plan.count("Exchange hashpartitioning"), plan.count("MapInArrow")))
    assert plans[0] == plans[1] and plans[0][0] > 0


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words and their complements, in documents and items: found where they are, and no endless search for a salt."""
    word = lambda n, first: "".join("ab"[(bin(k).count("1") + first) % 2] for k in range(n))
    for n in (1024, 2048):
        texts = [f"{word(n, 0)} x", f"{word(n, 1)} x", f"y {word(n, 1)} x y"]
        items = [(0, f"{word(n, 0)} x"), (1, f"{word(n, 1)} x")]
        found = D.analyse(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.items) for r in found) == [(k, *slow(x, items)) for k, x in enumerate(texts)]


def test_any_shared_span_is_found(spark):
    rng = random.Random(0)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    rows = [(s, " ".join([f"x{rng.randrange(10**6)}" for _ in range(30)] + item[s : s + 10] + ["y"])) for s in range(31)]
    found = D.analyse(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r.n_hit for r in found.collect()} == {10}


def test_clashing_hashes_do_not_hurt(monkeypatch):
    """With word hashes of two bits nearly everything passes the filter; the digests keep the result exact."""
    real = D.hashed
    monkeypatch.setattr(D, "hashed", lambda texts: (lambda x: (*x[:3], x[3] % np.uint64(4), x[4]))(real(texts)))
    items, texts = [(1, "a b c d"), (2, "e b c d")], ["x a b c d e b c d", "a b c e", "e b c d d"]
    assert Items(items, 4).hits(texts) == [slow(x, items, 4) for x in texts]


def test_keep_clean_looks_for_items_without_id(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, "x " + item + " y"), (2, "something else altogether")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, item), (None, None), (3, None)], "item_id long, text string")
    assert [r.doc_id for r in D.keep_clean(docs, benchmark).collect()] == [2]
