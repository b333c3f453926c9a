import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from larkspur.llm import simhash as S


def slow_simhash(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [x for x in __import__("re").split("[\x20\x09-\x0d]+", words) if x]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    found = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def slow_components(points, radius=3):
    points = sorted(set(points))
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(points):
        for q in points[:i]:
            if bin(p ^ q).count("1") <= radius:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in points}


def clustered(rng, centers, near, far):
    out = [rng.getrandbits(64) for _ in range(far)]
    for _ in range(centers):
        p = rng.getrandbits(64)
        for _ in range(near):
            out.append(p)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                p ^= 1 << b
    return out


def test_fingerprints(docs, texts):
    found = S.fingerprints(docs).collect()
    want = sorted(slow_simhash(r.text) for r in docs.select("text").collect())
    assert sorted(r.fp % 2**64 for r in found) == want
    assert S.simhash(b"") == 0


def test_forest_is_exhaustive():
    rng = random.Random(1)
    keys, points = [], []
    for k in range(5):
        own = sorted(set(clustered(rng, 6, 8, 40)))
        keys += [k] * len(own)
        points += own
    forest = S.Forest(np.array(keys), np.array(points, np.uint64))
    a, b = forest.within(np.arange(len(points)), 3)
    want = {(i, j) for i in range(len(points)) for j in range(len(points)) if i != j and keys[i] == keys[j] and bin(points[i] ^ points[j]).count("1") <= 3}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    empty = S.Forest(np.zeros(0, np.int64), np.zeros(0, np.uint64))
    assert len(empty.components(3)) == 0


@pytest.mark.parametrize("crowded", [8192, 6])
def test_components_like_brute_force(spark, crowded):
    """Also when every shard counts as crowded and is split again and again."""
    points = clustered(random.Random(3), 25, 12, 200) + [0, 1, 2**64 - 1]
    want = slow_components(points)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in set(points)], "fp long")
    got = {p: p for p in want}
    for r in S.components(S.near_links(df, crowded=crowded), len(want)).collect():
        got[r.node % 2**64] = r.root % 2**64
    groups = lambda m: {frozenset(p for p in m if m[p] == r) for r in m.values()}
    assert groups(got) == groups(want)


def test_long_chain_is_one_component(spark):
    chain, p = [], 0
    for k in range(64):
        p ^= 1 << k
        chain.append((int(np.uint64(p).view(np.int64)),))
    links = S.near_links(spark.createDataFrame(chain, "fp long"), radius=1)
    assert len({r.root for r in S.components(links, 64).collect()}) == 1


def test_query_like_brute_force(docs, no_docs):
    found = S.near_duplicates(docs).collect()
    rows = [(r.doc_id, slow_simhash(r.text)) for r in docs.collect()]
    root = slow_components([p for _, p in rows])
    least = {}
    for k, p in rows:
        if k is not None:
            least[root[p]] = min(k, least.get(root[p], k))
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=repr) == sorted(((k, p, least.get(root[p])) for k, p in rows), key=repr)
    assert S.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("broadcast_ids", [500_000, 0])
def test_keep_one(docs, no_docs, broadcast_ids):
    kept = S.keep_one(docs, broadcast_ids=broadcast_ids)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    want = {r.component_id for r in S.near_duplicates(docs).collect()} - {None}
    assert sorted(ids) == sorted(want)
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["no id"]  # the other has a copy with an id
    assert S.keep_one(no_docs).count() == 0


def test_keep_one_without_repeats_shuffles_no_text(spark):
    rows = [(k, f"some words of text number {k} and {k * 7} then more") for k in range(50)] + [(100 + k, f"some words of text number {k} and {k * 7} then more") for k in range(20)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(50))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_candidates_of_a_shard_in_many_batches():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 256, (40, 32), np.uint8)
    points[20:] = points[:20]
    keys = pa.array(range(40))
    whole = pa.RecordBatch.from_arrays([pa.array([7] * 40), keys, pa.array([x.tobytes() for x in points])], names=["shard", "key", "fp"])
    for batches in ([whole], [whole.slice(k, 1) for k in range(40)]):
        got = {(a, b) for x in S._nearest(iter(batches)) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)}
        assert got == {(k, k + 20) for k in range(20)}


def test_every_candidate_is_told():
    """Also one whose only partner has a nearer one."""
    bits = np.zeros((3, 256), np.uint8)
    bits[1, :70] = bits[2, :40] = 1  # the third lies 40 bits from the first and 30 from the second; these are 70 apart
    rows = pa.RecordBatch.from_arrays([pa.array([7] * 3), pa.array([0, 1, 2]), pa.array([np.packbits(x).tobytes() for x in bits])], names=["shard", "key", "fp"])
    got = {(a, b) for x in S._nearest(iter([rows])) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)}
    assert 40 <= S.WIDE_RADIUS < 70 and got == {(1, 2), (0, 0)}


def near_groups(rng):
    """256-bit fingerprints of one shard: one without bits, a group near it, a group far from it, some of both twice."""
    far = rng.random(256) < 0.5
    bits = [np.zeros(256, bool)]
    for center in (bits[0], far):
        for _ in range(40):
            flips = np.zeros(256, bool)
            flips[rng.choice(256, rng.integers(4, 40), replace=False)] = True
            bits.append(center ^ flips)
    bits = np.array(bits + bits[5:60:6])
    return bits, (bits[:, None] != bits[None]).sum(axis=2)


@pytest.mark.parametrize("visits", [1, 500, 1 << 19])
def test_wide_forest_is_exhaustive(visits):
    rng = np.random.default_rng(4)
    bits, apart = near_groups(rng)
    bits, apart = bits[:81], apart[:81, :81]
    keys = np.repeat([0, 1, 2], [30, 1, 50])
    forest = S.Forest(keys, np.packbits(bits, axis=1).view(np.uint64))
    got = {(a, b): d for x in forest.pairs(60, visits) for a, b, d in zip(*(y.tolist() for y in x), strict=True)}
    assert got == {(i, j): apart[i, j] for i in range(81) for j in range(i) if keys[i] == keys[j] and apart[i, j] <= 60}


def test_near_copies_are_searched_in_trees(monkeypatch):
    """Each round of candidates comes from a Burkhard-Keller tree that follows no edge beyond the radius: of two groups, none of one is compared
    with one of the other, beyond where they hang."""
    bits, apart = near_groups(np.random.default_rng(4))
    n, near = len(bits), (apart <= S.WIDE_RADIUS) & ~np.eye(len(bits), dtype=bool)
    compared, plain = [], S.Forest.apart
    monkeypatch.setattr(S.Forest, "apart", lambda self, a, b: compared.append(len(a)) or plain(self, a, b))
    keys, roots = pa.array(range(n)), np.arange(n) % 3
    columns = [pa.array([7] * n), keys, pa.array([np.packbits(x).tobytes() for x in bits]), pa.array(roots), pa.array([[k // 2] for k in range(n)], pa.list_(pa.int64()))]
    batch = lambda k: iter([pa.RecordBatch.from_arrays(columns[:k], names=["shard", "key", "fp", "root", "grams"][:k])])
    rows = lambda found: [x for y in found for x in zip(*(c.to_pylist() for c in y.columns), strict=True)]
    all_pairs = n * (n - 1) // 2

    got = rows(S._nearest(batch(3)))
    first = [np.where(near[i, :i], apart[i, :i], 999) for i in range(n)]
    want = {(int(x.argmin()), i) for i, x in enumerate(first) if len(x) and x.min() <= S.WIDE_RADIUS}
    assert {x for x in got if x[0] != x[1]} == want and {x for y in got for x in y} == set(np.flatnonzero(near.any(axis=1)).tolist())
    assert 0 < sum(compared) < 0.8 * all_pairs

    compared.clear()
    assert {x for _, x in rows(S._undecided(batch(4)))} == set(np.flatnonzero((near & (roots[:, None] != roots)).any(axis=1)).tolist())
    assert 0 < sum(compared) < 0.8 * all_pairs

    compared.clear()
    label = list(range(3))
    for i, j in zip(*np.nonzero(near), strict=True):
        if i // 2 == j // 2 and label[roots[i]] != label[roots[j]]:
            label = [label[roots[j]] if x == label[roots[i]] else x for x in label]
    assert len(rows(S._decided(0.8)(batch(5)))) == 3 - len(set(label)) > 0
    assert 0 < sum(compared) < 0.8 * all_pairs


def slow_copies(texts, similarity=0.8):
    def shingles(text):
        words = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (text or "").lower()) if x]
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets, root = [shingles(x) for x in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= similarity * len(a | b) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return root


def test_near_copies_like_brute_force(spark):
    """Copies with changed words, which the fingerprints of three bits' radius leave, go; texts below the similarity stay."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", " \n", "one two", "One  two", "one three"]
    for k in range(40):
        base = [word() for _ in range(rng.randint(60, 300))]
        for changes in (0, 0, *(max(1, int(len(base) * x)) for x in (0.005, 0.01, 0.04, 0.1))):
            other = list(base)
            for at in rng.sample(range(len(base)), changes):
                other[at] = word()
            texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    root, least = slow_copies(texts), {}
    for k, r in enumerate(root):
        least.setdefault(r, k)
    assert sorted((r.doc_id, r.component_id) for r in S.near_copies(docs).collect()) == [(k, least[r]) for k, r in enumerate(root)]
    sets = S.shingle_sets([(x or "").encode() for x in texts])
    points = pa.array([S.wide_simhash(x).tobytes() for x in sets])
    keys = pa.array(range(len(texts)))
    rows = pa.RecordBatch.from_arrays([pa.array([1] * len(texts)), keys, points, keys, pa.array([x.view(np.int64) for x in sets])], names=["shard", "key", "fp", "root", "grams"])
    links = [x for y in S._decided(0.8)(iter([rows])) for x in zip(*(c.to_pylist() for c in y.columns), strict=True)]
    assert len(links) == len(texts) - len(set(root)) and all(root[a] == root[b] for a, b in links)
    kept = {r.doc_id for r in S.keep_one(docs, find=S.near_copies).collect()}
    assert kept == set(least.values())
    assert kept < {r.doc_id for r in S.keep_one(docs).collect()}


@pytest.mark.parametrize("broadcast_ids", [500_000, 0])
def test_keep_one_where_texts_share_an_id(spark, broadcast_ids):
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(3))
    docs = spark.createDataFrame([(5, a), (5, b), (7, a), (8, c), (8, c), (9, b + " "), (9, c)], "doc_id long, text string")
    kept = S.keep_one(docs, broadcast_ids=broadcast_ids)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (5, b), (8, c)])
