import random

import numpy as np
import pytest

from larkspur.llm import quality as Q


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for k in range(600):
        n = rng.randint(3, 120)
        good = k % 3 > 0
        rows.append((k, " ".join(word() if good else word().upper() + rng.choice(["!!", "$$$"]) for _ in range(n))))
        labels.append((k, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None), (10**6, 0)], "doc_id long, quality int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    weights = Q.train(docs, labels, where="id % 5 != 0")
    found = {r.doc_id: r.score for r in Q.score(docs, weights).collect()}
    held = [k for k in found if k % 5 == 0]
    assert np.mean([(found[k] >= Q.THRESHOLD) == (k % 3 > 0) for k in held]) > 0.97
    kept = Q.keep_good(docs, weights)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {k for k, x in found.items() if x >= Q.THRESHOLD}
    assert (Q.train(docs, labels, where="id % 5 != 0") == weights).all()
    assert (Q.train(docs.repartition(7), labels, where="id % 5 != 0") == weights).all()


def test_score_is_the_sparse_dot_product(labelled):
    docs, labels = labelled
    weights = Q.train(docs, labels, sample=50)
    for r in Q.score(docs.limit(20), weights).join(docs, "doc_id").collect():
        at = Q.features(Q.Featurizer()([r.text.encode()])[0])
        assert len(at) == 4 * len(r.text.split()) - 2
        total = weights[-1] + Q.SCALE * sum(float(weights[x]) for x in at) / len(at)
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)


def test_features_do_not_depend_on_neighbours(texts):
    rows = [(x or "").encode() for x in texts] * 2
    together, stops = Q.Featurizer()(rows)
    alone = Q.Featurizer()
    for x, a, b in zip(rows, stops, stops[1:], strict=False):
        assert (alone([x])[0] == together[a:b]).all()


def test_shapes():
    def shape(word):
        data = b"x " + word.encode() + b" y"
        return int(Q.shapes(data, np.array([2]), np.array([len(data) - 2]))[0])

    same = [("ÉCOLE!!", "UP!!"), ("word,", "été,"), ("***", "***"), ("Word", "Thing"), ("12", "7"), ("a", "b"), ("a!!!!", "abc!!!!"), ("a!!!!!!!", "abc!!!!!!!"), ("aBc", "dE-F")]
    assert all(shape(a) == shape(b) for a, b in same)
    assert shape("a" + "!" * 5000) == shape("b" + "!" * 5000) != shape("b" + "!" * 5001)
    assert shape("a" + "b" * 3_000_000 + "A") == shape("bC")
    assert len({shape(a) for a, _ in same}) == len(same) and shape("x!") != shape("x?") != shape("x")


def test_updates_like_a_plain_loop():
    rng = np.random.default_rng(1)
    model, z, n = Q.Ftrl(), {}, {}
    for _ in range(200):
        at = np.sort(rng.choice(40, 6, replace=False))
        value, label = rng.random(6) * 3, int(rng.integers(0, 2))

        def weight(i):
            if abs(z.get(i, 0)) <= model.l1:
                return 0.0
            return -(z[i] - (model.l1 if z[i] > 0 else -model.l1)) / ((model.beta + n[i] ** 0.5) / model.alpha + model.l2)

        w = [weight(i) for i in at.tolist()]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, value.tolist(), strict=True))))
        for i, x, own in zip(at.tolist(), value.tolist(), w, strict=True):
            g, before = (p - label) * x, n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / model.alpha * own
            n[i] = before + g * g
        model.update(at, value, label)
    assert model.weights(np.arange(40)) == pytest.approx([weight(i) if i in z else 0.0 for i in range(40)], abs=1e-9)


def test_odd_rows(docs, no_docs, labelled):
    weights = Q.train(*labelled)
    found = Q.score(docs, weights).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert Q.score(no_docs, weights).count() == 0 and Q.keep_good(no_docs, weights).count() == 0
    nothing = Q.train(docs, labelled[1].where("false"))
    assert {r.score for r in Q.score(docs, nothing).collect()} == {0.5}
    repeated = Q.train(docs.union(docs), docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality"))
    assert len(repeated) == (1 << Q.BITS) + 1
