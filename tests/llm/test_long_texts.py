"""Each operator over one very long text of words, one without any space, and short ones beside them."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from test_decontam import slow as slow_hits
from test_licenses import BSD, wrapped
from test_licenses import slow as slow_licenses
from test_lm import slow_base
from test_packing import check, plain
from test_simhash import slow_copies, slow_simhash

from larkspur.llm import decontam, html_text, licenses, lm, media, packing, quality, sharding, simhash, warc


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = [f"{rng.choice(['the', 'of', 'reason', 'école', 'Licence,'])}{k if k % 7 == 0 else ''}" for k in range(60_000)]
    words[30_000:30_000] = wrapped(BSD).split()
    near = list(words)
    near[100:200] = [f"changed{k}" for k in range(100)]
    unspaced = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=2_500_000))
    return [(1, " ".join(words)), (2, unspaced), (3, " ".join(near)), (4, unspaced + " " + "!" * 100_000), (5, "short text"), (6, None)]


@pytest.fixture(scope="module")
def long_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def test_scores(long_docs, rows):
    model = lm.train(long_docs.where("doc_id <> 3"))
    n, want = slow_base([x for k, x in rows if k != 3], [x for _, x in rows])
    found = {r.doc_id: r for r in lm.score(long_docs, model).collect()}
    assert found[1].train_tokens == n
    assert [(found[k].n_tokens, found[k].n_known) for k, _ in rows] == [x[:2] for x in want]
    assert [found[k].base_score for k, _ in rows] == pytest.approx([x[2] for x in want], rel=1e-9)


def test_pieces(long_docs, rows):
    pytest.importorskip("public_tokenizers")
    check(packing.pack(long_docs).collect(), [(k, plain(packing.Encoder(), x)) for k, x in rows], 4096)


def test_licenses(long_docs, rows):
    found = {r.doc_id: r for r in licenses.scan(long_docs).collect()}
    for k, text in rows:
        want = slow_licenses(text)
        assert (found[k].n_words, found[k].labels, sorted(tuple(x) for x in found[k].matches)) == (want[0], want[5], sorted(want[7]))
    assert found[1].labels == "bsd"


def test_archives(spark, rows, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", x) for k, x in [*rows, (7, rows[1][1])]], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    found = {int(r.page_id): r for r in warc.records(warc.read(spark, path, warc.write(pages, path))).collect()}
    for k, text in rows:
        data = (text or "").encode()
        assert (found[k].payload_bytes, found[k].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert found[2].refers_to == "7" and found[7].record_type == "response"


def test_pages(rows):
    parts = [f"<p>{x}</p>" for x in rows[0][1].split(",")]
    page = f"<html><body><nav><a>x</a></nav><article><h1>T</h1>{''.join(parts)}<p>{rows[1][1]}</p></article><footer>f</footer></body></html>"
    want = ["T", *(" ".join(x.split()) for x in rows[0][1].split(",") if x.split()), rows[1][1]]
    assert html_text.main_text(page) == "\n".join(want)


def test_shards(long_docs, rows):
    found = {r.doc_id: r for r in sharding.shard(long_docs, shards=2).collect()}
    assert [(found[k].size, found[k].text_crc32) for k, _ in rows] == [(len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for _, x in rows]


def test_passages(spark, long_docs, rows):
    words = rows[0][1].split()
    items = [(1, " ".join(words[500:5000])), (2, " ".join(words[59_000:])), (3, rows[1][1]), (4, "no such passage")]
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.analyse(long_docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {k: slow_hits(x, items) for k, x in rows}


def test_images(long_docs, rows):
    found = {r.doc_id: r for r in media.describe(media.encode(long_docs)).collect()}
    for k, text in rows:
        data = media.filled((text or "").encode())
        assert (found[k].payload_bytes, found[k].payload_sha256) == (len(data), hashlib.sha256(data).hexdigest())


def test_quality(long_docs, rows):
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    for r in quality.score(long_docs, weights).join(long_docs, "doc_id").collect():
        at = quality.features(quality.Featurizer()([(r.text or "").encode()])[0])
        total = weights[-1] + (quality.SCALE * weights[at].astype(float).sum() / len(at) if len(at) else 0)
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)


def test_copies(long_docs, rows):
    found = {r.doc_id: r.fp % 2**64 for r in simhash.near_duplicates(long_docs).collect()}
    assert found == {k: slow_simhash(x) for k, x in rows}
    root = slow_copies([x for _, x in rows])
    least = {r: min(rows[j][0] for j, q in enumerate(root) if q == r) for r in root}
    assert {r.doc_id: r.component_id for r in simhash.near_copies(long_docs).collect()} == {k: least[r] for (k, _), r in zip(rows, root, strict=True)}
    assert sorted(r.doc_id for r in simhash.keep_one(long_docs, find=simhash.near_copies).collect()) == sorted(set(least.values()))
