from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from larkspur.llm import sharding as S


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4096, 4097, 70_001])
def test_permutation(n):
    image = S.permute(np.arange(n), n, 5)
    assert sorted(image.tolist()) == list(range(n))
    assert (S.permute(np.arange(n), n, 5) == image).all()
    if n > 100:
        assert (S.permute(np.arange(n), n, 6) != image).any()
        assert abs(np.corrcoef(np.arange(n), image)[0, 1]) < 0.1


@pytest.mark.parametrize("parts", [1, 5])
def test_shards(docs, parts):
    rows = docs.repartition(parts).collect()
    found = S.shard(docs.repartition(parts)).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    assert sorted(r.number for r in found) == list(range(len(rows)))
    shards = {k: sorted(r.slot for r in found if r.shard == k) for k in range(8)}
    assert all(x == list(range(len(x))) for x in shards.values())
    sizes = [len(x) for x in shards.values()]
    assert max(sizes) - min(sizes) <= 1
    image = S.permute(np.array([r.number for r in found]), len(found), 20_240_229)
    assert [(r.shard, r.slot) for r in found] == [(x % 8, x // 8) for x in image.tolist()]


def test_does_not_depend_on_the_layout(spark):
    one = spark.createDataFrame([(k, f"t{k}") for k in range(300)], "doc_id long, text string")
    read = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in S.shard(df).collect())
    assert read(one.repartition(7)) == read(one.coalesce(1))


def test_equal_rows_and_nothing(spark, no_docs):
    same = spark.createDataFrame([(1, "x")] * 100, "doc_id long, text string").repartition(4)
    assert sorted(r.number for r in S.shard(same).collect()) == list(range(100))
    assert S.shard(no_docs).count() == 0
