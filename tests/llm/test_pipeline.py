"""The pipeline, stage by stage, against brute force over the smallest driver tables; and the registered queries."""

import os

import numpy as np
import pytest
from test_decontam import slow as slow_decontam
from test_packing import check, plain
from test_simhash import slow_copies

import corpus_pipeline as C
from larkspur.llm import packing, quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = queries.quality_weights(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def good(rows):
        def score(text):
            at = quality.features(quality.Featurizer()([(text or "").encode()])[0])
            return 1 / (1 + np.exp(-float(weights[-1]) - quality.SCALE * (weights[at].mean(dtype=float) if len(at) else 0)))

        return [r for r in rows if score(r.text) >= quality.THRESHOLD]

    def one_of_each(rows):
        """Five words, a similarity of 0.8: what near-duplicate stages on word shingles take."""
        root, least = slow_copies([r.text for r in rows]), {}
        for r, key in zip(rows, root, strict=True):
            least[key] = min(r.doc_id, least.get(key, r.doc_id))
        return [r for r in rows if r.doc_id in least.values()]

    def clean(rows):
        return [r for r in rows if not slow_decontam(r.text, items)[1]]

    before = docs.collect()
    for k, ((name, stage), brute) in enumerate(zip(C.STAGES[:-1], (good, one_of_each, clean), strict=True)):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after, want = docs.collect(), brute(before)
        assert sorted(map(repr, after)) == sorted(map(repr, want)), name
        assert len(after) < len(before), name
        before = after
    pieces = C.STAGES[-1][1](spark, docs, SF).collect()
    encoder = packing.Encoder()
    check(pieces, [(r.doc_id, plain(encoder, r.text)) for r in before], 4096)
    run = C.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in run.collect() if r.start == 0 and r.length == r.doc_tokens) and {r.doc_id for r in run.collect()} == {r.doc_id for r in before}


def test_odd_rows_pass_every_stage(spark, docs, no_docs):
    for table in (docs, no_docs):
        for _, stage in C.STAGES[:-1]:
            assert stage(spark, table, SF).columns == table.columns
        assert C.STAGES[-1][1](spark, table, SF).count() >= table.limit(1).count()


def test_quality_of_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    scored = queries.op9_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.95


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n for n in names if n.startswith("op")} == set(queries.QUERIES) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    want = db.execute(f"select {', '.join(found.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_row_has_its_result(spark, name):
    """Each query returns a row for each row of its whole table (packing: for each piece)."""
    found = queries.QUERIES[name](spark, SF)
    key = "page_id" if "page_id" in found.columns else "doc_id"
    ids = [r[0] for r in spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet").select(key).collect()]
    got = [r[0] for r in found.select(key).collect()]
    assert sorted(set(got) if name == "op2_packing" else got) == sorted(ids)
