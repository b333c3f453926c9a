"""The corpus pipeline: documents that the quality classifier rejects go, one document of each group of near duplicates stays,
documents that hold benchmark passages go, and what is left is packed into token windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontam, packing, quality, simhash
from larkspur.llm.common import drop_path, scratch_path
from larkspur.llm.queries import quality_weights, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality_weights(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, find=simhash.near_copies)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", keep_uncontaminated),
    ("packing", pack),
]

#: The quality model, the fingerprints and the tokenizer have no SQL form; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline-stage-{number}")
        out.write.parquet(path)
        if read:  # what the next stage does not read any more
            drop_path(spark, read)
        docs, read = spark.read.parquet(path), path
    return docs
