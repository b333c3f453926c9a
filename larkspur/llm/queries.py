"""The operators of this subpackage as queries over the driver's tables: (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_text, licenses, lm, media, packing, quality, sharding, simhash, simhash_sql, warc
from .common import cut, drop_path, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col, of: int):
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def op1_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    scored = lm.score(docs, lm.train(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    found = cut(warc.records(warc.read(spark, path, warc.write(pages, path))))
    drop_path(spark, path)
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.analyse(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op8_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.encode(table(spark, sf_dir, "documents")))


def quality_weights(docs: DataFrame, labels: DataFrame):
    return quality.train(docs, labels, where=remainder("id", 5) != 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_weights(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_maxent": op1_maxent,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_warc": op4_warc,
    "op5_tag_paths": op5_tag_paths,
    "op6_feistel": op6_feistel,
    "op7_decontamination": op7_decontamination,
    "op8_png": op8_png,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op3_licenses": licenses.oracle_sql(),
    "op4_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as digest from pages),
f as (select digest as of, max(page_id) as first from p where n >= 1000 group by digest)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when page_id < first then 'revisit' else 'response' end as record_type,
  case when page_id < first then first end as refers_to
from p left join f on digest = of and n >= 1000""",
    "op6_feistel": sharding.oracle_sql(),
    "op7_decontamination": r"""
with w as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
v as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') as span from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from i where len(w) > 0)),
d as (select row, n, s, array_to_string(w[s : s + n - 1], ' ') as span from (select row, w, n, unnest(range(1, len(w) - n + 2)) as s from w, (select distinct n from v) where len(w) >= n)),
h as (select row, item_id, s, d.n from d join v on d.n = v.n and d.span = v.span),
a as (select row, count(distinct spot) as n_hit from (select row, unnest(range(s, s + n)) as spot from h) group by row),
b as (select row, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from h group by row)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join a using (row) left join b using (row)""",
    "op10_simhash": simhash_sql.oracle_sql(),
}
