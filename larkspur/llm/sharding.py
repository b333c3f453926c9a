"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 .. n-1 in the order of (id, checksum of the text, size); equal rows are interchangeable. A keyed Feistel
network permutes the least domain of 4**k numbers that holds n; a number that lands at n or beyond is sent through again until it
lands below (cycle walking), which makes a permutation of 0 .. n-1. The permuted number's remainder by the count of shards is the shard and
its quotient the slot, so shard sizes differ by one at most, slots have no gaps, and both follow from (number, n, key) alone.

Numbering: the narrow columns are range-partitioned and sorted once, each row gets its place in its partition, and the partitions'
row counts, summed up, give the numbers. No task sees more than its range; equal ids are spread by a tie-breaker.

Nulls: a null id sorts first, a null text has no bytes (size 1, checksum 0). Long texts are reduced to size and checksum where they are read. Ties: rows with equal ids are ordered by checksum and size. Repeated rows each get a slot. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dealt

ROUNDS = 6
KEY = 20_240_229
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(_FIRST)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_SECOND)
    return x ^ (x >> np.uint64(29))


def permute(number: np.ndarray, n: int, key: int) -> np.ndarray:
    """The images of numbers below n under the permutation of 0 .. n-1 that the key names."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out, left = number.astype(np.uint64), np.arange(len(number))
    while len(left):
        x = out[left]
        a, b = x >> half, x & mask
        for k in range(ROUNDS):
            a, b = b, a ^ (_round(b, key * ROUNDS + k) & mask)
        out[left] = x = (a << half) | b
        left = left[x >= n]
    return out.astype(np.int64)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``number``: 0 .. n-1 by ``order``, rows that are equal in it in any order; and ``n``."""
    ranged = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_split")).count()  # a row for each partition
    ahead = counts.select("_split", (F.sum("count").over(Window.orderBy("_split")) - F.col("count")).alias("_ahead"), F.sum("count").over(Window.partitionBy()).alias("n"))
    joined = placed.withColumn("_split", F.shiftright("_at", 33)).join(ahead, "_split")
    return joined.withColumn("number", F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_split", "_ahead")


def shard(docs: DataFrame, shards: int = 8, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, number, shard int, slot) of every row."""
    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    narrow = cut(dealt(docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            image = permute(batch.column("number").to_numpy(), batch.column("n")[0].as_py(), key)
            columns = [batch.column(x) for x in ("doc_id", "size", "text_crc32", "number")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((image % shards).astype(np.int32)), pa.array(image // shards)], names=["doc_id", "size", "text_crc32", "number", "shard", "slot"])

    return numbered(narrow, "doc_id", "text_crc32", "size").mapInArrow(run, f"doc_id {kind}, size long, text_crc32 long, number long, shard int, slot long")


def oracle_sql(shards: int = 8, key: int = KEY) -> str:
    """The whole operator in SQL for another engine: checksums byte by byte, and a step of the recursion for each Feistel round."""
    return f"""
with recursive tab as (
  select list(v order by i) as t from (
    select i, list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda k: k::ubigint)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as v from range(256) r(i))),
h as (select doc_id, row_number() over () as row, octet_length(encode(coalesce(text, ''))) + 1 as size, hex(encode(coalesce(text, ''))) as x from documents),
c as (select doc_id, row, size, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(0, len(x) // 2), lambda i: (('0x' || substr(x, 2 * i + 1, 2))::utinyint)::ubigint)), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint])), 4294967295::ubigint) as crc from h, tab),
m as (select *, row_number() over (order by doc_id nulls first, crc, size) - 1 as number, count(*) over () as n from c),
p as (select greatest(1, (case when max(n) > 1 then length(ltrim(bin(max(n) - 1), '0')) else 0 end + 1) // 2) as half from m),
f as (
  select number, n, half, (number >> half)::ubigint as a, (number & ((1::bigint << half) - 1))::ubigint as b, 0 as k from m, p
  union all
  select number, n, half, b, xor(a, xor(z, z >> 29) & ((1::ubigint << half) - 1)), k % {ROUNDS} + 1 from (
    select *, ((xor(y, y >> 32)::uhugeint * {_SECOND}::uhugeint) % 18446744073709551616::uhugeint)::ubigint as z from (
      select *, (((b::uhugeint + {key * ROUNDS}::uhugeint + (k % {ROUNDS})::uhugeint) * {_FIRST}::uhugeint) % 18446744073709551616::uhugeint)::ubigint as y from f
      where k < {ROUNDS} or ((a << half) | b) >= n)))
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'rows' as law, (((a << half) | b) % {shards})::int as shard, (((a << half) | b) // {shards})::bigint as slot, null::int as grown_shard
from f join m using (number) where k = {ROUNDS} and ((a << half) | b) < f.n"""
