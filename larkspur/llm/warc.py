"""Pages as WARC archives, and archives as chunked record tables.

Writing. A payload becomes one record, or, if it is over ``chunk_bytes``, a segmented one: a first record and continuation records, each
of one chunk, as the format has it. Of records with equal payloads of at least ``least_revisit`` bytes the one with the largest id is a
response and the others are revisits without payload. What is a revisit is told by narrow rows (id, url, digest, size) and by the digests that occur more than once: revisit records
are made from these rows alone, and of the pages those whose digest tells that they are revisits are left out. No payload is ever shuffled: the digests are
broadcast, up to ``BROADCAST_ROWS`` at a time, and where there are more the pages are read once for each such part of the digests. Chunks are cut from a payload one
by one. The records go through Spark's text writer, whose separator is the two empty
lines that end a record, so its commit protocol guards the files on any store.

Each record names the archive run in ``WARC-Warcinfo-ID`` on its second line. The run's id is drawn anew for each write, so no payload can hold
it; two empty lines, the version line and that line part records without doubt. The reader splits archives of any size at
them, and a row is one record of one chunk at most. The archives are read once: digests of payloads of one chunk are taken where they are read, and only their headers go on;
payloads of several chunks go on chunk by chunk, are put in order of (record, chunk number), and their digest
is carried from chunk to chunk; no payload is put together in memory. A length or digest that differs from the header's fails the task.

Nulls: a null payload counts as empty, a null id is written as such and is never the response of a group that has other ids. Long payloads: cut into chunks; a page is held whole only where it is read from
its table. Ties: rows with the
same id and payload are all responses (repeated rows give a record each). An empty table gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard

CHUNK_BYTES = 32 << 10
LEAST_REVISIT = 1000
#: Digests of repeated payloads are broadcast up to this many at a time; a row (digest, id) has some 100 bytes.
BROADCAST_ROWS = 500_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = "\r\n\r\n"


def _opening(run: str) -> str:
    return f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{run}>\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write(pages: DataFrame, path: str, **options) -> str:
    """Writes the archives into the folder ``path``; the run's id, which the reader needs. Options are those of :func:`texts`."""
    run = str(uuid.uuid4())
    found, narrow = texts(pages, run, **options)
    found.write.option("lineSep", _END).text(path)
    for x in narrow:
        discard(x)
    return run


def texts(pages: DataFrame, run: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES, least_revisit: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, list[DataFrame]]:
    """The records as texts, and the cut tables of narrow rows that they rest on."""
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    rows = pages.select(pages[id_col].alias("id"), F.regexp_replace(pages[url_col].cast("string"), r"[\r\n]", " ").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    large = cut(rows.where(F.col("size") >= least_revisit).select("id", "url", "digest", "size"))
    repeated = cut(large.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first.*").toDF("of", "first_id", "first_url"))
    parts = max(1, -(-repeated.count() // BROADCAST_ROWS))
    other = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    revisits = large.join(F.broadcast(repeated) if parts == 1 else repeated, F.col("digest") == F.col("of")).where(other)
    revisits = revisits.select("id", "url", "digest", "size", "first_id", "first_url", F.lit(b"").alias("payload"), F.lit(True).alias("revisit"), F.lit(1).alias("chunks"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("size") / chunk_bytes).cast("int"))
    told = revisits
    for k in range(parts):
        part = lambda name, k=k: F.pmod(F.xxhash64(name), F.lit(parts)) == k
        own, of = (rows, repeated) if parts == 1 else (rows.where(part("digest")), repeated.where(part("of")))
        responses = own.join(F.broadcast(of.select("of", "first_id")), (F.col("digest") == F.col("of")) & (F.col("size") >= least_revisit) & other, "left_anti")
        told = told.unionByName(responses.select("id", "url", "digest", "size", F.lit(None).cast(pages.schema[id_col].dataType).alias("first_id"), F.lit(None).cast("string").alias("first_url"), "payload", F.lit(False).alias("revisit"), chunks.alias("chunks")))
    told = told.withColumn("row", F.monotonically_increasing_id())
    named = told.withColumn("record", F.md5(F.concat_ws("|", F.lit(run), "row", "digest")))
    cells = named.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k"))
    uid = lambda text: F.regexp_replace(text, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    first, several = F.col("k") == 0, F.col("chunks") > 1
    body = F.concat(F.when(first, F.lit(HTTP.encode())).otherwise(F.lit(b"")), F.when(several, F.substring("payload", F.col("k") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(_opening(run)),
        _line("WARC-Type", F.when(~first, F.lit("continuation")).when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.when(first, uid(F.col("record"))).otherwise(uid(F.md5(F.concat_ws("|", "record", "k"))))),
        _line("WARC-Segment-Origin-ID", F.when(~first, uid(F.col("record")))),
        _line("WARC-Segment-Number", F.when(several, F.col("k") + 1)),
        _line("WARC-Segment-Total-Length", F.when(several & (F.col("k") == F.col("chunks") - 1), F.col("size") + len(HTTP))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.when(first, F.col("url"))),
        _line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To-Target-URI", F.when(F.col("revisit"), F.col("first_url"))),
        _line("X-Refers-To-Page", F.when(F.col("revisit"), F.url_encode(F.col("first_id").cast("string")))),
        _line("X-Page-ID", F.when(first, F.url_encode(F.col("id").cast("string")))),
        _line("X-Payload-Length", F.when(first, F.col("size"))),
        _line("X-Segments", F.when(several, F.col("chunks"))),
        _line("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _line("Content-Length", F.octet_length(body)),
        F.lit("\r\n"),
    )
    return cells.select(F.concat(head.cast("binary"), body).cast("string").alias("value")), [large, repeated]


def read(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The chunked record table: a row for each WARC record, that is for each chunk of a payload."""
    text = spark.read.option("lineSep", _END + _opening(run)).text(path)
    text = text.select(F.regexp_replace(F.substring_index("value", _END, 1), "^\\Q" + _opening(run) + "\\E", "").alias("head"), (F.octet_length(F.substring_index("value", _END, 1)) + 4).alias("skip"), F.col("value").cast("binary").alias("raw"))

    def header(name: str) -> Column:
        value = F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r]*)", 1)
        return F.when(value != "", value)

    number = F.coalesce(header("WARC-Segment-Number").cast("int") - 1, F.lit(0))
    size = header("Content-Length").cast("long")
    told = text.select(
        F.coalesce(header("WARC-Segment-Origin-ID"), header("WARC-Record-ID")).alias("record_id"),
        number.alias("chunk_number"),
        header("WARC-Type").alias("type"),
        header("WARC-Target-URI").alias("url"),
        F.url_decode(header("X-Page-ID")).alias("page_id"),
        F.url_decode(header("X-Refers-To-Page")).alias("refers_to"),
        F.regexp_extract("head", r"\nWARC-Payload-Digest: sha1:(\w+)", 1).alias("digest"),
        header("X-Payload-Length").cast("long").alias("payload_bytes"),
        F.coalesce(header("X-Segments").cast("int"), F.lit(1)).alias("chunks"),
        size.alias("size"),
        F.substring("raw", F.col("skip") + F.when(number == 0, F.lit(1 + len(HTTP))).otherwise(1), (size - F.when(number == 0, F.lit(len(HTTP))).otherwise(0)).cast("int")).alias("data"),
    )
    return told


_NARROW = "record_id string, chunk_number int, page_id string, url string, type string, refers_to string, digest string, payload_bytes long, seen long, found string"


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of _NARROW and data, by record and chunk number, to a row for each record; where data is not null the chunks' lengths and digest
    are carried on, one chunk in memory at a time."""
    now, seen, total = None, 0, sha1()

    def done() -> pa.RecordBatch:
        return now if total is None else now.set_column(8, "seen", pa.array([seen])).set_column(9, "found", pa.array([total.hexdigest()]))

    for batch in batches:
        records, chunked = batch.column(0).to_pylist(), batch.column(10).is_valid().to_pylist()
        narrow = batch.select(range(10))
        plain = pa.array([not x for x in chunked])
        yield narrow.filter(plain)
        for k in [k for k, x in enumerate(chunked) if x]:
            if now is None or records[k] != now.column(0)[0].as_py():
                if now is not None:
                    yield done()
                now, seen, total = narrow.slice(k, 1), 0, sha1()
            piece = batch.column(10)[k].as_buffer()
            seen += piece.size
            total.update(piece)
    if now is not None:
        yield done()


def records(chunks: DataFrame) -> DataFrame:
    """(page_id string, url, payload_bytes, payload_digest, record_type, refers_to string) of every record, digests tested."""
    several = F.col("chunks") > 1
    narrow = chunks.select(
        "record_id", "chunk_number", "page_id", "url", "type", "refers_to", "digest", "payload_bytes",
        F.octet_length("data").cast("long").alias("seen"), F.when(~several, F.sha1("data")).alias("found"), F.when(several | (F.col("chunk_number") > 0), F.col("data")).alias("data"),
    )
    whole = narrow.repartition("record_id").sortWithinPartitions("record_id", "chunk_number").mapInArrow(_carried, _NARROW)
    damaged = (F.col("type") != "revisit") & ((F.col("chunk_number") != 0) | (F.col("seen") != F.col("payload_bytes")) | (F.col("found") != F.col("digest")))
    tested = F.when(damaged, F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id")))).otherwise(F.col("digest"))
    return whole.select("page_id", "url", "payload_bytes", tested.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
