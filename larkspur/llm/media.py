"""Media columns: PNG images in binary columns, and perceptual hashes of them.

A text's bytes, filled with zeros to a positive multiple of the width, become the rows of an 8-bit grey image. The writer makes
signature, IHDR, IDAT and IEND chunks with their checksums, and filters each row by the one of the five filters that leaves the least sum of absolute differences; every ``FREE``-th row takes one that
needs no row above. The reader takes any 8-bit grey PNG without interlace: it tests every
chunk's checksum and the image's size, inflates the data chunk by chunk, and undoes the five row filters in numpy, for all images of a batch at once: sample (y, x) needs the samples
left, above and left above of it, so the samples of a diagonal are made together, a diagonal beginning in each row that needs none above.

The hash: the image is averaged to 32 x 32, transformed by the cosine transform, and of the 8 x 8 lowest frequencies each gives
a bit, set if it lies over their median (the constant one left out of the median).

Nulls and empty texts: an image of one row of zeros. Long texts: a text is held whole with its image, some ten times its bytes. Ties: of filters with equal sums the one with the least number is taken. Equal texts give equal images and hashes. Repeated rows come back as often as
they occur; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, fields, slices

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
DATA_BYTES = 1 << 16
FREE = 64
GRID, LOW = 32, 8
_COSINES = np.cos(np.pi / GRID * (np.arange(GRID) + 0.5) * np.arange(LOW)[:, None])


class DamagedImage(ValueError):
    """A file that is not a whole PNG of the kind that this reader takes."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filled(text: bytes, width: int = WIDTH) -> bytes:
    """The text with zeros up to a positive multiple of ``width``."""
    return text.ljust(max(1, -(-len(text) // width)) * width, b"\0")


def _guesses(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> list[np.ndarray]:
    """What each of the five filters takes for a sample, from its neighbours as int16."""
    p = left + above - corner
    near, far = np.abs(p - left), np.abs(p - above)
    least = np.abs(p - corner)
    paeth = np.where((near <= far) & (near <= least), left, np.where(far <= least, above, corner))
    return [np.zeros_like(left), left, above, (left + above) >> 1, paeth]


def filtered(samples: np.ndarray, block: int = 1 << 12) -> np.ndarray:
    """Rows of samples to rows that begin with their filter's number."""
    height, width = samples.shape
    out = np.empty((height, width + 1), np.uint8)
    for at in range(0, height, block):
        part = samples[at : at + block].astype(np.int16)
        above = np.zeros_like(part)
        above[1:] = part[:-1]
        if at:
            above[0] = samples[at - 1]
        left, corner = np.zeros_like(part), np.zeros_like(part)
        left[:, 1:], corner[:, 1:] = part[:, :-1], above[:, :-1]
        rest = np.stack([(part - x).astype(np.uint8) for x in _guesses(left, above, corner)])
        cost = np.abs(rest.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
        cost[2:, (np.arange(at, at + len(part)) % FREE == 0)] = np.iinfo(np.int64).max
        kind = cost.argmin(axis=0)
        out[at : at + block, 0], out[at : at + block, 1:] = kind, rest[kind, np.arange(len(part))]
    return out


def encode_png(samples: bytes, width: int = WIDTH, level: int = 2) -> bytes:
    """A grey PNG of rows of ``width`` samples."""
    rows = filtered(np.frombuffer(samples, np.uint8).reshape(-1, width))
    packed = zlib.compress(rows.tobytes(), level)
    data = [_chunk(b"IDAT", packed[k : k + DATA_BYTES]) for k in range(0, len(packed), DATA_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)), *data, _chunk(b"IEND", b"")])


def unfilter(rows: np.ndarray, heights: list[int] | None = None) -> np.ndarray:
    """Samples of rows that begin with their filter's number, one byte a sample; ``heights`` are those of several images below each other."""
    kinds, width = rows[:, 0], rows.shape[1] - 1
    if kinds.max(initial=0) > 4:
        raise DamagedImage("unknown row filter")
    # the samples with a column of zeros before them and a row of zeros below: what stands left of the first and above an image
    out = np.zeros((len(rows) + 1, width + 1), np.uint8)
    out[:-1, 1:] = rows[:, 1:]
    out[:-1][kinds == 1] = np.cumsum(out[:-1][kinds == 1], axis=1, dtype=np.uint8)
    if not (kinds > 1).any():
        return out[:-1, 1:]
    first = np.zeros(len(rows), bool)
    first[np.cumsum([0, *(heights or [len(rows)])])[:-1]] = True
    number = np.arange(len(rows))
    begins = np.maximum.accumulate(np.where(first | (kinds < 2), number, 0))
    place = number - begins  # of a row in its run of rows that need the row above
    order = np.argsort(place, kind="stable")
    order = order[kinds[order] > 1]
    place, kind = place[order], kinds[order]
    flat, own, above = out.reshape(-1), order * (width + 1), np.where(first[order], len(rows), order - 1) * (width + 1)
    for step in range(int(place[0]), int(place[-1]) + width):
        low, high = np.searchsorted(place, [step - width + 1, step + 1])
        x = step - place[low:high]
        at, up = own[low:high] + x, above[low:high] + x  # left neighbours, as the column of zeros comes before
        left, corner, over = flat[at].astype(np.int16), flat[up].astype(np.int16), flat[up + 1].astype(np.int16)
        flat[at + 1] += np.choose(kind[low:high], _guesses(left, over, corner)).astype(np.uint8)
    return out[:-1, 1:]


def decode_png(data: bytes) -> np.ndarray:
    """The samples, rows by columns. Raises DamagedImage if a checksum, a length or the format is wrong."""
    return unfilter(read_png(data))


def decode_all(images: list[bytes]) -> list[np.ndarray]:
    """The samples of several images; those of equal width are unfiltered together."""
    rows, out = [read_png(x) for x in images], {}
    for width in {x.shape[1] for x in rows}:
        own = [k for k, x in enumerate(rows) if x.shape[1] == width]
        heights = [len(rows[k]) for k in own]
        whole = unfilter(np.concatenate([rows[k] for k in own]), heights)
        out |= dict(zip(own, np.split(whole, np.cumsum(heights)[:-1]), strict=True))
    return [out[k] for k in range(len(rows))]


def read_png(data: bytes) -> np.ndarray:
    """The inflated rows, each with its filter's number before it."""
    if data[:8] != SIGNATURE:
        raise DamagedImage("no PNG signature")
    at, size, inflate, parts, ended = 8, None, zlib.decompressobj(), [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise DamagedImage("cut short")
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body, total = data[at + 8 : at + 8 + length], data[at + 8 + length : at + 12 + length]
        if len(total) < 4 or struct.unpack(">I", total)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise DamagedImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise DamagedImage("not an 8-bit grey image without interlace")
            size = height, width
        elif kind == b"IDAT":
            try:
                parts.append(inflate.decompress(body))
            except zlib.error as error:
                raise DamagedImage(str(error)) from error
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise DamagedImage(f"unknown chunk {kind!r}")
        at += 12 + length
    raw = b"".join(parts)
    if not ended or size is None or not inflate.eof or len(raw) != size[0] * (size[1] + 1):
        raise DamagedImage("not whole")
    return np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1)


def _averaged(image: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the mean of its share of the image's; rows repeat if there are too few."""
    rows = len(image)
    if rows < n:
        return image[np.arange(n) * rows // n]
    edges = np.arange(n + 1) * rows // n
    return np.add.reduceat(image, edges[:-1], axis=0) / np.diff(edges)[:, None]


def cosine_hash(image: np.ndarray) -> str:
    small = _averaged(_averaged(image.astype(np.float64), GRID).T, GRID).T
    low = (_COSINES @ small @ _COSINES.T).ravel().round(6)
    return f"{int.from_bytes(np.packbits(low > np.median(low[1:])).tobytes(), 'big'):016x}"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, image binary): each text as a PNG."""
    narrow = fields(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = as_bytes(batch.column(1))
            images = [encode_png(filled(x, width), width) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "image"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema[0].dataType.simpleString()}, n_bytes long, image binary")


def describe(images: DataFrame) -> DataFrame:
    """Of (doc_id, n_bytes, image), read back from the images: sizes, digests and hash. A damaged image fails the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = []
            stored = batch.column(2).to_pylist()
            for data, image in zip(stored, decode_all(stored), strict=True):
                samples = image.tobytes()
                rows.append((len(samples), sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(data), sha256(data).hexdigest(), cosine_hash(image)))
            sizes, digests, tails, stored, stored_digests, hashes = [*zip(*rows, strict=True)] or [()] * 6
            columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(tails, pa.int64()), pa.array(stored, pa.int64()), pa.array(stored_digests, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = images.schema["doc_id"].dataType.simpleString()
    return images.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
