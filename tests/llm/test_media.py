import struct
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import media as M


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def filtered(image, kinds):
    """The inverse of unfilter, sample by sample."""
    rows = []
    for y, kind in enumerate(kinds):
        line = [kind]
        for x in range(image.shape[1]):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            guess = [0, a, b, (a + b) // 2, paeth(a, b, c)][kind]
            line.append((int(image[y, x]) - guess) % 256)
        rows.append(line)
    return np.array(rows, np.uint8)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.data())
def test_unfilter(height, width, data):
    image = np.array(data.draw(st.lists(st.integers(0, 255), min_size=height * width, max_size=height * width)), np.uint8).reshape(height, width)
    kinds = data.draw(st.lists(st.integers(0, 4), min_size=height, max_size=height))
    assert (M.unfilter(filtered(image, kinds)) == image).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.lists(st.integers(0, 4), min_size=9, max_size=9)), min_size=1, max_size=6), st.integers(1, 12), st.integers(0, 99))
def test_unfilter_several_images(shapes, width, seed):
    rng = np.random.default_rng(seed)
    images = [rng.integers(0, 256, (h, width)).astype(np.uint8) for h, _ in shapes]
    rows = np.concatenate([filtered(x, kinds[: len(x)]) for x, (_, kinds) in zip(images, shapes, strict=True)])
    assert (M.unfilter(rows, [len(x) for x in images]) == np.concatenate(images)).all()


def test_chosen_filters():
    """What is written is undone, uses all five filters, and is what the plain loop makes for the filters chosen."""
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:200, :64]
    parts = [rng.integers(0, 256, (200, 64)), x * 3 + rng.integers(0, 9, (200, 64)), np.cumsum(rng.integers(-3, 4, (200, 64)), axis=0) + 90, (x + y) * 2 + rng.integers(0, 3, (200, 64)), np.zeros((200, 64)), 100 + np.cumsum(rng.integers(-9, 10, (200, 64)), axis=1) // 2 + y // 3]
    image = np.concatenate(parts).astype(np.uint8)
    rows = M.filtered(image, block=70)
    assert set(rows[:, 0].tolist()) == {0, 1, 2, 3, 4} and (rows[:: M.FREE, 0] < 2).all()
    assert (rows == filtered(image, rows[:, 0].tolist())).all() and (M.unfilter(rows) == image).all()
    small = [M.encode_png(x.astype(np.uint8).tobytes()) for x in parts]
    assert all((a == b.astype(np.uint8)).all() for a, b in zip(M.decode_all([*small, M.encode_png(bytes(30), 10)]), [*parts, np.zeros((3, 10))], strict=True))
    for k in range(0, 1200, 131):  # not worse than any single filter in sums of absolute differences
        cost = lambda row: np.abs(row[1:].view(np.int8).astype(int)).sum()
        kinds = rows[:, 0].tolist()
        assert cost(rows[k]) <= min(cost(filtered(image[max(k - 1, 0) : k + 1], [0] * (k > 0) + [j])[-1]) for j in (range(2) if k % M.FREE == 0 else range(5))), kinds[k]


def test_filtered_file_is_read():
    image = np.random.default_rng(0).integers(0, 256, (40, 64)).astype(np.uint8)
    packed = zlib.compress(filtered(image, [k % 5 for k in range(40)]).tobytes())
    data = [M._chunk(b"IDAT", packed[k : k + 100]) for k in range(0, len(packed), 100)]
    file = b"".join([M.SIGNATURE, M._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 40, 8, 0, 0, 0, 0)), M._chunk(b"tEXt", b"a\0b"), *data, M._chunk(b"IEND", b"")])
    assert (M.decode_png(file) == image).all()


def test_damage_is_seen():
    file = M.encode_png(M.filled(b"some text " * 50))
    for k in range(0, len(file), 7):
        with pytest.raises(M.DamagedImage):
            M.decode_png(file[:k] + bytes([file[k] ^ 1]) + file[k + 1 :])
    for k in (0, 8, 20, len(file) - 13, len(file) - 1):
        with pytest.raises(M.DamagedImage):
            M.decode_png(file[:k])


def test_hash_is_the_cosine_transforms():
    image = np.random.default_rng(1).integers(0, 256, (100, 64)).astype(np.uint8)
    edges = np.arange(33) * 100 // 32
    small = np.array([[image[edges[i] : edges[i + 1], 2 * j : 2 * j + 2].mean() for j in range(32)] for i in range(32)])
    low = np.array([[sum(small[y, x] * np.cos(np.pi * (y + 0.5) * u / 32) * np.cos(np.pi * (x + 0.5) * v / 32) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
    assert M.cosine_hash(image) == f"{int(''.join('01'[int(x > np.median(low[1:]))] for x in low), 2):016x}"
    near = image.copy()
    near[3, 3] ^= 1
    assert bin(int(M.cosine_hash(near), 16) ^ int(M.cosine_hash(image), 16)).count("1") <= 4


def test_round_trip(docs, no_docs):
    images = M.encode(docs).cache()
    for r in images.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        text = (r.text or "").encode()
        assert M.decode_png(r.image).tobytes().startswith(text) and r.n_bytes in (len(text), r.n_bytes)
    found = M.describe(images).collect()
    assert len(found) == docs.count()
    by_text = {}
    rows = {(r.doc_id, len((r.text or "").encode())): (r.text or "").encode() for r in docs.collect()}
    for r in found:
        data = M.filled(rows[r.doc_id, r.n_bytes])
        assert len(data) % 64 == 0 and r.payload_bytes == len(data) > 0
        assert (r.payload_sha256, r.tail_crc32) == (sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert by_text.setdefault(data, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert M.describe(M.encode(no_docs)).count() == 0
