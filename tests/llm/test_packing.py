import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from larkspur.llm import packing as P

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder()


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_equal_the_tokenizers(encoder, texts):
    more = ["Word's, word', 'tis it's.' a≠ b. ÉCOLE! école ſ K DON'T", " x<| |> <|ENDOFTEXT|> <|endoftext|>.", "İstanbul ́x ​ y\u0085z", "日本語。テスト! ·· a·b ñ̃ n̂ ½ ²", "a.b,c; (x) d's 3.5% x_y é, ó.! É!? w… wé…! a's-b't don't.'ll 7.x .5"]
    found = [x or "" for x in texts] + more
    for _ in range(2):  # from the pool too
        assert [x.tolist() for x in encoder([x.encode() for x in found])] == [plain(encoder, x) for x in found]
    marked = [x for x in found if "<|" not in x]  # special tokens change how a whole batch is parted
    assert [x.tolist() for x in encoder([x.encode() for x in marked])] == [plain(encoder, x) for x in marked]
    small = P.Encoder(most=5)
    for x in found:
        assert small([x.encode()])[0].tolist() == plain(encoder, x)


def test_letters_beside_marks(encoder):
    """Every letter, also such as are taken apart into a letter and a combining mark, before and after punctuation."""
    letters = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    for at in range(0, len(letters), 2000):
        words = [y for x in letters[at : at + 2000] for y in (x + ">", ">" + x, f"x{x}'s", f"{x}{x}.")]
        want = [x.ids for x in encoder.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        assert [x.tolist() for x in encoder([x.encode() for x in words], None)] == want
    assert encoder(["\u0130>".encode()], None)[0].tolist() == plain(encoder, "\u0130>")[:-1]


def test_words_that_polynomial_hashes_confuse(encoder):
    words = ["".join("ab"[(bin(k).count("1") + first) % 2] for k in range(n)) for n in (1024, 2048) for first in (0, 1)]
    assert [x.tolist() for x in encoder([x.encode() for x in words])] == [plain(encoder, x) for x in words]
    assert encoder([" ".join(words).encode()])[0].tolist() == plain(encoder, " ".join(words))


def test_long_words(encoder):
    """Words encoded in pieces."""
    rng = random.Random(3)
    for size, overlap in ((64, 32), (200, 64), (1000, 128)):
        for alphabet in ("ab", "abcdefghij", "a", "thequick", "日本語テスト", "ab'st!.", "ae\u0301\u0308İ3x"):
            for _ in range(12):
                word = "".join(rng.choices(alphabet, k=rng.randint(100, 3000)))
                assert encoder.long_ids(word, size, overlap).tolist() == plain(encoder, word)[:-1]
    long = "".join(rng.choices("abcdefghijklmnop日本", k=200_000))
    small = P.Encoder()
    for text in (long, f"a {long} b {long}.", f"x {long[:30000]} y"):
        assert small([text.encode(), b"c"])[0].tolist() == plain(encoder, text)
    assert small.pool.size < 200_000


def test_cuts_are_the_cheapest():
    rng = random.Random(5)
    for _ in range(60):
        at = sorted(rng.sample(range(1, 60), rng.randint(1, 14)))
        window = max(20, *np.diff([0, *at]).tolist())
        penalty = [rng.choice([0, 2, 7]) for _ in at]
        best = {0: 0}
        for j, p in enumerate(at):
            best[p] = min(best[q] + window - (p - q) + penalty[j] for q in [0, *at[:j]] if p - q <= window)
        ends = P.cuts(np.array(at), np.array(penalty), window)
        cost = sum(window - (b - a) + penalty[at.index(b)] for a, b in zip([0, *ends], ends, strict=False))
        assert ends[-1] == at[-1] and cost == best[at[-1]]


def check(pieces, want, window):
    """want: (id, ids) of every row."""
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    left = {}
    for name, ids in want:
        left.setdefault(name, []).append(ids)
    taken = {}
    for r in pieces:
        taken.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for name, copies in left.items():
        for ids in copies:
            rows = taken[name, len(ids)]
            for r in rows:
                assert any(crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in copies if len(x) == len(ids))
        for n in {len(x) for x in copies}:
            cover = np.zeros(n, int)
            for r in taken[name, n]:
                cover[r.start : r.start + r.length] += 1
            assert (cover == sum(len(x) == n for x in copies)).all()
    assert sum(r.length for r in pieces) == sum(len(x) for _, x in want)


@pytest.mark.parametrize("window", [4096, 64])
def test_every_id_in_one_piece(docs, encoder, window):
    pieces = P.pack(docs, window=window, buffer=2000).collect()
    check(pieces, [(r.doc_id, plain(encoder, r.text)) for r in docs.collect()], window)


def test_little_padding(spark, encoder):
    rng = random.Random(2)
    rows = [(k, " ".join(f"{rng.choice(['alpha', 'beta', 'gamma'])}{'.' if rng.random() < 0.1 else ''}" for _ in range(rng.randint(5, 900)))) for k in range(400)]
    pieces = P.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), buffer=30_000).collect()
    lengths = Counter()
    for r in pieces:
        lengths[r.sequence_id] += r.length
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in lengths.values())  # none at a power of two
    assert padding / (padding + sum(lengths.values())) < 0.01


def test_closing():
    assert P.closed(10, 10 + 4096) == (0, [4106])
    assert P.closed(0, 4090) == (6, [4090])
    assert P.closed(7, 7) == (0, [])
    for n in range(1, 3000, 7):
        ends = P.closed(5, 5 + n)[1]
        lengths = np.diff([5, *ends])
        assert ends[-1] == 5 + n and (len(ends) == 1 or all(x & (x - 1) == 0 for x in lengths.tolist()))


def test_nothing_to_pack(no_docs):
    assert P.pack(no_docs).count() == 0


def test_ids_of_any_type(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    for df in (rows, rows.selectExpr("cast(length(doc_id) as decimal(9,0)) as doc_id", "text"), rows.selectExpr("cast(doc_id as binary) as doc_id", "text")):
        assert {r.doc_tokens for r in P.pack(df).collect()} == {1, 3}  # a document may lie in several pieces
