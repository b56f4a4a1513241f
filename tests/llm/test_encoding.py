import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperledger.llm import bpe, media_archive, token_planes

from . import fixtures

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=3000):
    r = random.Random(4)
    letters = "ab \n\t\r'stlvemd0१²½éǘ漢字😀\x85\xa0 　\x1c\x1f\x0b_!?.,<|>ñ​ ﻿\x00ſK"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(n)] + ["", "a" * 3000, " " * 300, "\n\n \n x", "<|endoftext|> x"]


def test_bpe_equals_the_library():
    encoder, library = bpe.Encoder(bpe.Vocabulary.load(RANKS), public_tokenizers.PATTERN), reference()
    texts = odd_texts()
    ids, at = encoder.encode(texts)
    data, ends = bpe.decode_bytes(encoder.vocab, ids, at)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(t), repr(t)
        assert data[ends[k] : ends[k + 1]].tobytes() == t.encode()


def test_bpe_forgets(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 10)
    encoder, library = bpe.Encoder(bpe.Vocabulary.load(RANKS), public_tokenizers.PATTERN), reference()
    for a in range(0, 60, 20):
        texts = odd_texts(60)[a : a + 20]
        ids, _ = encoder.encode(texts)
        assert ids.tolist() == [x for t in texts for x in library.encode_ordinary(t)]


def test_bpe_tables(spark):
    docs = fixtures.table(spark)
    library = reference()
    expected = {i: library.encode_ordinary(t or "") for i, t in fixtures.rows()}
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = fixtures.by_id(encoded, "n_tokens", "ids")
    assert got == {i: (len(x), np.array(x, "<u4").tobytes()) for i, x in expected.items()}
    assert fixtures.by_id(bpe.decode(encoded, RANKS), "content") == {i: ((t or "").encode(),) for i, t in fixtures.rows()}
    digests = fixtures.by_id(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    assert digests == {i: (len(expected[i]), hashlib.sha256(np.array(expected[i], "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in fixtures.rows()}
    assert bpe.encode(fixtures.table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    assert [r["doc_id"] for r in bpe.encode(fixtures.table(spark, [(None, "a"), (None, "a")]), RANKS, public_tokenizers.PATTERN).collect()] == [None, None]


@pytest.mark.parametrize("bits", [True, False])
def test_planes(bits):
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) >> np.uint32(r.integers(0, 31))
        assert token_planes.decode_chunk(token_planes.encode_chunk(ids, bits), n, bits).tolist() == ids.tolist()
    body = token_planes.encode_shard(np.array([4, 9]), np.array([700, 300]), ids, bits, block=64)
    shard = token_planes.Shard(__import__("io").BytesIO(body))
    assert (shard.doc_ids.tolist(), shard.lengths.tolist(), shard.n_ids) == ([4, 9], [700, 300], 1000)
    for a, b in ((0, 1000), (0, 0), (63, 65), (64, 128), (700, 1000), (999, 1000)):
        assert shard.ids(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        token_planes.Shard(__import__("io").BytesIO(b"x" * 99))


def test_word_tokenizer_equals_the_library():
    ours, library = token_planes.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    texts = odd_texts(2000)
    ids, n = ours.encode(pa.array(texts), 1)
    assert ours.by_words and ids.tolist() == [x for e in library.encode_batch(texts, add_special_tokens=False) for x in [*e.ids, 1]]
    assert n.tolist() == [len(e.ids) + 1 for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [True, False])
def test_token_files(spark, tmp_path, bits):
    library = Tokenizer.from_file(WORDS)
    manifest = token_planes.write_tokens(fixtures.table(spark), str(tmp_path), WORDS, bits=bits, shard_bytes=20_000)
    assert manifest.count() > 2
    expected, start = {}, 0
    for i, t in sorted(fixtures.rows()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expected[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert fixtures.by_id(token_planes.read_tokens(spark, str(tmp_path), digest=True), "start", "n_tokens", "ids_crc32") == expected
    ids = token_planes.read_tokens(spark, str(tmp_path)).withColumn("c", F.crc32("ids"))
    assert fixtures.by_id(ids, "start", "n_tokens", "c") == expected


def test_token_files_of_nothing(spark, tmp_path):
    assert token_planes.write_tokens(fixtures.table(spark, []), str(tmp_path), WORDS).count() == 0
    assert token_planes.read_tokens(spark, str(tmp_path)).count() == 0
    token_planes.write_tokens(fixtures.table(spark, [(None, "a"), (2, "b"), (2, "b"), (1, None)]), str(tmp_path), WORDS)
    rows = sorted(map(tuple, token_planes.read_tokens(spark, str(tmp_path), digest=True).select("doc_id", "start", "n_tokens").collect()), key=lambda r: r[1])
    assert rows == [(None, 0, 2), (1, 2, 1), (2, 3, 2), (2, 5, 2)]


def test_other_tokenizers_go_their_own_way(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert not token_planes.WordTokenizer(path).by_words
    token_planes.write_tokens(fixtures.table(spark), str(tmp_path), path, end_id=50256)
    expected = {i: (np.array([*library.encode(t or "", add_special_tokens=False).ids, 50256], "<u4").tobytes(),) for i, t in fixtures.rows()}
    assert fixtures.by_id(token_planes.read_tokens(spark, str(tmp_path)), "ids") == expected


def test_marks_and_letters_equal_the_library():
    """Words of letters go to the model itself, and marks are cut from the words that they end."""
    ours, library = token_planes.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    r = random.Random(8)
    texts = ["".join(r.choice("abzàÿßÑ÷×Ωe\u0301\u0338.,!?#'st -<|>0\n") for _ in range(r.randint(0, 30))) for _ in range(4000)]
    ids, _ = ours.encode(pa.array(texts), 1)
    assert ids.tolist() == [x for e in library.encode_batch(texts, add_special_tokens=False) for x in [*e.ids, 1]]


def test_long_words_equal_the_library():
    encoder, library = bpe.Encoder(bpe.Vocabulary.load(RANKS), public_tokenizers.PATTERN), reference()
    r = random.Random(5)
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters in ("ab", "etaoin shrdlu"[:6], "abcdefghijklmnopqrstuvwxyz", "漢字中文日本語的是") for n in (1025, 3000, 20_001)]
    for t in [*texts, "x" * 1_000_000]:
        assert encoder.encode([t])[0].tolist() == library.encode_ordinary(t)


def test_long_words_of_odd_ranks():
    """Ranks in an order that no training gives: merge_long must not differ from merge_rows."""
    r = random.Random(6)
    for seed in range(40):
        tokens = [bytes([b]) for b in range(256)] + sorted({"".join(r.choice("abc") for _ in range(r.randint(2, 5))).encode() for _ in range(30)}, key=lambda _: r.random())
        vocab = bpe.Vocabulary(tokens)
        word = vocab.byte_id[np.frombuffer("".join(r.choice("abc") for _ in range(300)).encode(), np.uint8)]
        rows, n = bpe.merge_rows(vocab, word[None, :], np.array([300]))
        assert bpe.merge_long(vocab, word).tolist() == rows[0, : n[0]].tolist()


def test_png():
    r = random.Random(2)
    for n in (0, 1, 63, 64, 65, 5000):
        payload = media_archive.padded(r.randbytes(n))
        assert len(payload) % 64 == 0 and len(payload) >= 64
        png = media_archive.to_png(payload)
        assert media_archive.from_png(png) == payload
        assert media_archive.feature(payload) == media_archive.feature(payload)
    bad = bytearray(png)
    bad[60] ^= 1
    with pytest.raises(ValueError):
        media_archive.from_png(bytes(bad))


@pytest.mark.parametrize("range_bytes", [1 << 24, 700])
def test_archives(spark, tmp_path, range_bytes):
    data = [*fixtures.rows(), (50, None), (None, "x"), (None, "x")]
    listed = media_archive.write_archives(fixtures.table(spark, data), str(tmp_path), archive_bytes=3000)
    assert listed.count() > 3
    members = media_archive.read_archives(spark, str(tmp_path), range_bytes)
    assert members.where("attempts = 1").count() == len(data)
    got = [tuple(r) for r in media_archive.media_features(members).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()]
    expected = []
    for i, t in data:
        body = (t or "").encode()
        payload = media_archive.padded(body)
        expected.append((i, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(got, key=str) == sorted(expected, key=str)
    media = media_archive.media_features(members).groupBy("payload_sha256", "n_bytes").agg(F.count_distinct("media_sha256", "media_bytes", "feature").alias("n"))
    assert media.where("n > 1").count() == 0


def test_no_archives(spark, tmp_path):
    media_archive.write_archives(fixtures.table(spark, []), str(tmp_path))
    assert media_archive.media_features(media_archive.read_archives(spark, str(tmp_path))).count() == 0


def test_members_are_retried_by_offset(tmp_path):
    path = tmp_path / "a.zip"
    path.write_bytes(media_archive._archive([("a", b"first"), ("b", b"second"), ("c", b"third")]))
    with open(path, "rb") as f:
        members = media_archive.directory(f, path.stat().st_size)
    opened = []

    class Flaky:
        """Fails or returns damaged bytes on the first two openings."""

        def __init__(self, p):
            self.f, self.n = open(p, "rb"), len(opened)
            opened.append(p)

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            body = self.f.read(n)
            if self.n == 0:
                raise OSError("connection lost")
            return b"\0" * len(body) if self.n == 1 and n != 30 else body

    at, _, n, crc = members[1]
    body, attempts, file = media_archive.read_member(Flaky, str(path), at, n, crc, wait=0)
    assert (body, attempts, len(opened)) == (b"second", 3, 3)
    at, _, n, crc = members[2]
    assert media_archive.read_member(Flaky, str(path), at, n, crc, file, wait=0)[:2] == (b"third", 1)
    with pytest.raises(OSError):
        media_archive.read_member(lambda p: open(p, "rb"), str(path), at + 1, n, crc, attempts=2, wait=0)
