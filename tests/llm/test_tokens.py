"""Token operators against the libraries themselves, and exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as vocab
import pytest
import tiktoken
from tokenizers import Tokenizer

from rollcall.llm import byte_bpe, packing, token_file, tokens

ALPHABET = "ab Z9é'stredlmv \n\t  .!?$%ñ中 　１²́_-'''ll've  \r​😀ΣA,,.."
DOCS = [(5, "Hello world, it's  a\n\ntest"), (2, None), (9, ""), (7, "x" * 9000 + " tail"), (1, "same text"), (1, "same text"),
        (None, "no id"), (3, "<|endoftext|> is text"), (4, "word " * 3000)]


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], "doc_id long, text string, frame string, part int, found string")


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.choice([0, 1, 2, 5, 20, 80]))) for _ in range(n)]


@pytest.fixture(scope="module")
def rank_encoding():
    path = vocab.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library(name):
    lib = Tokenizer.from_file(vocab.path(name))
    return lambda t: lib.encode(t or "", add_special_tokens=False).ids


def test_scanned_boundaries_give_library_ids(rank_encoding):
    model = byte_bpe.load(vocab.path("byte_bpe_multi_50k.tiktoken"))
    for seed in range(150):
        batch = texts(seed, 7)
        for t, ids in zip(batch, model.encode_texts(batch)):
            assert ids.tolist() == rank_encoding.encode_ordinary(t)
    long = "x" * 2500 + "lorem" * 150
    ids = model.encode_texts([long])[0]
    assert ids.tolist() == rank_encoding.encode_ordinary(long)
    assert model.decode_all(ids)[0] == long.encode()


def test_bpe_round_trip(spark, rank_encoding):
    rows = byte_bpe.round_trip(docs(spark), vocab.path("byte_bpe_multi_50k.tiktoken")).collect()
    want = []
    for i, t in DOCS:
        ids = rank_encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert byte_bpe.round_trip(docs(spark, []), vocab.path("byte_bpe_multi_50k.tiktoken")).count() == 0
    assert byte_bpe.encode_column(docs(spark), vocab.path("byte_bpe_multi_50k.tiktoken")).filter("doc_id = 5").first()["ids"] == \
        rank_encoding.encode_ordinary(DOCS[0][1])


WORDS = ["a", "Bc", "word", " ", " ", "\n", ",", ".", "'s", "23", "\0", "é", "e\u0301", "\u0958", "İ", "ſ", "中文", "\t", "  ", "　", "-", "<|endoftext|>", "<", "|>",
         "x" * 70, "ab" * 40, "\r\n"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("cache", [1_000_000, 50])
def test_joined_words_give_library_ids(name, cache):
    encoder, want, rng = tokens.SliceEncoder(vocab.path(name), cache), library(name), random.Random(cache)
    for _ in range(40):
        batch = ["".join(rng.choices(WORDS, k=rng.randrange(25))) for _ in range(40)]
        ids, counts = encoder.encode(batch)
        for t, part in zip(batch, np.split(ids, np.cumsum(counts)[:-1])):
            assert part.tolist() == want(t)
    assert encoder.encode([])[0].tolist() == [] and encoder.encode(["", ""])[1].tolist() == [0, 0]
    assert not any(len(k) > encoder.LONG for k in encoder.numbers)  # long slices are forgotten


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_slices_give_library_ids(name):
    encoder, want = tokens.load(vocab.path(name)), library(name)
    for seed in range(150):
        batch = texts(seed, 6)
        ids, counts = encoder.encode(batch)
        for t, part in zip(batch, np.split(ids, np.cumsum(counts)[:-1])):
            assert part.tolist() == want(t)


@pytest.mark.parametrize("n,different", [(1, 5), (300, 3), (5000, 50257), (60000, 40)])
def test_frame_round_trip(n, different):
    ids = np.random.default_rng(n).integers(0, different, n).astype(np.uint32)
    frame = token_file.encode_frame([7, None], np.array([1, n - 1]), ids)
    names, counts, back = token_file.decode_frame(frame)
    assert names == [7, None] and counts.tolist() == [1, n - 1] and (back == ids).all()
    assert token_file.encode_frame([1], np.array([n]), np.zeros(n, np.uint32) + 9)  # one symbol only
    broken = bytearray(frame)
    broken[-3] ^= 255
    if n > 1:
        with pytest.raises(ValueError):
            token_file.decode_frame(bytes(broken))
    for at in [*range(44), *range(len(frame) - 24, len(frame)), *range(44, len(frame), max(1, len(frame) // 50))]:
        broken = bytearray(frame)
        broken[at] ^= 255
        with pytest.raises(ValueError):
            token_file.decode_frame(bytes(broken))
    for cut in (0, 3, 40, len(frame) // 2, len(frame) - 1):
        with pytest.raises(ValueError):
            token_file.decode_frame(frame[:cut])


def order0_bits(ids):
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    return float(-(share * np.log2(share)).sum())


def test_frame_size(spark):
    """A whole frame of real texts takes clearly fewer bits than its order-0 entropy; ids without any order lose little against it."""
    encoder = tokens.load(vocab.path("byte_bpe_50k.json"))
    found = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    ids = np.concatenate([encoder.encode(group)[0] for group in tokens.text_groups(found)]).astype(np.uint32)
    ids = ids[:token_file.FRAME_IDS]
    assert 8 * len(token_file.encode_frame([1], np.array([len(ids)]), ids)) < (order0_bits(ids) - 0.3) * len(ids)
    p = 1 / np.arange(1, 5001)
    ids = np.random.default_rng(1).choice(5000, 1_000_000, p=p / p.sum()).astype(np.uint32)
    frame = token_file.encode_frame([1], np.array([len(ids)]), ids)
    assert (token_file.decode_frame(frame)[2] == ids).all()
    assert 8 * len(frame) < (order0_bits(ids) + 0.7) * len(ids)


def test_token_file(spark, tmp_path):
    rows, want, at = DOCS, [], 0
    encode = library("byte_bpe_50k.json")
    token_file.write_token_file(docs(spark), str(tmp_path / "f"), vocab.path("byte_bpe_50k.json"), 2, frame_ids=2000)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode(t) + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_file.read_token_file(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    token_file.write_token_file(docs(spark, []), str(tmp_path / "none"), vocab.path("byte_bpe_50k.json"), 2)
    assert token_file.read_token_file(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_in_the_library(name):
    rng, encode = random.Random(8), library(name)
    found = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", " ", "\n", "  ", "a word", "it's.", "\u1680", "é"]
    rows = ["".join(rng.choices(found, k=rng.randint(0, 9))) for _ in range(400)]
    ids, counts = tokens.SliceEncoder(vocab.path(name)).encode(rows)
    for t, part in zip(rows, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == encode(t), t


def check_places(rows, size):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing(spark):
    encode = library("word_bpe_49k.json")
    rows = packing.pack_documents(docs(spark), vocab.path("word_bpe_49k.json"), per_partition=3, fan=2).collect()
    want = []
    for i, t in DOCS:
        ids = encode(t) + [0]
        for piece, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a:a + 2048]
            want.append((i, piece, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(map(str, want))
    check_places(rows, 2048)
    assert packing.pack_documents(docs(spark, []), vocab.path("word_bpe_49k.json")).count() == 0


def test_rounds_lose_little(spark):
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(1, 300), rng.randint(900, 1300), 2048]) for _ in range(1500)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    whole = len(packing.best_fit(np.array(lengths), 2048)[2])
    rows = packing.pack(pieces, 2048, per_partition=100, fan=3).collect()
    assert len(rows) == len(lengths)
    assert check_places(rows, 2048) <= whole * 1.03 + 1
