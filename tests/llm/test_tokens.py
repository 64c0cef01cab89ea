from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stmtgauge.llm import byte_bpe, queries, token_counts, token_files
from stmtgauge.sources.storage import fresh_folder

DIR = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd():
    draw = random.Random(2)
    texts = ["", "aaaa aaaaaaaaa", "<|endoftext|>hi<|endoftext|>", "  \n\n  x  ", " " * 3000, "it's we'll I'D 123456 ½",
             "H̱ İx ΑΣ Σας ² x y\x85z a­b", "a<|endoftext|>b <|ENDOFTEXT|>", "\x1c\x1d a\x00b", "日本 🙂🙂",
             "x" * 20_000, "".join(draw.choice("etaoinshrdlu") for _ in range(5000))]
    letters = "aBé'sß½ ,.\n\t12漢́ İΣ!?<|>T ​"
    return texts + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(400)]


@pytest.fixture(scope="module")
def odd_rows(spark, odd):
    return spark.createDataFrame([*enumerate(odd), (None, None)], "doc_id BIGINT, text STRING").selectExpr("*", "'z' AS n_tokens", "1 AS ids")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_counts_equal_the_library(spark, odd, odd_rows, texts, monkeypatch):
    library = Tokenizer.from_file(BYTES)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows = queries.op3_token_counts(spark, DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        i: (len(t.encode()), count(t), count(t) > 512) for i, t in texts.items()
    }
    got = token_counts.token_counts(odd_rows, BYTES).collect()
    assert all(r.n_tokens == count(odd[r.doc_id]) for r in got if r.doc_id is not None) and len(got) == len(odd) + 1
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, None, 1, 0, 0, False)]
    assert token_counts.token_counts(odd_rows.limit(0), BYTES).collect() == []
    monkeypatch.setattr(token_counts, "REMEMBERED", 20)  # forgetting changes nothing
    monkeypatch.setattr(token_counts, "BATCH_TOKENS", 15)
    counter = token_counts.Counter(BYTES, public_tokenizers.PATTERN)
    assert list(counter.count(odd)) == [count(t) for t in odd]


@pytest.mark.parametrize("white", [" ", "\n", "\xa0", " \n", "\u3000 ", "\t\x85"])
def test_runs_of_white_space(white):
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(3)
    for around in [("", ""), ("a", ""), ("", "b"), ("a", "b"), ("a", " b"), ("!", "'s"), ("x y", "\x1c9")]:
        for n in (1, 2, 3, 5, 9, 40):
            text = around[0] + white * n + around[1] + white * draw.randint(0, 9) + "end" * draw.randint(0, 1)
            assert byte_bpe.encode(text, enc, 1, 4) == enc.encode_ordinary(text)
    long = white * (1_200_000 // len(white))
    for text in (long, "a" + long, long + "b", "a b" + long + "c d" + long):
        ids = byte_bpe.encode(text, enc)
        assert byte_bpe.decode(ids, enc) == text.encode()
    whole = enc._encode_single_piece(long)
    assert byte_bpe.encode("a" + long, enc) == [*enc.encode_ordinary("a"), *whole]
    assert byte_bpe.encode(long + "b", enc) == [*enc._encode_single_piece(long[:-1]), *enc.encode_ordinary(long[-1] + "b")]


def test_any_text_is_encoded_in_a_task(spark):
    rows = [(1, " " * 2_000_000 + "x"), (2, "\n" * 1_500_000), (3, "y" * 1_000_000), (4, None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    out = byte_bpe.encoded(df, RANKS).selectExpr("doc_id", "n_tokens", "size(ids) AS n", "decoded_sha256 = sha2(coalesce(text, ''), 256) AS same")
    assert all(r.same and r.n == r.n_tokens for r in out.collect())


def test_byte_bpe_equals_the_library_and_round_trips(spark, odd, odd_rows, texts):
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op7_byte_bpe(spark, DIR).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == digest(texts[r.doc_id].encode())
    got = byte_bpe.encoded(odd_rows, RANKS).collect()
    assert all(r.ids == enc.encode_ordinary(odd[r.doc_id]) for r in got if r.doc_id is not None)
    assert [r.ids for r in got if r.doc_id is None] == [[]]
    assert all(byte_bpe.encode(t, enc, 5) == enc.encode_ordinary(t) for t in odd)
    assert byte_bpe.decode(enc.encode_ordinary("🙂")[:1], enc) == "🙂".encode()[: len(byte_bpe.decode(enc.encode_ordinary("🙂")[:1], enc))]
    assert byte_bpe.encoded(odd_rows.limit(0), RANKS).collect() == []


def test_codes_are_directly_addressable():
    ids = np.array([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1] * 300, np.uint32)
    np.random.default_rng(1).shuffle(ids)
    dac = token_files.Dac.encode(ids)
    data = memoryview(b"??" + dac.to_bytes())
    back, stop = token_files.Dac.read(data, 2, len(dac.levels))
    assert stop == len(data) and (back.decode() == ids).all()
    assert all(back[i] == x for i, x in enumerate(ids.tolist()))
    assert len(token_files.Dac.encode(ids[:0]).decode()) == 0


def test_encoder_equals_the_library(odd, monkeypatch):
    library = Tokenizer.from_file(WORDS)
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert token_files.Encoder(WORDS).encode([t.encode() for t in odd]) == want
    monkeypatch.setattr(token_files, "REMEMBERED", 10)
    encoder = token_files.Encoder(WORDS)
    assert [encoder.encode([t.encode()])[0] for t in odd] == want


def test_token_files_query(spark, texts, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 3000)
    library, at = Tokenizer.from_file(WORDS), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_files(spark, DIR).collect()}
    for i in sorted(texts):
        raw = np.array(library.encode(texts[i], add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert got.pop(i) == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert not got


def test_token_files_of_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(None, "x y"), (5, None), (5, None), (3, "q\n\nr"), (None, "b")], "doc_id BIGINT, text STRING")
    for rows, want in (
        (df, [(None, 0, 2), (None, 2, 3), (3, 5, 3), (5, 8, 1), (5, 9, 1)]),
        (df.limit(0), []),
    ):
        folder = fresh_folder(spark, "tokens")
        token_files.token_files(rows.selectExpr("*", "1 AS part", "2 AS ids"), WORDS, folder)
        read = token_files.read_token_files(spark, folder).collect()
        assert sorted(((r.doc_id, r.start, r.n_tokens) for r in read), key=lambda r: r[1]) == want
