"""Byte-level BPE against tiktoken on whole texts, and back."""

import hashlib
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tidefold.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_safe(seed):
    rng = random.Random(seed)
    alphabet = ["a", "B", "é", "'s", "'", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\u200b", " ", "　", "1", "23", "!", "<|endoftext|>", "😀", "́", "漢"]
    text = "".join(rng.choices(alphabet, k=3000))
    enc = bpe.encoder(PATH, P.PATTERN)
    for size in (1, 2, 7, 100):
        parts = list(bpe.safe_parts(text, size))
        assert "".join(parts) == text and len(parts) > 1
        assert bpe.ids_of(text, enc, size).tolist() == enc.encode_ordinary(text)


def test_round_trip(spark):
    texts = ["", None, "plain words", " lead and trail \n", "<|endoftext|>", "😀漢字 é", "x" * 300_000, " " * 5000 + "a", "a b " * 100_000, "plain words"]
    df = spark.createDataFrame([(k, t, 7, b"z") for k, t in enumerate(texts)], "doc_id long, text string, token_ids int, decoded binary")
    made = bpe.encode(df, "text", PATH, P.PATTERN)
    both = bpe.digests(bpe.decode(made, "token_ids", PATH, P.PATTERN)).collect()
    once = {r.doc_id: bytes(r.decoded) for r in bpe.encode(df, "text", PATH, P.PATTERN, decoded="decoded").collect()}
    enc = bpe.encoder(PATH, P.PATTERN)
    assert len(both) == len(texts)
    for r in both:
        text = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert r.token_ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode() == once[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(df.limit(0), "text", PATH, P.PATTERN).count() == 0


def test_bytes_need_not_be_characters(spark):
    enc = bpe.encoder(PATH, P.PATTERN)
    half = enc.encode_ordinary("漢")[:1]
    df = spark.createDataFrame([(half,), (None,)], "ids array<int>")
    got = [r.decoded for r in bpe.decode(df, "ids", PATH, P.PATTERN).orderBy(F.col("ids").isNull()).collect()]
    assert bytes(got[0]) == enc.decode_bytes(half) and got[1] is None
