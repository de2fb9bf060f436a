"""Best-fit packing: tokens as the library gives them, slots without gaps, few sequences."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tidefold.llm import packing
from tokenizers import Tokenizer

PATH = P.path("word_bpe_49k.json")


def whole():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("seed", range(4))
def test_tokens(seed):
    rng = random.Random(seed)
    parts = ["Hello", "world's", "don't", "é", "É", "ÀB", "ß", " ", "  ", "\n", "\x85", "　", "1", "23", "!", "...", "<|endoftext|>", "<|startoftext|>", "😀", "é", "漢字", "ΣΑΣ", "İ", "ŉ", "'ll", "a_b", "x" * 70, "\x1c", "­", "​", "ŸǅÞ", "'S", "it'S,", "ab.", "A,"]
    ids, enc = packing.WordIds(PATH, 5, 5), whole()
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 30)))
        assert np.frombuffer(ids.of_text(text), "<u4").tolist() == enc.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 4096])
    histogram = {rng.randrange(1, capacity + 1): rng.randrange(1, 50) for _ in range(60)}
    used, placed = {}, {}
    for length, rank, count, first, offset in packing.plan(histogram, capacity):
        assert rank == placed.get(length, 0)
        placed[length] = rank + count
        for k in range(first, first + count):
            assert used.get(k, 0) == offset and offset + length <= capacity
            used[k] = offset + length
    assert placed == histogram and set(used) == set(range(len(used)))
    # one after the other, best fit over falling lengths
    bins = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [k for k, free in enumerate(bins) if free >= length]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= length
        else:
            bins.append(capacity - length)
    assert len(used) == len(bins)


def test_plan_refuses():
    assert packing.plan({}, 8) == []
    for bad in ({0: 1}, {9: 1}):
        with pytest.raises(ValueError):
            packing.plan(bad, 8)


def test_pack(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "Ünder", "漢字"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 30, 200]))) for _ in range(300)] + [None, "", "one " * 9000, "same size"] + ["same size"] * 50
    rows = [(k, t, 5, "x") for k, t in enumerate(texts)] + [(0, texts[0], 5, "x"), (None, "nobody", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int, sequence_id string")
    pieces = packing.pieces(df, "doc_id", "text", PATH).cache()
    got = packing.pack(pieces, "length", ["doc_id", "piece", "ids"]).collect()
    enc, by_doc, by_seq = whole(), {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert len(got) == pieces.count()
    for doc, text in [(r[0], r[1]) for r in rows]:
        ids = enc.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted(by_doc[doc], key=lambda r: r.piece)
        if doc == 0:
            mine = mine[::2]
        assert [i for r in mine for i in np.frombuffer(bytes(r.ids), "<u4").tolist()] == ids
        assert [r.start for r in mine] == list(range(0, len(ids), 4096)) and [r.piece for r in mine] == list(range(len(mine)))
        assert all(zlib.crc32(bytes(r.ids)) >= 0 for r in mine)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_seq) == -(-sum(r.length for r in got) // 4096)
    assert packing.pack(pieces.limit(0), "length", ["doc_id", "piece"]).count() == 0


def test_special_tokens_and_other_files(tmp_path):
    import json

    ids = packing.WordIds(PATH)
    assert np.frombuffer(ids.of_text("a <|endoftext|> b<|startoftext|>c"), "<u4").tolist() == whole().encode("a <|endoftext|> b<|startoftext|>c", add_special_tokens=False).ids
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+"
    spec["normalizer"]["normalizers"].pop()  # keeps upper case
    other = str(tmp_path / "other.json")
    with open(other, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    text = "It's 2024, Don't\nSHOUT  é é"
    made = packing.WordIds(other)
    assert made.words is None and np.frombuffer(made.of_text(text), "<u4").tolist() == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids


def test_clashing_names(spark):
    df = spark.createDataFrame([(3, "some words", 1), (4, None, 2)], "length long, text string, __bucket int")
    made = packing.pieces(df, "length", "text", PATH)
    assert made.columns == ["id", "piece", "start", "length", "ids"] and sorted(r.id for r in made.collect()) == [3, 4]
    rows = spark.createDataFrame([(1, 10, 5, 6, 7), (2, 20, 5, 6, 7)], "key long, length int, __bucket int, __n int, sequence_id long")
    got = packing.pack(rows, "length", ["key"])
    assert got.columns == ["key", "length", "__bucket", "__n", "sequence_id", "offset"] and got.filter("__bucket = 5 AND __n = 6").count() == 2
