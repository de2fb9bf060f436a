"""Cuts against slicing, checkpoints against counting, outputs against a plain rewrite."""

import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F
from tidefold.llm import fim

TEXTS = ["", None, "a", "é", "plain words here", "日本語のテキスト" * 40, "mixed é ☃ 🙂 text " * 300, "has <P> inside", "ends <", "<S", "x" * 70_000, "🙂" * 9_000, "\x00\n\t  "]


def slow(doc_id, text):
    """The contract over Python strings."""
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("every", [1, 3, 1024])
def test_checkpoints(every, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 7)  # blocks end inside code points
    for text in TEXTS:
        text = (text or "")[:3000]
        index = fim.Checkpoints(text.encode(), every)
        assert (index.n, index.chars) == (len(text), len(text)) and len(index.units) == max(1, -(-len(text) // every))
        for k in {0, 1, every - 1, every, every + 1, len(text) // 2, len(text) - 1, len(text), len(text) + 5} & set(range(len(text) + 9)):
            assert index.cut(k) == (len(text[:k].encode()), min(k, len(text)))


@pytest.mark.parametrize("every", [1, 4, 100])
def test_units_by_pattern(every):
    pattern = regex.compile(r"\S+")
    for text in TEXTS[4:] + ["  begins blank é x", "   "]:
        index, starts = fim.Checkpoints(text.encode(), every, pattern), [m.start() for m in pattern.finditer(text)]
        assert index.n == len(starts)
        for k in range(1, min(len(starts), 400)):
            assert index.cut(k) == (len(text[: starts[k]].encode()), starts[k])
        assert index.cut(0) == (0, 0) and index.cut(index.n) == (len(text.encode()), len(text)) or not index.n


def test_documents(spark):
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, "".join(rng.choices("ab é🙂<PSM>", k=rng.randint(0, 60)))) for k in range(400)] + [(None, "no id"), (7, "twice"), (7, "twice"), (-3, "below zero")]
    df = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], "doc_id long, text string, form string, n int, `a.b` string")
    made = fim.transform(df, "doc_id", "text").withColumn("back", fim.restored())
    got = made.collect()
    found = sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=str)
    assert found == sorted(((k, *slow(k, t), t or "") for k, t in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_invalid_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff\xfe abc \x80 def")), (2, bytearray(b"\xc3"))], "doc_id long, raw binary").withColumn("text", F.col("raw").cast("string"))
    assert fim.transform(df, "doc_id", "text").count() == 2
    assert fim.transform(df, "doc_id", "text", fim.Settings(unit=r"\w+")).count() == 2
    assert fim.transform(df.limit(0), "doc_id", "text").collect() == []


def test_markers():
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<a", "x<", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.Settings(*bad)
    assert fim.Settings("<|p|>", "<|s|>", "<|m|>").markers[1] == "<|s|>"
