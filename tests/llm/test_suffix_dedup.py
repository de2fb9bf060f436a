"""Sparse suffix arrays against all windows, one by one."""

import random

import numpy as np
import pytest
from tidefold.llm import suffix_dedup as sd


def brute(docs, least):
    """{(doc, text): (again, first)} by comparing all windows of ``least`` words."""
    places = {}
    for doc, text in {(d, t) for d, t in docs if d is not None and t is not None}:
        words = text.encode().split()
        for s in range(len(words) - least + 1):
            places.setdefault(tuple(words[s : s + least]), []).append((doc, sd._tag(text), s))
    out = {}
    for found in places.values():
        if len(found) < 2:
            continue
        first = min(found)
        for doc, tag, s in found:
            again, firsts = out.setdefault((doc, tag), (set(), set()))
            if (doc, tag, s) == first:
                firsts.update(range(s, s + least))
            else:
                again.update(range(max(s, first[2] + least) if (doc, tag) == first[:2] else s, s + least))
    return {k: (again, firsts - again) for k, (again, firsts) in out.items() if again or firsts}


def covered(spans):
    return {w for a, b in spans for w in range(a, b)}


def check(spark, docs, least, window, gram):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sd._columns(df, "doc_id", "text")
    assert sd.suffixes(plain, least, window, gram).count() >= 0
    got = {(r.doc, r.tag): (covered(r.again), covered(r.first)) for r in sd.repeats(df, least=least, window=window).collect()}
    assert got == brute(docs, least)
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_windows(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(2000)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([20, 24, 25, 26, 40, 90]))] for _ in range(8)]
    docs = []
    for doc in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words) + 1)
            p = rng.choice(passages)
            a = rng.randrange(0, 4)
            words[at:at] = p[a : len(p) - rng.randrange(0, 4)]
        docs.append((doc, " ".join(words)))
    docs += [(100 + k, docs[k][1]) for k in range(10)] + [docs[3], docs[4], (7, "x " * 30 + docs[7][1])]
    got = check(spark, docs, 24, 12, 5)
    assert got


def test_low_variety_and_edges(spark):
    docs = [(1, "ha " * 300), (2, "ha " * 200 + "end"), (3, "a b " * 100), (4, ""), (5, None), (None, "ha " * 100), (6, "one two"), (8, "b a " * 60)]
    docs += [(20 + p, " ".join(f"p{p}x{k % p}" for k in range(110))) for p in (7, 17, 23, 28, 40)]  # periods that overlap themselves
    check(spark, docs, 24, 12, 5)


def test_cut_keeps_the_first_and_the_rest(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(1, "alpha\nbeta " + passage + " gamma"), (2, f"delta  {passage}\nepsilon"), (3, passage), (4, "clean text"), (5, None), (6, "")]
    df = spark.createDataFrame([(d, t, "x", d, d) for d, t in docs], "doc_id long, text string, tag string, first long, doc long")
    got = {r.doc_id: r.text for r in sd.remove_repeats(df).collect()}
    assert got == {1: docs[0][1], 2: "delta  epsilon", 4: "clean text", 5: None, 6: ""}
    assert sd.remove_repeats(df).columns == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.repeats(df).count() == 0 and sd.remove_repeats(df).count() == 0


def test_text_ids(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [("one", f"alpha {passage}"), ("two", f"{passage} beta"), (None, passage), ("three", "clean")]
    made = {r.name: r.text for r in sd.remove_repeats(spark.createDataFrame(docs, "name string, text string"), "name", "text").collect()}
    assert sorted(made[k].count("p1 ") for k in ("one", "two")) == [0, 1] and made["three"] == "clean" and made[None] == passage


def test_equal_first_hashes_are_not_enough(spark, monkeypatch):
    """With a first hash that takes all windows for equal, the second one still tells them apart."""
    ranges = sd.Hashes.ranges
    docs = [(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(6)]
    opened = spark.createDataFrame([(k, sd._tag(t), 0, 5) for k, t in docs], "doc long, tag long, lo int, hi int")
    plain = spark.createDataFrame(docs, "doc long, text string")

    class Blind(sd.Hashes):
        def ranges(self, sums, start, end, which=0):
            return ranges(self, sums, start, end, which) * (which > 0)

    monkeypatch.setattr(sd, "Hashes", Blind)
    assert sd.extended(plain, opened, 24).count() == 0
    twice = spark.createDataFrame([*docs, (9, docs[0][1])], "doc long, text string")
    assert sd.extended(twice, opened.union(spark.createDataFrame([(9, sd._tag(docs[0][1]), 0, 5)], opened.schema)), 24).count() == 12


def test_whole_matches_ask_both_hashes(spark, monkeypatch):
    """With a first hash that takes all ranges of 50 words and more for equal, texts that share 40 words only share no passage."""
    ranges = sd.Hashes.ranges
    shared = [f"s{k}" for k in range(40)]
    docs = spark.createDataFrame([(d, " ".join([f"d{d}a{k}" for k in range(8)] + shared + [f"d{d}b{k}" for k in range(8)])) for d in range(3)], "doc_id long, text string")

    class Blind(sd.Hashes):
        def ranges(self, sums, start, end, which=0):
            return np.where(np.asarray(end) - np.asarray(start) >= 50, np.uint64(7), ranges(self, sums, start, end, which)) if not which else ranges(self, sums, start, end, which)

    monkeypatch.setattr(sd, "Hashes", Blind)
    assert sd.repeats(docs).count() == 0


def test_clashing_names(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    df = spark.createDataFrame([(1, f"a {passage}", "x", "y", 5), (2, f"{passage} b", "x", "z", 6)], "doc_id long, text string, __of string, __cuts string, __new int")
    got = {r.doc_id: tuple(r) for r in sd.remove_repeats(df).collect()}
    assert got[1] == (1, f"a {passage}", "x", "y", 5) and got[2] == (2, "b", "x", "z", 6)
