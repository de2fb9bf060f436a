"""SimHash fingerprints, links and groups against brute force."""

import random
import re

import xxhash
from pyspark.sql import functions as F
from tidefold.llm import simhash as s
from tidefold.llm.graph import components


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(pairs):
    """{row: least id} for (id, fingerprint) rows."""
    root = list(range(len(pairs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(pairs)):
        for b in range(a):
            if (pairs[a][1] ^ pairs[b][1]).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, fp, least.get(find(a))) for a, (i, fp) in enumerate(pairs)), key=str)


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "one two", "a b c", "a b c d", "ÄA b ß c", "x " * 70_000, "A B\tC\x0bd\x1ce f", "rep rep rep rep"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: r.fp % (1 << 64) for r in s.fingerprints(df, "doc_id", "text").collect()}
    assert got == {k: slow_fingerprint(t) for k, t in enumerate(texts)}
    for word in ("abc", "ünï"):
        assert spark.range(1).select(F.xxhash64(F.lit(word))).first()[0] % (1 << 64) == s.fingerprint(word)


def test_groups(spark):
    rng = random.Random(2)
    fps = []
    for _ in range(12):  # clusters and chains of bit flips, some of them crowded
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            fps.append(base)
            if rng.random() < 0.6:
                base ^= (1 << rng.randrange(64)) ^ (rng.random() < 0.5) * (1 << rng.randrange(64))
    fps += [0, 1, 3, 1 << 63, (1 << 63) | (1 << 31)] + fps[:5]
    pairs = [(rng.randrange(10_000), f) for f in fps] + [(None, fps[0]), (None, rng.getrandbits(64))]
    pairs += pairs[:2]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in pairs], "doc_id long, fp long")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in s.groups(df, "doc_id").collect()), key=str)
    assert got == slow_groups(pairs)


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(1000, 1001), (7, 7), (None, 3)], "a long, b long"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


def test_keep_one(spark):
    rows = [(5, "same text of a few words here", "x"), (3, "same text of a few words here", "y"), (9, "quite another thing that stands alone", "z"), (3, "same text of a few words here", "y"), (7, None, "n"), (8, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = s.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 7, 9]
    assert s.keep_one(df.limit(0), "doc_id", "text").count() == 0


def test_keep_one_of_each_group(spark):
    """Groups of null ids keep a row; unrelated texts under one id both stay; the survivor is a row of its own group."""
    a, b, c = ("first text of some words alone", "second thing said about other matters", "third and last of all the stories told")
    rows = [(None, a, "x"), (None, a, "y"), (1, b, "x"), (1, c, "x"), (1, c, "x"), (2, b, None), (None, b, "n"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    kept = [tuple(r) for r in s.keep_one(df, "doc_id", "text").collect()]
    assert len(kept) == 4 and set(kept) <= set(rows)
    assert sorted((r[0] or 0, r[1] or "") for r in kept) == sorted([(0, a), (1, b), (1, c), (0, "")])


def slow_kept(rows):
    """The least id of each group of (id, fingerprints) rows that links of any of the fingerprints reach."""
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if any((x ^ y).bit_count() <= 2 for x, y in zip(rows[a][1], rows[b][1])):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted(least.values())


def test_several_fingerprints(spark):
    """Near copies that one fingerprint misses are met by another; the rest stays."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for k in range(25):
        words = [word() for _ in range(rng.randrange(100, 300))]
        for j in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((100 * k + j, " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9002, "one"), (9003, "One")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(i, s.several(t, 3, 42, 4)) for i, t in rows]
    assert all(f[0] == s.fingerprint(t) for (_, f), (_, t) in zip(found, rows)) and len(set(found[0][1])) == 4
    one, four = slow_kept([(i, f[:1]) for i, f in found]), slow_kept(found)
    assert sorted(r.doc_id for r in s.keep_one(df, "doc_id", "text").collect()) == one
    assert sorted(r.doc_id for r in s.keep_one(df, "doc_id", "text", 4).collect()) == four
    assert len(four) < len(one)


def test_keep_one_leaves_clashing_names_alone(spark):
    df = spark.createDataFrame([(1, "a b c d", 7, "x", 1), (2, "a b c d", 8, "y", 2), (3, "other words", 9, "z", 3)], "doc_id long, text string, __row int, __times string, fp int")
    assert sorted(map(tuple, s.keep_one(df, "doc_id", "text", 2).collect())) == [(1, "a b c d", 7, "x", 1), (3, "other words", 9, "z", 3)]
