"""Near copies of similarity 0.8 and more against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tidefold.llm import resemblance, simhash


def slow_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def judge(rows, kept):
    """From (id, text) rows with different ids: do exactly the least of groups stay that true links make (each that went has a true
    link to a group with a smaller one, each group keeps one), near copies both of which stayed, and all near copies."""
    sets, fps = [slow_set(t) for _, t in rows], [simhash.fingerprint(t) for _, t in rows]
    where = {}
    for k, own in enumerate(sets):
        for shingle in own:
            where.setdefault(shingle, []).append(k)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    missed = met = 0
    for a in range(len(rows)):
        shared = {}
        for shingle in sets[a]:
            for b in where[shingle]:
                if b < a:
                    shared[b] = shared.get(b, 0) + 1
        for b in range(a):
            like = 5 * shared.get(b, 0) >= 4 * (len(sets[a]) + len(sets[b]) - shared.get(b, 0)) > 0
            close = (fps[a] ^ fps[b]).bit_count() <= 2
            met += like and not close
            missed += like and not close and rows[a][0] in kept and rows[b][0] in kept
            if like or close:
                root[find(a)] = find(b)
            assert not (close and rows[a][0] in kept and rows[b][0] in kept)
    groups = {}
    for a, (i, _) in enumerate(rows):
        groups.setdefault(find(a), []).append(i)
    stay = kept <= {i for i, _ in rows} and all(min(own) in kept for own in groups.values())
    return stay, missed, met


def made(seed, groups, sizes, edits):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for k in range(groups):
        words = [word() for _ in range(rng.randrange(60, 300))]
        for j in range(rng.choice(sizes)):
            copy = list(words)
            for _ in range(round(len(copy) * rng.choice(edits))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((1000 * k + j, " ".join(copy)))
    rng.shuffle(rows)
    return rows


def kept_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id for r in simhash.keep_one(df, "doc_id", "text", resembling=True).select("doc_id").collect()}


def test_sets_and_keys():
    for text in [None, "", " \n", "One", "a b c d", "a b c d e", "A b c D e f a b c d e f", "ä Ö\x0bü ß x " * 9000]:
        assert len(resemblance.shingles(text)) == len(slow_set(text))
        node, n, keys = resemblance.signature(text)
        assert (node is None) == (n == 0) and len(keys) == (resemblance.BANDS if n else 0)
    assert resemblance.signature("A b c d E f") == resemblance.signature("a  B c d e f\n")


def test_near_copies_go(spark):
    """Pairs of 0.8 and more that fingerprints miss: at most a twentieth survives, and nothing goes without a true link."""
    rows = made(3, 60, [1, 2, 3, 12], [0, 0.005, 0.01, 0.015, 0.02])
    rows += [(90_000, None), (90_001, ""), (90_002, "one"), (90_003, "ONE"), (90_004, "one two three four"), (90_005, "five other words stand here")]
    kept = kept_of(spark, rows)
    stay, missed, met = judge(rows, kept)
    assert stay and met > 200 and missed <= 0.05 * met, (stay, missed, met)
    assert {90_000, 90_002, 90_004, 90_005} <= kept and not {90_001, 90_003} & kept


def test_crowded_keys_lose_nothing(spark):
    """If all texts share a key, no two near copies stay, over several rounds of leaders."""
    rows = made(4, 25, [1, 1, 2, 5], [0, 0.01, 0.02])
    signed = [(((i is None), i, i), simhash.fingerprint(t), *resemblance.signature(t)) for i, t in rows]
    signed = [(k, fp - (1 << 64) if fp >> 63 else fp, node, n, [1]) for k, fp, node, n, _ in signed]
    frame = spark.createDataFrame(signed, "key struct<none: boolean, id: long, row: long>, fp long, node binary, n long, bands array<long>")
    found = {(r.a, r.b) for r in resemblance.links(frame, spark.createDataFrame(rows, "row long, text string")).collect()}
    sets = [slow_set(t) for _, t in rows]
    like = lambda x, y: 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])
    of = {}
    for x, (_, fp, *_) in enumerate(signed):
        of.setdefault(fp, []).append(x)
    assert found and all(any(like(x, y) for x in of[a] for y in of[b]) for a, b in found)
    root = {fp: fp for fp in of}

    def find(fp):
        while root[fp] != fp:
            fp = root[fp]
        return fp

    for a, b in found:
        root[find(a)] = find(b)
    least = {}
    for x in range(len(rows)):
        at = find(signed[x][1])
        if at not in least or rows[x][0] < rows[least[at]][0]:
            least[at] = x
    assert not any(x < y and like(x, y) for x in least.values() for y in least.values())


def test_repeats_ties_and_odd_tables(spark):
    prose = " ".join(f"word{k}" for k in range(60))
    rows = [(1, prose, "x", 1), (1, prose, "x", 1), (2, prose + " more", None, 2), (None, prose + " again and", "n", None), (7, "quite another text of some words", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, node int")
    kept = simhash.keep_one(df, "doc_id", "text", resembling=True)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[4]]
    assert simhash.keep_one(df.limit(0), "doc_id", "text", resembling=True).count() == 0
    assert simhash.keep_one(df.filter(F.col("doc_id").isNull()), "doc_id", "text", resembling=True).count() == 1
    with pytest.raises(ValueError):
        simhash.keep_one(df, "doc_id", "text", 2, True)
