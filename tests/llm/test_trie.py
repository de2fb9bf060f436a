"""The trie against one built node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from tidefold.llm import trie


def slow(rows, rebuild):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in by.items()}
    paths = own
    if rebuild:
        paths = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            paths[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members, last = defaultdict(list), {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        last[c] = tuple(p)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in ids if last[c] == node)))
        kids = lambda x: [y for y in members if len(y) == len(x) + 1 and y[: len(x)] == x]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids(node)), sum(not kids(x) for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **more):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in trie.trie(df, "conv_id", "turn", "role", "text", **more).select(*columns).collect()), key=str)


SCHEMA = "conv_id long, turn int, role string, text string, depth string, p1 int, `n leaves` int"


@pytest.mark.parametrize("rebuild", [False, True])
def test_random_conversations(spark, rebuild):
    rng = random.Random(3)
    rows = []
    for c in [*range(95, 130), 200, 201, 300, 7, 999, 10_000, 10_001]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", None]), rng.choice(["a", "bé", "", None, "long text"])))
    rows += rng.sample(rows, 5)  # repeated rows are turns of their own
    rows += [(None, 1, "user", "nobody's")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    assert found(df, shared_heads=rebuild) == slow(rows, rebuild)


def test_copies_and_ranges_of_ids(spark):
    """Ids of many copies go through several ranges, in order; a copy owns nothing."""
    rows = [(c, t, "user", f"turn {t}") for c in range(4000, 4300) for t in range(2)] + [(c, 0, "user", "turn 0") for c in (1, 9_000, 50_000)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = found(df)
    assert got == slow(rows, False)
    assert [(r[0], r[1], r[3], r[6]) for r in got if r[1] == 2] == [(4000, 2, 300, 299 * 6)]


def test_a_shared_head_may_be_all_there_is(spark):
    """A conversation shorter than h keeps no turn of its own and may have none at all."""
    short = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 6 == 5][:6]
    rows = [(c, 1, "user", f"own {c}") for c in short] + [(100, t, "user", f"t{t}") for t in range(3)]
    got = found(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA), shared_heads=True)
    assert got == slow(rows, True) and any(r[1] == 3 for r in got)


def test_empty(spark):
    df = spark.createDataFrame([(None, 1, "user", "t", "x", 1, 2)], SCHEMA)
    assert found(df) == [] and found(df.limit(0), shared_heads=True) == []


def test_long_conversation(spark):
    rows = [(1, t, "user", "x" * (t % 5)) for t in range(3000)] + [(2, t, "user", "x" * (t % 5)) for t in range(1500)]
    got = found(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA))
    assert len(got) == 3001 and max(r[6] for r in got) == sum(t % 5 for t in range(1500))
