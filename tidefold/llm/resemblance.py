"""Near copies by the Jaccard similarity of their word shingles: 0.8 and more over five words.

SimHash of 64 bits does not reach such pairs: at a similarity of 0.8 two fingerprints differ by about seven bits. So the near-duplicate
stage of the pipeline links these as well. A text's set of shingles has ``BANDS`` keys of ``ROWS`` minima of hashes each; sets that share a key meet, and a
pair that met links if, and only if, the sets themselves are similar enough. At 0.8 a pair shares a key with probability 0.95, at 0.9 with 0.9995.

Members of a key are not paired with each other: all are compared with the key's leader, which is its least member. Leaders leave the key, and so do
members that are like a smaller leader. Those that stay go into the next round, with four times as many leaders (the least of as many parts of the key), until
no key has two members. So a crowd of near copies costs one comparison each; only sets that share a key and are not similar meet more leaders. Nothing is
capped. Of two similar sets that share a key, the larger is linked to something smaller: no two of them can be the least of their groups. Not every link is listed.

Letters A-Z are lower-cased; a text of fewer than five words is one shingle. Texts without words (null, empty, blank) have no keys. Two sets
are the same if 128 bits of their hashes are; shingles are equal if 64 bits are.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import map_rows, stored, words_of

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 6
#: Hashes whose minima are taken at once.
AT_ONCE = 1 << 14
#: Odd factors, so that each gives a permutation of the hashes.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The different shingles' hashes, sorted."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words).lower()  # bytes: only A-Z change
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], 7) for a, b in spans), dtype=np.uint64, count=len(words) - size + 1))


def keys(hashes: np.ndarray) -> list[int]:
    """The set's keys, as signed longs."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), AT_ONCE):
        part = hashes[at : at + AT_ONCE]
        for k, factor in enumerate(FACTORS):
            least[k] = min(least[k], (part * factor).min())
    bands = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(bands)] if len(hashes) else []


def signature(text: str | None) -> tuple[bytes | None, int, list[int]]:
    """Name of the text's set (null: no words), its size, and its keys."""
    found = shingles(text)
    return (xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None), len(found), keys(found)


def _sets(texts: DataFrame) -> DataFrame:
    """``node`` and ``found``, its shingles, of each text in the only column. An array leaves a task as it is, not as Python numbers."""

    def make():
        def one(text) -> Iterable[tuple]:
            found = shingles(text)
            yield xxhash.xxh3_128_digest(found.tobytes()), found.view(np.int64)

        return one

    return map_rows(texts, make, texts.columns, "node binary, found array<long>")


def _alone_gone(members: DataFrame) -> DataFrame:
    """The members of keys that have two and more."""
    common = members.groupBy("k").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("k")
    return members.join(common.hint("merge"), "k", "left_semi")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of different pairs ``a``, ``b`` of nodes those whose sets are similar enough. The smaller side of a crowd's pairs, which they share, joins last, where
    the other's set makes its rows large, so that Spark sees the skew and splits it."""
    one, two = (sets.select(F.col("node").alias(x), F.col("found").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(two.hint("merge"), "b").join(one.hint("merge"), "a").withColumn("same", F.size(F.array_intersect("of_a", "of_b")))
    return both.filter(F.col("same") >= F.lit(SIMILARITY) * (F.size("of_a") + F.size("of_b") - F.col("same")) - 1e-9).select("a", "b", "fa", "fb")


def links(signed: DataFrame, rows: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between fingerprints. ``signed`` (stored) has ``key`` (a struct that orders rows, with a field ``row``), ``fp``, ``node``, ``n`` and
    ``bands``; ``rows`` has the ``row`` and the ``text``. Sets are read again from the texts of those that share a key, one for copies."""
    least = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("key", "fp", "n", "bands")).alias("m"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    nodes = stored(least.select("node", F.col("m.key").alias("key"), F.col("m.fp").alias("fp"), F.col("m.n").alias("n"), F.col("m.bands").alias("bands"), "low", "high"), "nodes")
    # one set, but other fingerprints, which count repeats
    various = nodes.filter("low < high").select("node", F.col("fp").alias("a"))
    edges = signed.select("node", F.col("fp").alias("b")).join(various.hint("merge"), "node").filter("a <> b").select("a", "b").distinct()

    # a row becomes ten: a number of partitions that Spark does not merge by size
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = nodes.repartition(parts, "node").select(F.explode("bands").alias("k"), F.struct("key", "node", "n", "fp").alias("own"))
    members = stored(_alone_gone(members), "members")
    wanted = members.select(F.col("own.key.row").alias("row")).distinct()
    # repeated rows are aggregated before the one exchange of texts
    texts = rows.dropDuplicates(["row"]).join(wanted.hint("merge"), "row", "left_semi").select("text")
    sets = None
    slots = 1
    while not members.isEmpty():
        sets = sets if sets is not None else stored(_sets(texts), "sets")
        slot = F.pmod(F.xxhash64(F.col("own.node")), F.lit(slots))
        leaders = members.groupBy("k", slot.alias("slot")).agg(F.min("own").alias("lead")).select("k", "lead")
        met = members.join(leaders.hint("merge"), "k").filter("own.node <> lead.node")
        near = met.filter(F.least("own.n", "lead.n") >= F.lit(SIMILARITY) * F.greatest("own.n", "lead.n") - 1e-9)
        less, more = F.least("own", "lead"), F.greatest("own", "lead")
        pairs = near.select(less.alias("l"), more.alias("m")).select(F.col("l.node").alias("a"), F.col("m.node").alias("b"), F.col("l.fp").alias("fa"), F.col("m.fp").alias("fb")).distinct()
        linked = stored(_similar(pairs, sets), "linked")
        edges = edges.union(linked.select(F.col("fa").alias("a"), F.col("fb").alias("b")).filter("a <> b"))
        # who leaves a key: its leaders, and who is like a smaller leader of it
        like = near.filter("own > lead").select("k", F.col("lead.node").alias("a"), F.col("own.node").alias("b")).join(linked.select("a", "b").hint("merge"), ["a", "b"], "left_semi")
        gone = like.select("k", F.col("b").alias("node")).union(leaders.select("k", "lead.node"))
        left = members.withColumn("node", F.col("own.node")).join(gone.distinct().hint("merge"), ["k", "node"], "left_anti").drop("node")
        members = stored(_alone_gone(left), "members")
        slots *= 4
    return edges
