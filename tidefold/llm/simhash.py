"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it. Fingerprints link at two
or fewer differing bits. Cut into two segments of 32 bits, one of the two then differs by at most one bit; so every
fingerprint is indexed under the 32 variants of each segment in which one bit is a wildcard, and only those that share a
variant with another one can link.

These are verified through midpoints, not pair by pair, as the members of a common variant would give pairs by the square: two
fingerprints are within two bits over all 64 if and only if some value is within one bit of both. Each gets 65 midpoints, and all
that meet at one link to the least of them. That is exact and linear, whatever the size of a group. Only different fingerprints take part; exact
copies are grouped before.

``keep_one`` may look through several independent fingerprints of a text, which link two texts if any of them does: near copies that miss
each other by a bit in one are met in another. Everything stays exact for the fingerprints that it takes.

Null and empty texts have the fingerprint zero and link like any other. A null id takes part in its group but is
never the least id, except in a group of nulls only. Repeated rows give repeated rows. An empty table gives an empty result. ``fingerprints`` and ``groups``
read the two named columns only; ``keep_one`` gives all columns back as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import resemblance
from tidefold.llm.common import fresh, map_rows, plain, stored, words_of
from tidefold.llm.graph import components

#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash (unsigned) of the word shingles, repeats included; letters A-Z are lower-cased first."""
    return several(text, size, seed, 1)[0]


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of what has these hashes; the 0-th are the hashes themselves."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


def several(text: str | None, size: int, seed: int, count: int) -> list[int]:
    """``count`` fingerprints of a text, each from a hash of its own; the first is ``fingerprint``'s."""
    words = words_of(text)
    if not words:
        return [0] * count
    joined = b" ".join(words).lower()  # bytes: only A-Z change
    if len(words) <= size:
        one = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
        return [int(_mixed(one, k)[0]) for k in range(count)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = len(words) - size + 1, xxhash.xxh64_intdigest
    counts = np.zeros((count, 64), dtype=np.int64)
    for at in range(0, n, AT_ONCE):
        to = min(n, at + AT_ONCE)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist())], dtype=np.uint64)
        for k in range(count):
            counts[k] += np.unpackbits(_mixed(hashes, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * c > n).tobytes(), "big") for c in counts]


def fingerprints(df: DataFrame, id_col: str, text_col: str, size: int = 3, seed: int = 42, count: int = 1) -> DataFrame:
    """The id and ``fp``, the fingerprint as a signed long; with a ``count`` over 1 also ``fp1``, ``fp2`` and so on, the further ones."""

    def make():
        def one(key, text) -> Iterable[tuple]:
            yield key, *(value - (1 << 64) if value >> 63 else value for value in several(text, size, seed, count))

        return one

    kind = df.schema[id_col].dataType.simpleString()
    names = ["fp", *(f"fp{k}" for k in range(1, count))]
    return map_rows(df, make, [plain(id_col), plain(text_col)], f"{plain(id_col)} {kind}, " + ", ".join(f"{n} long" for n in names))


def links(fps: DataFrame) -> DataFrame:
    """From distinct fingerprints (``fp``) to links ``a``, ``b`` (different, at most two bits apart). Not every such pair is
    there, but all pairs are connected by links."""
    # a row becomes 64: a number of partitions that Spark does not merge by size
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    # p: 0-31 the low segment's wildcard bit, 32-63 the high segment's
    variants = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select(
        "fp",
        F.expr(
            "shiftleft(cast(p as long), 32) | "
            "((shiftrightunsigned(fp, cast(p div 32 * 32 as int)) & 4294967295L) & ~shiftleft(1L, cast(p % 32 as int)))"
        ).alias("variant"),
    )
    # counts are aggregated, not taken by a window, so that a variant that very many share is no task's alone and Spark can split its rows
    common = variants.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("variant")
    sharing = stored(variants.join(common.hint("merge"), "variant", "left_semi").select("fp").distinct(), "sharing")
    midpoints = sharing.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("p")).select(F.expr("if(p = 64, fp, fp ^ shiftleft(1L, p))").alias("mid"), "fp")
    least = midpoints.groupBy("mid").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("mid", "a")
    # a merge join at every size: both sides grow with the fingerprints
    return midpoints.join(least.hint("merge"), "mid").filter("a < fp").select("a", F.col("fp").alias("b")).distinct()


def groups(fps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From ids and fingerprints to the same rows with ``component_id``, the least id of all that links reach.
    ``fps`` is read several times: give a stored table."""
    different = stored(fps.groupBy("fp").agg(F.min(plain(id_col)).alias("__least")), "different")
    of = components(links(different.select("fp"))).withColumnRenamed("node", "fp")
    linked = of.join(different, "fp")
    least = linked.groupBy("root").agg(F.min("__least").alias("__component"))
    by_fp = linked.join(least, "root").select("fp", "__component")
    joined = different.join(by_fp, "fp", "left").select("fp", F.coalesce("__component", "__least").alias("component_id"))
    # stored, so that both sides of the last join are plain exchanges, of which Spark can split a very common fingerprint
    return fps.join(stored(joined, "components"), "fp")


def united(nodes: DataFrame, count: int) -> DataFrame:
    """Links between fingerprints ``fp`` of a table with ``fp``, ``fp1`` ... (stored): those of ``fp`` itself, and what the further
    fingerprints link, each told by the least ``fp`` that has it."""
    edges = links(nodes.select("fp").distinct())
    for k in range(1, count):
        of = stored(nodes.groupBy(f"fp{k}").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).withColumnRenamed(f"fp{k}", "other"), "others")
        same = nodes.select("fp", F.col(f"fp{k}").alias("other")).join(of.filter("least < most"), "other").filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
        near = links(of.select(F.col("other").alias("fp")))
        for side in ("a", "b"):
            near = near.join(of.select(F.col("other").alias(side), F.col("least").alias(f"__{side}")), side)
        edges = edges.union(same).union(near.select(F.col("__a").alias("a"), F.col("__b").alias("b")))
    return edges


def _signed(rows: DataFrame) -> DataFrame:
    """``key``, ``fp`` and the set of five-word shingles by name, size and keys, of rows with ``key`` and ``text``."""

    def make():
        def one(key, text) -> Iterable[tuple]:
            value = fingerprint(text)
            yield key, value - (1 << 64) if value >> 63 else value, *resemblance.signature(text)

        return one

    return map_rows(rows, make, ["key", "text"], f"key {rows.schema['key'].dataType.simpleString()}, fp long, node binary, n long, bands array<long>")


def keep_one(df: DataFrame, id_col: str, text_col: str, count: int = 1, resembling: bool = False) -> DataFrame:
    """Of each group (rows whose fingerprints links reach, through any of ``count`` fingerprints) one row of ``df``: the one with the least
    id, nulls last, and of these with the least hash over all columns. Columns as before. ``resembling`` (with one fingerprint) also links texts
    whose five-word shingles have a similarity of 0.8 or more, which fingerprints do not reach: see ``resemblance``."""
    if resembling and count > 1:
        raise ValueError("resembling takes one fingerprint")
    columns = [plain(c) for c in df.columns]
    own, times = fresh(df, "row", "times")
    # xxhash64 passes over nulls: where they stand is hashed too
    row = F.xxhash64(*columns, *(F.col(c).isNull() for c in columns))
    rows = df.withColumn(own, row)
    key = F.struct(F.col(plain(id_col)).isNull().alias("none"), F.col(plain(id_col)).alias("id"), F.col(own).alias("row"))
    keyed = rows.select(key.alias("key"), F.col(plain(text_col)).alias("text"))
    fps = stored(_signed(keyed) if resembling else fingerprints(keyed, "key", "text", count=count), "fingerprints")
    different = stored(fps.groupBy("fp").agg(F.min("key").alias("least")), "different")
    nodes = stored(fps.select("fp", *(f"fp{k}" for k in range(1, count))).distinct(), "nodes") if count > 1 else different
    edges = united(nodes, count)
    if resembling:
        edges = edges.union(resemblance.links(fps, keyed.select("key.row", "text")))
    of = components(edges).withColumnRenamed("node", "fp")
    least = different.join(of, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    occur = fps.groupBy(F.col("key.row").alias(own)).agg(F.count(F.lit(1)).alias(times))
    kept = stored(least.select(F.col("least.row").alias(own)).join(occur, own), "kept")
    # a merge join at every size: what stays grows with the documents
    once = rows.join(kept.filter(F.col(times) == 1).select(own).hint("merge"), own, "left_semi")
    # repeated rows: one stays, aggregated before the exchange
    again = rows.join(kept.filter(F.col(times) > 1).select(own), own, "left_semi").dropDuplicates([own])
    return once.union(again).select(*columns)
