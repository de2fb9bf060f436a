"""The prefix trie of conversations: what they share from their first turns on, and what training on it once would save.

A node is a distinct sequence of first turns (role and text); the root is the empty one. Conversations that begin with it are its members.

Smallest-member ownership: a node belongs to its smallest member. Who owns a node owns all later nodes of its own path, so that each
conversation owns a suffix of its path, and a first owned depth says it all. The tokens of a subtree's repeats are then those of all
occurrences less those of owned nodes, and its leaves are the owners of childless nodes: each turn of a conversation knows its share, and one
group-by over prefixes sums them up. No subtree is walked and no pair of nodes is met.

A window over a prefix would gather all who share a system prompt in one task. The smallest member of a prefix is therefore a
minimum that Spark aggregates before it shuffles; windows go over single conversations only, and their frames are running ones or spill. A prefix is
known by 128 bits: per turn two hashes over depth, role and text, under seeds of their own, and their running exclusive or.

Ids of those who end at a node are joined in order within ranges of ENDS ids, and a node's ranges go through one running digest,
so that a conversation that has been copied many times is never held as a whole.

Turns go by ``turn`` (nulls first), equal ones by role and by the MD5 of the text. Null role and null text count as empty. Rows with a null id
take no part. Repeated rows are turns of their own. Other columns of the input do not matter. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import plain, stored

#: Ids that are joined by one aggregate.
ENDS = 4096
KEY = ["depth", "p1", "p2"]


def turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``length`` (code points of the text) and two hashes of each turn. Texts are hashed before any exchange."""
    role, text = (F.coalesce(F.col(plain(c)), F.lit("")) for c in (role_col, text_col))
    rows = df.filter(F.col(plain(conv_col)).isNotNull()).select(
        F.col(plain(conv_col)).cast("long").alias("conv_id"), F.col(plain(turn_col)).alias("turn"), role.alias("role"), F.md5(text).alias("tie"), F.length(text).cast("long").alias("length"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "tie")
    return rows.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "length", "t1", "t2")


def with_shared_heads(of: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt so that they share beginnings: the first h turns come from the conversation whose id is the group's first (as many as it has), then
    follow the own turns after the first h; h is the unsigned CRC-32 of the id's digits, modulo ``most``. Columns as ``turns``, ``part`` and ``pos`` in order;
    a row of part -1 stands for each conversation."""
    convs = of.filter("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    donors = of.filter((F.col("conv_id") % group == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "length", "t1", "t2")
    heads = convs.join(donors, "base").filter("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", "length", "t1", "t2")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = of.filter(F.col("pos") > h).select("conv_id", F.lit(1).alias("part"), "pos", "length", "t1", "t2")
    return heads.union(own).union(_roots(of))


def as_they_are(of: DataFrame) -> DataFrame:
    """The same columns for conversations without any change."""
    return of.select("conv_id", F.lit(1).alias("part"), "pos", "length", "t1", "t2").union(_roots(of))


def _roots(of: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return of.filter("pos = 1").select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("pos"), zero.alias("length"), zero.alias("t1"), zero.alias("t2"))


def paths(rows: DataFrame) -> DataFrame:
    """A row for each node on a conversation's path: ``conv_id``, its ``depth``, the prefix ``p1, p2`` and its parent's ``q1, q2``, the tokens ``before`` the node's last
    text, this text's ``length``, the path's ``total`` and its ``last`` depth."""
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("part", "pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mixed = lambda seed, t: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", t)).otherwise(F.lit(0).cast("long"))
    placed = rows.withColumn("depth", (F.row_number().over(order) - 1).cast("long")).withColumn("m1", mixed(3, "t1")).withColumn("m2", mixed(4, "t2"))
    summed = placed.select(
        "conv_id", "depth", "length", "m1", "m2", F.bit_xor("m1").over(so_far).alias("p1"), F.bit_xor("m2").over(so_far).alias("p2"), (F.sum("length").over(so_far) - F.col("length")).alias("before"),
        F.sum("length").over(every).alias("total"), F.max("depth").over(every).alias("last"),
    )
    return summed.select("conv_id", *KEY, F.col("p1").bitwiseXOR(F.col("m1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("m2")).alias("q2"), "before", "length", "total", "last")


def nodes(of: DataFrame) -> DataFrame:
    """From ``paths`` (read several times: give a stored table) to the trie: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``."""
    first = of.groupBy(*KEY).agg(F.min(F.struct("conv_id", "before")).alias("owner"), F.max("last").alias("deepest"))
    # where each owner begins to own, the tokens before that, and whether its path ends in a leaf of its own
    owners = first.groupBy(F.col("owner.conv_id").alias("conv_id")).agg(
        F.min(F.struct("depth", F.col("owner.before").alias("before"))).getField("before").alias("theirs"), F.max(F.when(F.col("deepest") == F.col("depth"), 1).otherwise(0)).alias("leaf")
    )
    # occurrence tokens less owned ones, from this depth on: what lies between here and the first owned node
    share = F.greatest(F.coalesce("theirs", "total") - F.col("before"), F.lit(0))
    counted = of.join(owners, "conv_id", "left").withColumn("share", share)
    made = counted.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum("share").alias("saved_tokens")
    )
    table = stored(made, "nodes")
    below = table.filter("depth > 0")
    parent_key = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = below.groupBy(*parent_key).agg(F.count(F.lit(1)).alias("n_children"))
    parents = table.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    return (
        table.join(children, KEY, "left").join(_ends(of), KEY, "left").join(parents, ["depth", "q1", "q2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def _ends(of: DataFrame) -> DataFrame:
    """The digest of the ids that end at each node, in order, joined by commas: ranges of ids by aggregates, a node's ranges one after the other."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    ranges = of.filter("depth = last").groupBy(*KEY, F.floor(F.col("conv_id") / ENDS).alias("range")).agg(joined.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done = []
            for d, p1, p2, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (d, p1, p2) == key:
                    running.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = (d, p1, p2), hashlib.sha256(ids.encode())
            yield _rows(done)
        if key is not None:
            yield _rows([(*key, running.hexdigest())])

    ordered = ranges.repartition(*KEY).sortWithinPartitions(*KEY, "range").select(*KEY, "ids")
    return ordered.mapInArrow(digest, "depth long, p1 long, p2 long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"depth": pa.int64(), "p1": pa.int64(), "p2": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def trie(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, shared_heads: bool = False) -> DataFrame:
    """The trie of all conversations of ``df``, as they are or rebuilt by ``with_shared_heads``."""
    of = stored(turns(df, conv_col, turn_col, role_col, text_col), "turns")
    return nodes(stored(paths(with_shared_heads(of) if shared_heads else as_they_are(of)), "paths"))
