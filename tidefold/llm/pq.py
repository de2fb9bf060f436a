"""Near-duplicate embeddings through product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

Two vectors link if their cosine is ``similarity`` or more. All vectors are scaled to length one, where that is a distance of at most
``radius``. Equal vectors are one class with a size; a class is known by 128 bits of its vector.

Index: coarse centroids and codebooks are fitted on about ``sample`` vectors (a share of all by hash; ``per_cell`` vectors a centroid). Every vector
stands in the list of its nearest centroid, with its residual coded in ``subspaces`` parts and the length of what the code leaves out.

Probes: a vector is looked for in each list whose border with its own list is near enough that a partner may lie beyond it. A partner is at most
``radius`` away, and its part across the border is about ``radius`` / sqrt(length) if it points anywhere; lists within ``reach`` times that
are probed (never more than ``radius``, beyond which no partner can lie). A pair is met in the list of either member, if the other probes it.

In a list, distances between vectors and codes are sums of table entries. As a code is off by a known length, no pair within the radius
is lost there: what stays is compared by the cosine of the vectors themselves, in double precision.

Lists meet in blocks of at most about ``block`` members (``bytes`` of them) and as many visitors, so that a list that holds a third of all vectors is work for
many tasks. A block gives each class the number of its links there, and a spanning forest of these links, never the pairs. A pair that can be met
in two lists counts in the one that comes first.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different length never link. Lengths of which the sample
holds nothing have one list. Null ids link with nothing, have no component and are not kept. Repeated ids and repeated rows are vectors of their own
and count as such; a component's name is its smallest id. An empty table gives an empty result. Other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import bounded, plain, stored
from tidefold.llm.graph import components


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.95
    per_cell: int = 512
    most_cells: int = 4096
    sample: int = 131_072
    subspaces: int = 8
    codes: int = 256
    reach: float = 3.0
    block: int = 2048
    bytes: int = 32 << 20
    seed: int = 7

    @property
    def radius(self) -> float:
        return math.sqrt(2 - 2 * self.similarity)


@dataclass
class Book:
    """Centroids (cells, length), and of each subspace its part of the vector and its codewords."""

    centroids: np.ndarray
    parts: list[slice]
    words: list[np.ndarray]

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances between centroids, made once a worker."""
        return np.sqrt(_distances(self.centroids, self.centroids)).astype(np.float32)


# --- fitting ----------------------------------------------------------------------------------------------------------


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _nearest(a: np.ndarray, b: np.ndarray, at_once: int = 4096) -> np.ndarray:
    return np.concatenate([_distances(a[k : k + at_once], b).argmin(1) for k in range(0, len(a), at_once)]) if len(a) else np.zeros(0, dtype=np.int64)


def _means(points: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm; centres that lose all their points stay where they are."""
    centres = points[rng.choice(len(points), min(count, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(points: np.ndarray, cells: int, s: Settings) -> Book:
    """A book from unit vectors of one length."""
    rng = np.random.default_rng([s.seed, points.shape[1]])
    points = points.astype(np.float32)
    centroids = _means(points, max(1, min(cells, len(points))), rng)
    residuals = points - centroids[_nearest(points, centroids)]
    cuts = np.linspace(0, points.shape[1], min(s.subspaces, points.shape[1]) + 1).astype(int)
    parts = [slice(int(a), int(b)) for a, b in zip(cuts, cuts[1:])]
    return Book(centroids, parts, [_means(residuals[:, p], s.codes, rng) for p in parts])


# --- vectors ----------------------------------------------------------------------------------------------------------


def _unit(values: list | None) -> np.ndarray | None:
    """The vector at length one, or None where it takes no part."""
    if not values or any(x is None for x in values):
        return None
    v = np.array(values, dtype=np.float64)
    top = np.abs(v).max()
    if not np.isfinite(v).all() or top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``key`` (of the vector; null: takes no part), ``dims`` and ``unit`` (doubles of the scaled vector as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, units = [], [], []
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = _unit(values) if key is not None else None
                # equal numbers have equal bytes: minus zero is zero
                raw = None if v is None else (v + 0.0).tobytes()
                keys.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
                dims.append(0 if v is None else len(v))
                units.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["id", "key", "dims", "unit"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = bounded(df).select(F.col(plain(id_col)).alias("id"), F.col(plain(vector_col)).alias("v"))
    return rows.mapInArrow(run, f"id {kind}, key binary, dims int, unit binary")


def _matrix(raw: list[bytes] | pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(-1, dims)


def probes(unit: np.ndarray, book: Book, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's own cell, and which cells it probes (vectors, cells)."""
    far = _distances(unit, book.centroids.astype(np.float64))
    own = far.argmin(1)
    across = (far - far[np.arange(len(far)), own][:, None]) / (2 * np.maximum(book.apart[own], 1e-12))  # to the border between the two cells
    near = across <= s.radius * min(1.0, s.reach / math.sqrt(unit.shape[1])) + 1e-6
    near[np.arange(len(far)), own] = True
    return own, near


def encode(residual: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vectors, subspaces), and the length of what they leave out."""
    codes = np.stack([_nearest(residual[:, p], w) for p, w in zip(book.parts, book.words)], axis=1)
    left = np.concatenate([residual[:, p] - w[codes[:, m]] for m, (p, w) in enumerate(zip(book.parts, book.words))], axis=1)
    return codes.astype(np.int16), np.sqrt((left * left).sum(1))


# --- meeting ----------------------------------------------------------------------------------------------------------


def looked_up(visitors: np.ndarray, codes: np.ndarray, book: Book) -> np.ndarray:
    """Distances between residuals of visitors and coded members, from tables of a visitor's distances to codewords."""
    total = np.zeros((len(visitors), len(codes)), dtype=np.float32)
    for m, (p, w) in enumerate(zip(book.parts, book.words)):
        total += _distances(visitors[:, p].astype(np.float32), w.astype(np.float32)).astype(np.float32)[:, codes[:, m]]
    return np.sqrt(total)


def linked(visitors: pd.DataFrame, members: pd.DataFrame, book: Book, cell: int, s: Settings, at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions (visitor, member) that link and count here, some visitors at a time. Inside one cell every pair comes from both sides and counts for the
    visitor; of two cells it comes once and counts for both."""
    dims = book.centroids.shape[1]
    v, m = _matrix(visitors["unit"], dims), _matrix(members["unit"], dims)
    codes = np.stack(members["codes"].map(lambda b: np.frombuffer(b, dtype=np.int16)))
    off = members["off"].to_numpy()
    home = visitors["cell"].to_numpy()
    # a member's own probes: a pair from a lower cell that it probes has been met there
    cells = len(book.centroids)
    seen = np.sort(np.concatenate([np.frombuffer(p, dtype=np.int32).astype(np.int64) + k * cells for k, p in enumerate(members["probed"])]))
    v_keys, m_keys = visitors["key"].to_numpy(), members["key"].to_numpy()
    for at in range(0, len(v), at_once):
        part = v[at : at + at_once]
        maybe = looked_up(part - book.centroids[cell], codes, book) <= (s.radius + off + 1e-3)[None, :]
        rows, columns = maybe.any(1).nonzero()[0], maybe.any(0).nonzero()[0]
        if not len(rows):
            continue
        exact = part[rows] @ m[columns].T >= s.similarity
        i, j = (exact & maybe[np.ix_(rows, columns)]).nonzero()
        i, j = rows[i] + at, columns[j]
        wanted = j.astype(np.int64) * cells + home[i]
        place = np.minimum(np.searchsorted(seen, wanted), len(seen) - 1)
        first = (home[i] == cell) | (home[i] > cell) | (seen[place] != wanted)
        good = first & (v_keys[i] != m_keys[j])
        yield i[good], j[good]


def met(visitors: pd.DataFrame, members: pd.DataFrame, book: Book, cell: int, s: Settings) -> pd.DataFrame:
    """``key``, ``links`` (rows that it links with here) and ``other`` (a class that it hangs together with through links here)."""
    n, sizes_m, sizes_v, home = len(visitors), members["n"].to_numpy(), visitors["n"].to_numpy(), visitors["cell"].to_numpy()
    counts = np.zeros(n + len(members), dtype=np.int64)
    parent = np.arange(n + len(members))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in linked(visitors, members, book, cell, s):
        np.add.at(counts, i, sizes_m[j])
        both = home[i] != cell
        np.add.at(counts, n + j[both], sizes_v[i[both]])
        # some visitors' links as a forest: a visitor hangs on its first member, members on the visitor's first one
        begins = np.flatnonzero(np.diff(i, prepend=-1)) if len(i) else np.zeros(0, dtype=np.int64)
        lead = np.repeat(j[begins], np.diff(np.append(begins, len(i)))) if len(i) else j
        for a, b in {*zip((i[begins]).tolist(), (n + j[begins]).tolist())}:
            parent[root(a)] = root(b)
        edges = np.unique(np.stack([lead, j], axis=1)[lead != j], axis=0) if len(i) else np.zeros((0, 2), dtype=np.int64)
        for a, b in edges.tolist():
            ra, rb = root(n + a), root(n + b)
            if ra != rb:
                parent[ra] = rb
    keys = np.concatenate([visitors["key"].to_numpy(), members["key"].to_numpy()])
    tops = np.array([root(x) for x in range(len(parent))], dtype=np.int64)
    some = np.flatnonzero((counts > 0) | (tops != np.arange(len(tops))) | (np.bincount(tops, minlength=len(tops)) > 1))
    return pd.DataFrame({"key": keys[some], "links": counts[some], "other": keys[tops[some]]})


# --- the operator -----------------------------------------------------------------------------------------------------


def books(classes: DataFrame, s: Settings) -> dict[int, Book]:
    """A book for each length of which the sample holds a vector."""
    many = classes.count()
    share = min(1.0, s.sample / max(many, 1))
    # the key is a digest: its first bytes are a number drawn evenly
    drawn = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") < int(share * 2**32)
    taken = classes.filter(drawn).select("key", "dims", "unit").toPandas().sort_values("key")
    cells = min(s.most_cells, -(-many // s.per_cell))
    return {int(d): fit(_matrix(g["unit"], int(d)), max(1, round(cells * len(g) / len(taken))), s) for d, g in taken.groupby("dims")}


def _single(dims: int) -> Book:
    """One list for all vectors of a length that the sample does not know."""
    return Book(np.zeros((1, dims), dtype=np.float32), [slice(0, dims)], [np.zeros((1, dims), dtype=np.float32)])


def placed(classes: DataFrame, made, s: Settings) -> DataFrame:
    """Classes with ``cell``, ``codes``, ``off`` and the probed cells as bytes (``probed``) and as an array (``visits``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made.value
        for batch in batches:
            frame = batch.to_pandas()
            if not len(frame):
                continue
            out = []
            for dims, g in frame.groupby("dims"):
                book = known.get(int(dims)) or _single(int(dims))
                for at in range(0, len(g), 1024):
                    part = g.iloc[at : at + 1024].copy()
                    unit = _matrix(part["unit"], int(dims))
                    own, near = probes(unit, book, s)
                    codes, off = encode(unit - book.centroids[own], book)
                    part["cell"], part["codes"], part["off"] = own.astype(np.int32), [c.tobytes() for c in codes], off
                    part["visits"] = [np.flatnonzero(row).astype(np.int32) for row in near]
                    part["probed"] = part["visits"].map(lambda x: x.tobytes())
                    out.append(part)
            yield pa.RecordBatch.from_pandas(pd.concat(out), schema=schema, preserve_index=False)

    schema = pa.schema([("key", pa.binary()), ("dims", pa.int32()), ("unit", pa.binary()), ("n", pa.int64()), ("cell", pa.int32()), ("codes", pa.binary()), ("off", pa.float64()), ("probed", pa.binary()), ("visits", pa.list_(pa.int32()))])
    return bounded(classes).select("key", "dims", "unit", "n").mapInArrow(run, "key binary, dims int, unit binary, n long, cell int, codes binary, off double, probed binary, visits array<int>")


def links(classes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """From distinct vectors (``key``, ``dims``, ``unit``, ``n`` rows; stored) to ``key``, ``links`` and ``other``, several rows a class."""
    made = classes.sparkSession.sparkContext.broadcast(books(classes, s))  # bounded by the sample
    at = stored(placed(classes, made, s), "placed")
    list_of = ["dims", "at"]
    most = F.greatest(F.lit(1), F.least(F.lit(s.block), F.lit(s.bytes / 8) / F.col("dims")))  # long vectors meet in smaller blocks
    size = at.groupBy("dims", F.col("cell").alias("at")).agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / most).cast("int")).drop("n")
    visits = at.select("key", "dims", "unit", "n", "cell", F.explode("visits").alias("at"))
    calls = visits.groupBy(*list_of).agg(F.count(F.lit(1)).alias("n")).withColumn("calls", F.ceil(F.col("n") / most).cast("int")).drop("n")
    # a row for each list that has members: at most ``most_cells`` for each length, and one for each length that the sample does not know
    grid = stored(size.join(calls, list_of), "lists")
    deal = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    everyone = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = lambda kind: F.lit(None).cast(kind)
    members = at.withColumn("at", F.col("cell")).join(grid, list_of).select(
        *list_of, deal("blocks").alias("block"), everyone("calls").alias("call"), F.lit(1).alias("side"), "key", "unit", "n", "cell", "codes", "off", "probed"
    )
    guests = visits.join(grid, list_of).select(
        *list_of, everyone("blocks").alias("block"), deal("calls").alias("call"), F.lit(0).alias("side"), "key", "unit", "n", "cell", none("binary").alias("codes"), none("double").alias("off"), none("binary").alias("probed")
    )

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        dims, cell = int(group["dims"].iloc[0]), int(group["at"].iloc[0])
        guests, own = group[group["side"] == 0], group[group["side"] == 1]
        if not len(guests) or not len(own):
            return pd.DataFrame({"key": [], "links": [], "other": []})
        return met(guests, own, made.value.get(dims) or _single(dims), cell, s)

    return members.union(guests).groupBy(*list_of, "block", "call").applyInPandas(meet, "key binary, links long, other binary")


def near_duplicates(df: DataFrame, id_col: str, vector_col: str, s: Settings = Settings()) -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_links`` (other rows linked directly), ``component_id`` (the smallest id that links reach, itself included) and ``kept``
    (whether that is its own)."""
    rows = stored(vectors(df, id_col, vector_col), "vectors")
    classes = stored(rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("dims").alias("dims"), F.first("unit").alias("unit"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "classes")
    found = stored(links(classes, s), "links")
    roots = components(found.filter("key <> other").select("key", "other"))
    least = roots.join(classes.select(F.col("key").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    by_class = roots.join(least, "root").select(F.col("node").alias("key"), "component")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    told = classes.join(counts, "key", "left").join(by_class, "key", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "least").alias("component"))
    # stored, so that Spark can split the rows of a vector that occurs very often
    joined = rows.select("id", "key").join(stored(told, "told"), "key", "left")
    alone = F.coalesce("component", "id")
    return joined.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"), F.coalesce(alone == F.col("id"), F.lit(False)).alias("kept"))
