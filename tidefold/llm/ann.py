"""Nearest neighbours through low-dimensional stable projections, a kd-tree and a chi-square stopping test.

Nearness is the largest inner product. With M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query q
becomes (q, 0): the nearest point by distance is then the one with the largest product. Points are projected to ``dims``
numbers by a Gaussian matrix, so that squared projected over squared real distance follows chi-square with ``dims`` degrees.

Index: a kd-tree over the projections. Its upper part is fitted on about ``sample`` points (a share of all, by hash) and cuts
the space into cells of about ``cell`` points; every point is put in its cell. A cell's own tree goes on down to leaves
of ``leaf`` points, each with its bounding box.

Search: a query visits its own cell first, then every cell whose box the test does not exclude. In a cell it takes leaves in
the order of their projected distance and verifies their points on the original vectors; it stops when the next
leaf's squared projected distance exceeds ``quantile`` (of chi-square) times the squared distance of its k-th neighbour
so far. So each true neighbour is found with at least the probability of ``quantile``; in practice with much more, as a leaf's
box is nearer than its points.

Cells and queries meet in packs: a row holds a cell's points, or at most about ``pack`` queries of one block of BLOCK neighbouring
cells with the cells that each visits, so that a query's vector is sent once for a block of cells. Equal vectors are one
point with their k + 1 least ids, which is all that any result can need.

Vectors that are null, zero, or hold null or non-finite components take no part, as points or queries. Products are of
vectors of one length only. Scores are computed in double precision on the original vectors; equal scores go by id, also
where a leaf or a cell is cut at its best k + 1. A null id takes no part. Of rows with equal ids one counts, that with the
least vector. An empty table gives an empty result. Only the two named columns of the input are read: others do not matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import plain, stored


#: Cells that a query's vector is sent to at once.
BLOCK = 64


@dataclass(frozen=True)
class Settings:
    k: int = 20
    dims: int = 6
    probability: float = 0.3
    cell: int = 8192
    leaf: int = 256
    pack: int = 2048
    sample: int = 65_536
    seed: int = 7

    @property
    def quantile(self) -> float:
        """Where the chi-square distribution reaches ``probability`` (an even number of degrees has a closed form)."""
        half = self.dims // 2
        low, high = 0.0, 1000.0
        for _ in range(100):
            x = (low + high) / 2
            below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))
            low, high = (x, high) if below < self.probability else (low, x)
        return high


def matrix(length: int, s: Settings) -> np.ndarray:
    return np.random.default_rng([s.seed, length]).standard_normal((length + 1, s.dims))


def projected(vectors: np.ndarray, largest: float, s: Settings, query: bool = False) -> np.ndarray:
    """Projections of rows; points get the component that makes all norms equal, queries get zero there."""
    more = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(largest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.column_stack([vectors, more]) @ matrix(vectors.shape[1], s)


# --- the upper tree -----------------------------------------------------------------------------------------------


def fit_cells(points: np.ndarray, cells: int) -> tuple[list[tuple[int, float, int, int]], np.ndarray]:
    """Nodes (axis, cut, left, right; children below 0 are cells -1 - c) and each cell's box (cells, 2, dims)."""
    dims = points.shape[1] if points.ndim == 2 else 1
    nodes: list[tuple[int, float, int, int]] = []
    boxes: list[np.ndarray] = []

    def split(own: np.ndarray, box: np.ndarray, want: int) -> int:
        spread = np.ptp(own, axis=0) if len(own) else np.zeros(dims)
        if want <= 1 or not len(own) or spread.max() == 0:
            boxes.append(box)
            return -len(boxes)
        axis = int(spread.argmax())
        cut = float(np.quantile(own[:, axis], (want // 2) / want))
        left = own[:, axis] <= cut
        if left.all():
            cut = float(np.nextafter(cut, -np.inf))
            left = own[:, axis] <= cut
        at = len(nodes)
        nodes.append((axis, cut, 0, 0))
        low, high = box.copy(), box.copy()
        low[1, axis] = high[0, axis] = cut
        nodes[at] = (axis, cut, split(own[left], low, want // 2), split(own[~left], high, want - want // 2))
        return at

    box = np.stack([np.full(dims, -np.inf), np.full(dims, np.inf)])
    split(points, box, cells)
    return nodes, np.stack(boxes)


def cell_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int32)
    todo = [(0, np.arange(len(points)))] if nodes else []
    while todo:
        at, rows = todo.pop()
        axis, cut, left, right = nodes[at]
        goes = points[rows, axis] <= cut
        for child, some in ((left, rows[goes]), (right, rows[~goes])):
            if child < 0:
                out[some] = -1 - child
            elif len(some):
                todo.append((child, some))
    return out


def box_distance(points: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Squared distances (points, boxes)."""
    out = np.zeros((len(points), len(boxes)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(np.maximum(boxes[None, :, 0, d] - x, x - boxes[None, :, 1, d]), 0) ** 2
    return out


# --- inside a cell --------------------------------------------------------------------------------------------------


def leaf_order(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the points in which leaves are slices, the slices' bounds, and their boxes."""
    parts: list[np.ndarray] = []
    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            parts.append(rows)
            continue
        axis = int(np.ptp(points[rows], axis=0).argmax())
        rows = rows[np.argpartition(points[rows, axis], len(rows) // 2)]
        todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    bounds = np.cumsum([0] + [len(p) for p in parts])
    return np.concatenate(parts), bounds, np.stack([np.stack([points[p].min(axis=0), points[p].max(axis=0)]) for p in parts])


def search(
    queries: np.ndarray, q_proj: np.ndarray, worst: np.ndarray, vectors: np.ndarray, v_proj: np.ndarray, turns: np.ndarray, largest: float, s: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """For each query the rows of the best points that it verified (k + 1 columns, -1 where none), and how many leaves it visited.
    ``worst`` is each query's k-th product so far (-inf: none); ``turns`` orders points of equal products."""
    order, bounds, boxes = leaf_order(v_proj, s.leaf)
    vectors, turns = vectors[order], turns[order]
    lows = box_distance(q_proj, boxes)
    turn = np.argsort(lows, axis=1)
    norms = np.einsum("ij,ij->i", queries, queries) + largest**2
    width = s.k + 1
    best, rows = np.full((len(queries), width), -np.inf), np.full((len(queries), width), -1, dtype=np.int64)
    near_enough = 1e-12 * norms  # products that differ by less are computed again, pair by pair
    visited = np.zeros(len(queries), dtype=np.int64)
    active = np.arange(len(queries))
    limit = worst.copy()
    for step in range(len(boxes)):
        near = turn[active, step]
        distance = np.maximum(norms[active] - 2 * limit[active], 0)
        go = ~(lows[active, near] > s.quantile * distance)
        active, near = active[go], near[go]
        if not len(active):
            break
        visited[active] += 1
        by = np.argsort(near, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(near[by])) + 1):
            q, leaf = active[some], near[some[0]]
            a, b = bounds[leaf], bounds[leaf + 1]
            both = np.concatenate([best[q], queries[q] @ vectors[a:b].T], axis=1)
            ids = np.concatenate([rows[q], np.broadcast_to(np.arange(a, b), (len(q), b - a))], axis=1)
            if both.shape[1] > width:
                top = np.argpartition(-both, width - 1, axis=1)[:, :width]
                least = np.take_along_axis(both, top, axis=1).min(axis=1)
                close = both >= (least - near_enough[q])[:, None]
                for k in np.flatnonzero((close.sum(axis=1) > width) & (least > -np.inf)).tolist():  # a tie at the end
                    at = np.flatnonzero(close[k])
                    exact = products(queries[q[k]][None], vectors[ids[k, at]])
                    top[k] = at[np.lexsort((turns[ids[k, at]], -exact))[:width]]
                both, ids = np.take_along_axis(both, top, axis=1), np.take_along_axis(ids, top, axis=1)
            best[q], rows[q] = both, ids
            # k + 1 points: one of them may be the query itself
            limit[q] = np.maximum(limit[q], both.min(axis=1))
    return np.where(rows >= 0, order[rows], -1), visited


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row; the same sum for the same two vectors, whatever the rows around."""
    return np.add.reduce(a * b, axis=1)


# --- on Spark -------------------------------------------------------------------------------------------------------


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vec`` (array<double>) of the rows that take part."""
    rows = df.select(F.col(plain(id_col)).alias("id"), F.col(plain(vector_col)).cast("array<double>").alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(fine).filter(F.exists("vec", lambda x: x != 0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search_table(df: DataFrame, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id``, ``score``: the nearest points of the rows for which the SQL condition ``is_query``
    (of ``id``) holds."""
    s = settings
    rows = stored(valid(df, id_col, vector_col).groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    parts = [r.n for r in rows.select(F.size("vec").alias("n")).distinct().collect()]  # lengths: a handful
    spark = df.sparkSession
    made = [_search_length(rows.filter(F.size("vec") == n), is_query, n, s) for n in sorted(parts)]
    if not made:
        kind = df.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out


def _search_length(rows: DataFrame, is_query: str, length: int, s: Settings) -> DataFrame:
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    largest = float(rows.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()[0])
    among = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("__n", F.row_number().over(among)).filter(F.col("__n") <= s.k + 1)
    points = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = stored(points, "points")
    count = points.count()
    share = min(1.0, s.sample / count)  # distinct points, chosen by hash: about ``sample`` of them
    sample = points.filter(F.shiftrightunsigned(F.xxhash64("vec"), 1) <= F.lit(min(int(share * (1 << 63)), (1 << 63) - 1)).cast("long")).select("vec").toArrow()
    taken = projected(_matrix(sample.column(0).combine_chunks()), largest, s) if sample.num_rows else np.zeros((0, s.dims))
    tree = spark.sparkContext.broadcast(fit_cells(taken, max(1, math.ceil(count / s.cell))))

    def place(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    proj = projected(_matrix(batch.column(1)), largest, s, query)
                    cells = cell_of(proj, tree.value[0])
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32)), pa.array(cells)) if query else pa.array(cells)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], names=["id", "vec", "cell"])

        return run

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(frame["vec"].to_numpy())
        return pd.DataFrame({"cell": [frame["cell"].iloc[0]], "ids": [[list(x) for x in frame["ids"]]], "points": [vectors.tobytes()]})

    placed = points.select("ids", "vec").mapInArrow(place(False), f"ids array<{kind}>, vec array<double>, cell int")
    cells = stored(placed.groupBy("cell").applyInPandas(pack, f"cell int, ids array<array<{kind}>>, points binary").withColumn("block", F.expr(f"cell div {BLOCK}")), "cells")
    queries = stored(rows.filter(is_query).mapInArrow(place(True), f"id {kind}, vec array<double>, cell array<int>"), "queries")
    parts = max(1, math.ceil(queries.count() / s.pack))

    def visit(visits: DataFrame) -> DataFrame:
        """``visits``: id, vec, worst, block, cell (the cells of the block that the query visits); gives the found neighbours of each."""
        packs = visits.groupBy("block", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("id", "vec", "worst", "cell")).alias("queries"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    asked, cell = batch.column(0)[k].values, batch.column(3)[k].as_py()
                    wanted = asked.field("cell")
                    here = np.unique(np.repeat(np.arange(len(asked)), np.diff(wanted.offsets.to_numpy()))[wanted.flatten().to_numpy() == cell])
                    if not len(here):
                        continue
                    asked = asked.take(pa.array(here))
                    q_ids, q, worst = asked.field("id"), _matrix(asked.field("vec")), asked.field("worst").to_numpy(zero_copy_only=False)
                    ids = batch.column(1)[k].values
                    least = ids.values.take(ids.offsets[:-1].cast(pa.int64()))  # each point's least id
                    turns = np.empty(len(ids), dtype=np.int64)
                    turns[pc.sort_indices(least).to_numpy()] = np.arange(len(ids))
                    vectors = np.frombuffer(batch.column(2)[k].as_py(), dtype=np.float64).reshape(-1, length)
                    found, _ = search(q, projected(q, largest, s, True), worst, vectors, projected(vectors, largest, s), turns, largest, s)
                    at, column = np.nonzero(found >= 0)
                    point = found[at, column]
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at)), ids.take(pa.array(point)), pa.array(products(q[at], vectors[point]))], names=["query_id", "ids", "score"])

        met = packs.join(cells, "block").select("queries", "ids", "points", "cell")
        found = met.mapInArrow(run, f"query_id {kind}, ids array<{kind}>, score double")
        return found.select("query_id", F.explode("ids").alias("id"), "score").filter("query_id <> id")

    def top(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.k)

    own = queries.withColumn("worst", F.lit(float("-inf"))).withColumn("block", F.expr(f"cell[0] div {BLOCK}"))
    first = stored(top(visit(own)), "first")
    worst = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == s.k, F.min("score")).alias("worst"))
    known = queries.join(worst, queries["id"] == worst["query_id"], "left").select("id", "vec", F.col("cell")[0].alias("cell"), F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = tree.value[1]
        some = max(1, (1 << 22) // len(boxes))
        for batch in batches:
            for at in range(0, batch.num_rows, some):
                part = batch.slice(at, some)
                q = _matrix(part.column(1))
                limit = part.column(3).to_numpy(zero_copy_only=False)
                distance = np.maximum(np.einsum("ij,ij->i", q, q) + largest**2 - 2 * limit, 0)
                go = ~(box_distance(projected(q, largest, s, True), boxes) > s.quantile * distance[:, None])
                go[np.arange(len(q)), part.column(2).to_numpy()] = False
                row, cell = np.nonzero(go)  # by query, then by cell: what goes to one block stands together
                starts = np.flatnonzero(np.diff(row * len(boxes) + cell // BLOCK, prepend=-1))
                take = pa.array(row[starts])
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(cell)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                blocks = pa.array((cell[starts] // BLOCK).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), part.column(3).take(take), blocks, lists], names=["id", "vec", "worst", "block", "cell"])

    rest = visit(known.mapInArrow(others, f"id {kind}, vec array<double>, worst double, block int, cell array<int>"))
    every = first.select("query_id", "id", "score").union(rest)
    return top(every).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
