"""Exact top-k inner products by best-first search in M-trees.

Vectors are quantised to integers. With M the largest squared norm, a vector x gets one more coordinate
sqrt(M - |x|^2) and a query q gets 0 there; then |q - x|^2 = |q|^2 + M - 2 q.x, so the largest inner products are the
nearest neighbours in a metric space, where triangle inequalities hold.

Rows are dealt by nearest pivot (pivots: a bounded sample) and distance, and runs of TREE_ROWS rows become one paged
M-tree each: a node keeps its routing vector, covering radius and distance to its parent's routing vector; a leaf page
keeps each row's distance to the leaf's. A node's or row's distance is computed only if the stored distances cannot
rule it out. Every row is in a tree.

A query first meets its home tree, the one with the nearest root; the k-th best score there bounds what can still count.
Then the roots' covering radii rule out all trees that the bound cannot reach, before anything is moved: only the
remaining queries go, packed, to the remaining trees. A tree that many queries want is searched in several groups.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, materialize

MOST_PIVOTS = 4096
TREE_ROWS = 4096
PAGE_ROWS = 256
FANOUT = 8
QUERY_BLOCK = 512  # queries of one home tree packed together
ROOTS_AT_ONCE = 16_384  # tree roots sent to the tasks together
BLOCKS_A_GROUP = 64  # packed blocks that meet a tree in one task
_SLACK = 1e-6


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows with a null id, vector or component, or a non-finite one, are left out."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(~bad).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column as int64, padded with zeros to width."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), dtype=np.int64)
    values = np.asarray(column.flatten())
    rows = np.repeat(np.arange(len(column)), sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    out[rows, np.arange(len(values)) - np.repeat(starts, sizes)] = values
    return out


def _lifted(v: np.ndarray, most: int) -> np.ndarray:
    """The vectors with their extra coordinate."""
    x = v.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))])


class Tree:
    """A paged M-tree over up to TREE_ROWS lifted vectors, kept as flat arrays."""

    def __init__(self, points: np.ndarray):
        self.order: list[np.ndarray] = []  # rows of the leaf pages, one after another
        self.route: list[int] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.first: list[int] = []  # first child node, or first place in order
        self.count: list[int] = []
        self.leaf: list[bool] = []
        self.far: list[np.ndarray] = []  # each row's distance to its leaf's routing vector
        self.points, self.placed = points, 0
        self._build(np.arange(len(points)))

    def _centre(self, rows: np.ndarray) -> tuple[int, np.ndarray]:
        middle = self.points[rows].mean(axis=0)
        best = int(rows[((self.points[rows] - middle) ** 2).sum(axis=1).argmin()])
        return best, np.sqrt(((self.points[rows] - self.points[best]) ** 2).sum(axis=1))

    def _add(self, rows: np.ndarray, parent: int | None) -> int:
        route, d = self._centre(rows)
        self.route.append(route)
        self.radius.append(float(d.max()))
        self.to_parent.append(0.0 if parent is None else float(np.sqrt(((self.points[route] - self.points[self.route[parent]]) ** 2).sum())))
        self.first.append(0)
        self.count.append(0)
        self.leaf.append(True)
        return len(self.route) - 1

    def _build(self, rows: np.ndarray) -> None:
        waiting = [(self._add(rows, None), rows)]
        while waiting:
            node, rows = waiting.pop()
            if len(rows) <= PAGE_ROWS:
                d = np.sqrt(((self.points[rows] - self.points[self.route[node]]) ** 2).sum(axis=1))
                self.first[node], self.count[node] = self.placed, len(rows)
                self.order.append(rows)
                self.far.append(d)
                self.placed += len(rows)
                continue
            groups = self._split(rows)
            self.leaf[node], self.first[node], self.count[node] = False, len(self.route), len(groups)
            waiting += [(self._add(g, node), g) for g in groups]

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        """Groups around seeds that lie far apart; equal vectors are cut into pages."""
        x = self.points[rows]
        near = ((x - x[0]) ** 2).sum(axis=1)
        home = np.zeros(len(rows), np.int64)
        for s in range(1, FANOUT):
            seed = int(near.argmax())
            if near[seed] <= 0:
                break
            d = ((x - x[seed]) ** 2).sum(axis=1)
            home[d < near] = s
            near = np.minimum(near, d)
        groups = [rows[home == s] for s in range(FANOUT) if (home == s).any()]
        return groups if len(groups) > 1 else [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]

    def record(self, ids: np.ndarray, v: np.ndarray) -> dict[str, bytes]:
        order = np.concatenate(self.order)
        return {
            "ids": ids[order].tobytes(), "v": v[order].astype(np.int32).tobytes() if np.abs(v).max(initial=0) < 2**31 else v[order].tobytes(), "far": np.concatenate(self.far).tobytes(),
            "route": self.points[self.route].tobytes(), "radius": np.array(self.radius).tobytes(), "to_parent": np.array(self.to_parent).tobytes(),
            "first": np.array(self.first, np.int32).tobytes(), "count": np.array(self.count, np.int32).tobytes(), "leaf": np.array(self.leaf).tobytes(),
            "root": self.points[self.route[0]].tobytes(), "reach": self.radius[0],
        }


class Searcher:
    """A stored tree, ready for queries."""

    def __init__(self, row: dict[str, bytes], width: int, most: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        self.v = np.frombuffer(row["v"], np.int32 if len(row["v"]) == 4 * n * width else np.int64).reshape(n, width).astype(_exact(most))
        self.far, self.radius, self.to_parent = (np.frombuffer(row[c]) for c in ("far", "radius", "to_parent"))
        self.route = np.frombuffer(row["route"]).reshape(len(self.radius), width + 1)
        self.first, self.count = (np.frombuffer(row[c], np.int32) for c in ("first", "count"))
        self.leaf = np.frombuffer(row["leaf"], bool)
        self.most, self.computed = most, 0

    def top(self, q: np.ndarray, own: int, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of rows that may be among the k best; bound: a distance within which k rows are known to lie."""
        x = np.append(q.astype(np.float64), 0.0)
        base = float((x * x).sum()) + self.most
        q, best_ids, best = q.astype(self.v.dtype), np.zeros(0, np.int64), np.zeros(0, self.v.dtype)
        root = float(np.sqrt(((x - self.route[0]) ** 2).sum()))
        heap = [(max(0.0, root - self.radius[0]), 0, root)]
        while heap:
            low, node, d = heapq.heappop(heap)
            if low > bound + _SLACK * (1 + bound):
                break
            a, b = self.first[node], self.first[node] + self.count[node]
            reach = bound + _SLACK * (1 + bound)
            if self.leaf[node]:
                some = np.flatnonzero(np.abs(d - self.far[a:b]) <= reach) + a
                self.computed += len(some)
                score = self.v[some] @ q
                ids = self.ids[some]
                other = ids != own
                best_ids, best = np.concatenate([best_ids, ids[other]]), np.concatenate([best, score[other]])
                if len(best) > k:
                    keep = np.lexsort((best_ids, -best))[:k]
                    best_ids, best = best_ids[keep], best[keep]
                if len(best) == k:
                    bound = min(bound, float(np.sqrt(max(0.0, base - 2 * float(best.min())))))
                continue
            child = np.arange(a, b)
            child = child[np.abs(d - self.to_parent[a:b]) - self.radius[a:b] <= reach]
            if len(child):
                self.computed += len(child)
                dist = np.sqrt(((self.route[child] - x) ** 2).sum(axis=1))
                for c, dc in zip(child.tolist(), dist.tolist()):
                    lower = dc - self.radius[c]
                    if lower <= reach:
                        heapq.heappush(heap, (max(0.0, lower), c, dc))
        return best_ids, best


_TREE = "tree long, ids binary, v binary, far binary, route binary, radius binary, to_parent binary, first binary, count binary, leaf binary, root binary, reach double"
_HITS = "qkey long, query_id long, vec_id long, score long"


def _exact(most: int) -> type:
    """A type in which inner products up to most are whole."""
    return np.float64 if most < 2**53 else np.int64


def _grow(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    """Trees over runs of the rows as they come."""
    ids, rows, held, number = [], [], 0, TaskContext.get().partitionId() << 32

    def trees(numbers: Iterator[int]):
        i, v = np.concatenate(ids), np.concatenate(rows)
        for s in range(0, len(i), TREE_ROWS):
            part = v[s : s + TREE_ROWS]
            record = Tree(_lifted(part, most)).record(i[s : s + TREE_ROWS], part)
            yield pa.RecordBatch.from_arrays([pa.array([next(numbers)]), *[pa.array([x]) for x in record.values()]], names=["tree", *record])

    numbers = itertools.count(number)
    for batch in batches:
        ids.append(np.asarray(batch.column("vec_id")))
        rows.append(_matrix(batch.column("v"), width))
        held += batch.num_rows
        if held >= TREE_ROWS:
            yield from trees(numbers)
            ids, rows, held = [], [], 0
    if held:
        yield from trees(numbers)


def build(rows: DataFrame, width: int, most: int, count: int) -> DataFrame:
    """Trees over quantised rows; pivots are as many rows by id hash as there are trees, MOST_PIVOTS at most."""
    tasks = max(1, -(-count // TREE_ROWS))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MOST_PIVOTS, tasks)).toArrow()
    lifted = _lifted(_matrix(sample.column("v").combine_chunks(), width), most)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (lifted**2).sum(axis=1)
        for batch in batches:
            x = _lifted(_matrix(batch.column("v"), width), most)
            d = norms[None, :] - 2 * (x @ lifted.T)
            home = d.argmin(axis=1)
            gap = np.sqrt(np.maximum(0.0, d[np.arange(len(x)), home] + (x * x).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(home.astype(np.int32)), pa.array(gap)], names=["vec_id", "v", "home", "gap"])

    dealt = rows.mapInArrow(assign, "vec_id long, v array<long>, home int, gap double").repartitionByRange(tasks, "home", "gap", "vec_id").sortWithinPartitions("home", "gap", "vec_id")
    return dealt.mapInArrow(lambda it: _grow(it, width, most), _TREE)


class Roots:
    """The roots of some trees: numbers, lifted routing vectors, covering radii."""

    def __init__(self, rows: pa.Table, width: int):
        self.tree, self.reach = rows.column("tree").to_numpy(), rows.column("reach").to_numpy()
        self.at = np.frombuffer(b"".join(rows.column("root").to_pylist())).reshape(-1, width + 1)

    def distances(self, v: np.ndarray) -> np.ndarray:
        """Of queries (rows) from roots (columns)."""
        x = v.astype(np.float64)
        return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (self.at * self.at).sum(axis=1)[None, :] - 2 * (x @ self.at[:, :-1].T)))


def _slices(trees: DataFrame, width: int) -> Iterator[Roots]:
    """All roots, a bounded number at a time."""
    parts = max(1, -(-trees.count() // ROOTS_AT_ONCE))
    for i in range(parts):
        rows = trees.where(F.pmod(F.xxhash64("tree"), F.lit(parts)) == i).select("tree", "root", "reach").toArrow()
        if rows.num_rows:
            yield Roots(rows, width)


def _by_slice(trees: DataFrame, width: int, use: Callable[[Broadcast], DataFrame], name: str, held: Scratch) -> DataFrame:
    """use(roots) for every slice of roots, one slice sent at a time."""
    parts = []
    for roots in _slices(trees, width):
        sent = trees.sparkSession.sparkContext.broadcast(roots)
        parts.append(held.keep(use(sent), name))
        sent.destroy()
    return reduce(DataFrame.union, parts)


def _nearest(batches: Iterator[pa.RecordBatch], held: Broadcast, width: int) -> Iterator[pa.RecordBatch]:
    """Queries with the tree of the nearest root and its distance."""
    for batch in batches:
        d = held.value.distances(_matrix(batch.column("v"), width))
        best = d.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.tree[best]), pa.array(d[np.arange(len(d)), best])], names=[*batch.schema.names, "tree", "gap"])


def _pack(group: pa.Table, width: int) -> pa.Table:
    """Queries of one home tree as one row."""
    v = _matrix(group.column("v").combine_chunks(), width)
    blob = lambda c: pa.array([group.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary())
    return pa.table({"tree": group.column("tree")[:1], "part": group.column("part")[:1], "qkeys": blob("qkey"), "query_ids": blob("vec_id"), "qv": pa.array([v.tobytes()], pa.binary())})


def _found(tree: Searcher, row: dict, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(qkey, query_id, vec_id, score columns of the best rows in a tree, each query's k-th best distance) for one packed row."""
    keys, ids = np.frombuffer(row["qkeys"], np.int64), np.frombuffer(row["query_ids"], np.int64)
    v = np.frombuffer(row["qv"], np.int64).reshape(len(ids), -1)
    bounds = np.frombuffer(row["bounds"]) if row.get("bounds") else np.full(len(ids), np.inf)
    hits = [tree.top(v[i], int(ids[i]), k, float(bounds[i])) for i in range(len(ids))]
    sizes = [len(a) for a, _ in hits]
    x = v.astype(np.float64)
    base = (x * x).sum(axis=1) + tree.most
    reached = np.array([np.sqrt(max(0.0, b - 2 * float(s.min()))) if len(s) == k else np.inf for b, (_, s) in zip(base, hits)])
    return [np.repeat(keys, sizes), np.repeat(ids, sizes), np.concatenate([a for a, _ in hits]), np.concatenate([s for _, s in hits]).astype(np.int64)], reached


def _first(batches: Iterator[pa.RecordBatch], width: int, most: int, k: int) -> Iterator[pa.RecordBatch]:
    """Packed queries in their home trees: their hits, and the bounds that follow."""
    for batch in batches:
        for row in batch.to_pylist():
            hits, bounds = _found(Searcher(row, width, most), row, k)
            yield pa.RecordBatch.from_arrays([pa.array([row[c]]) for c in ("tree", "part", "qkeys", "query_ids", "qv")] + [pa.array([bounds.tobytes()], pa.binary())] + [pa.array([h], pa.list_(pa.int64())) for h in hits], names=["tree", "part", "qkeys", "query_ids", "qv", "bounds", "a", "b", "c", "d"])


def _reachable(batches: Iterator[pa.RecordBatch], held: Broadcast, width: int) -> Iterator[pa.RecordBatch]:
    """For each tree but the home tree, the packed queries whose bound its covering radius reaches."""
    roots = held.value
    for batch in batches:
        for row in batch.to_pylist():
            v, bounds = np.frombuffer(row["qv"], np.int64).reshape(-1, width), np.frombuffer(row["bounds"])
            wanted = roots.distances(v) - roots.reach[None, :] <= (bounds + _SLACK * (1 + bounds))[:, None]
            wanted[:, roots.tree == row["tree"]] = False
            trees = np.flatnonzero(wanted.any(axis=0))
            keys, ids = np.frombuffer(row["qkeys"], np.int64), np.frombuffer(row["query_ids"], np.int64)
            pick = [np.flatnonzero(wanted[:, t]) for t in trees]
            blobs = [pa.array([a[i].tobytes() for i in pick], pa.binary()) for a in (keys, ids, v, bounds)]
            yield pa.RecordBatch.from_arrays([pa.array(roots.tree[trees]), pa.array(np.full(len(trees), row["tree"])), pa.array(np.full(len(trees), row["part"])), *blobs], names=["tree", "home", "part", "qkeys", "query_ids", "qv", "bounds"])


def _second(key: tuple, group: pa.Table, width: int, most: int, k: int) -> pa.Table:
    """A tree with some of the packed queries that reach it."""
    is_tree = pc.is_valid(group.column("ids"))
    tree = Searcher(group.filter(is_tree).to_pylist()[0], width, most)
    parts = [_found(tree, row, k)[0] for row in group.filter(pc.invert(is_tree)).select(["qkeys", "query_ids", "qv", "bounds"]).to_pylist()]
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["qkey", "query_id", "vec_id", "score"])


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows for each query row (id divisible by every): query_id, rank (from 1), vec_id, score.

    The score is the exact integer inner product of quantised vectors; ties go to the smaller id; a query's own id is no
    candidate. Defined cases: rows with a null id, a null vector, or a null or non-finite component take no part; shorter
    vectors count as padded with zeros; fewer than k candidates are all returned; an id that occurs twice is searched for
    once with each different vector and found as often as it occurs; an empty table gives no rows; other columns, whatever
    their names, are ignored; vectors whose squared norm reaches 2**62 are an error.
    """
    with Scratch(vectors.sparkSession) as held:
        return materialize(_top(vectors, k, every, id_col, vector_col, held), "top-k")


def _top(vectors: DataFrame, k: int, every: int, id_col: str, vector_col: str, held: Scratch) -> DataFrame:
    spark = vectors.sparkSession
    rows = held.keep(quantised(vectors, id_col, vector_col), "quantised")
    shape = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)).alias("most"), F.count(F.lit(1)).alias("n")).first()
    # any bound on the squared norms will do for the lift
    width, most, count = int(shape["width"] or 0), math.ceil((shape["most"] or 0) * (1 + 1e-9)), int(shape["n"])
    if most >= 2**62:
        raise ValueError("inner products of vectors of this length do not fit in 64 bits")
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    trees = held.keep(build(rows, width, most, count), "trees")
    queries = rows.where(F.col("vec_id") % every == 0).distinct().select(F.xxhash64("vec_id", "v").alias("qkey"), "vec_id", "v")
    home = _by_slice(trees, width, lambda r: queries.mapInArrow(lambda it: _nearest(it, r, width), "qkey long, vec_id long, v array<long>, tree long, gap double"), "nearest", held)
    home = home.groupBy("qkey", "vec_id", "v").agg(F.min_by("tree", F.struct("gap", "tree")).alias("tree"))
    sizes = home.groupBy("tree").agg(F.expr(f"cast(ceil(count(*) / {QUERY_BLOCK}) AS long)").alias("parts"))
    dealt = home.join(sizes, "tree").withColumn("part", F.pmod(F.col("qkey"), F.col("parts")))
    packed = dealt.select("tree", "part", "qkey", "vec_id", "v").groupBy("tree", "part").applyInArrow(lambda t: _pack(t, width), "tree long, part long, qkeys binary, query_ids binary, qv binary")
    started = packed.join(trees, "tree").mapInArrow(lambda it: _first(it, width, most, k), "tree long, part long, qkeys binary, query_ids binary, qv binary, bounds binary, a array<long>, b array<long>, c array<long>, d array<long>")
    started = held.keep(started, "started")
    hits = started.select(F.inline(F.arrays_zip("a", "b", "c", "d"))).toDF("qkey", "query_id", "vec_id", "score")
    blocks = started.select("tree", "part", "qkeys", "query_ids", "qv", "bounds")
    wants = _by_slice(trees, width, lambda r: blocks.mapInArrow(lambda it: _reachable(it, r, width), "tree long, home long, part long, qkeys binary, query_ids binary, qv binary, bounds binary"), "wants", held)
    groups = max(1, -(-blocks.count() // BLOCKS_A_GROUP))
    wants = wants.withColumn("grp", F.pmod(F.xxhash64("home", "part"), F.lit(groups))).drop("home", "part")
    meet = wants.select("tree", "grp").distinct().join(trees, "tree").unionByName(wants, allowMissingColumns=True)
    more = meet.groupBy("tree", "grp").applyInArrow(lambda key, t: _second(key, t, width, most, k), _HITS)
    order = W.partitionBy("qkey", "query_id").orderBy(F.desc("score"), "vec_id")
    return hits.union(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
