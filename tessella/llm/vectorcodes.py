"""Vector code compression: product codes whose codebooks are fitted by Lloyd rounds over partition-local cover trees.

Vectors become integers, floor(1024 * x), and are cut into parts; each part has a codebook of up to 256 entries. Blocks of
vectors are kept as cover trees, one a part, in preorder with cumulative sums, so that a round gives a whole subtree to an
entry where the triangle inequality proves that all of it is nearer to that entry than to any other; only ambiguous nodes
are descended into, down to exact distances of single vectors. Sums, distances and means are exact integers.

Rows are vec_id, embedding, label; others are not looked at. Vectors that are null, or hold null, non-finite or unboundedly
large components (2**52 and more), take no part, nor do those of another length than most have (of equally frequent lengths the
longest). Null ids come last, repeated ids and vectors count each for itself; an empty table has no codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, materialize
from tessella.llm.neardup import lookup

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 1024  # vectors of one tree
LEAF = 16  # a node of so many descendants has them as its leaves
SHRINK = 1.3  # a child's radius is at most its parent's divided by this
EXACT = 1 << 22  # components below it have squared distances that doubles hold exactly
_TREE = ("order", "size", "parent", "depth", "radius")
_BLOCK = "vec_id array<long>, label_key array<string>, points array<long>, order array<int>, size array<int>, parent array<int>, depth array<int>, radius array<double>"


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label_key, v) of the vectors that take part."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) >= float(1 << 52)))
    kept = vectors.where(F.col("embedding").isNotNull() & ~odd)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), key.alias("label_key"), v.alias("v"))
    most = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (most[0]["n"] if most else 0))


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    return [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


def cover_tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree of points (rows of exact doubles) in preorder: order, size of each subtree, parent, depth, covering radius.

    A node's descendants are covered by children that lie over its radius / SHRINK apart and reach no further than that.
    """
    m = len(x)
    order, size, parent, depth, radius = np.zeros(m, np.int32), np.ones(m, np.int32), np.full(m, -1, np.int32), np.zeros(m, np.int32), np.zeros(m)
    norms = (x * x).sum(axis=1)
    rest = np.arange(1, m)
    stack = [(0, rest, norms[rest] + norms[0] - 2 * (x[rest] @ x[0]), -1, 0)] if m else []
    k = 0
    while stack:
        center, below, apart, up, level = stack.pop()
        at, k = k, k + 1
        order[at], parent[at], depth[at], size[at] = center, up, level, 1 + len(below)
        if not len(below):
            continue
        reach = apart.max()
        radius[at] = np.sqrt(max(reach, 0.0))
        if len(below) <= LEAF or reach <= 0:
            order[k : k + len(below)], parent[k : k + len(below)], depth[k : k + len(below)] = below, at, level + 1
            k += len(below)
            continue
        points, own = x[below], norms[below]
        while len(below):
            apart = own + own[0] - 2 * (points @ points[0])
            near = apart <= reach / SHRINK**2
            near[0] = False
            stack.append((below[0], below[near], apart[near], at, level + 1))
            near[0] = True
            below, points, own = below[~near], points[~near], own[~near]
    return {"order": order, "size": size, "parent": parent, "depth": depth, "radius": radius}


def _blocks(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors with the trees of their parts one after another."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            points = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, width)
            trees = [cover_tree(points[:, lo:hi].astype(np.float64)) for lo, hi in cuts(width, parts)]
            columns = [np.concatenate([t[c] for t in trees]) for c in _TREE]
            row = [batch.column("vec_id").to_pylist(), batch.column("label_key").to_pylist(), points.ravel(), *columns]
            types = [pa.int64(), pa.string(), pa.int64(), *[pa.int32()] * 4, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([list(v) if i < 2 else v], pa.list_(t)) for i, (v, t) in enumerate(zip(row, types))], names=["vec_id", "label_key", "points", *_TREE])


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries: exact doubles of small components, Python integers of large ones."""
    if x.dtype == object:
        return np.array([[int(((p - c) ** 2).sum()) for c in book] for p in x], dtype=object).reshape(len(x), len(book))
    return (x * x).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None, :] - 2 * (x @ book.T)


def descend(x: np.ndarray, tree: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, entries, whole) of points in preorder: the nodes whose distances were needed, their nearest entries (ties to the
    lower index), and whether all of the subtree goes there too."""
    nodes, entries, whole = [], [], []
    size, radius, parent = tree["size"], tree["radius"], tree["parent"]
    unsure = np.zeros(len(x), bool)
    by_depth = np.argsort(tree["depth"], kind="stable")
    edges = np.searchsorted(tree["depth"][by_depth], np.arange(tree["depth"].max(initial=0) + 2))
    for level, (lo, hi) in enumerate(zip(edges, edges[1:])):
        front = by_depth[lo:hi]
        front = front[unsure[parent[front]]] if level else front
        if not len(front):
            break
        apart = _distances(x[front], book)
        best = apart.argmin(axis=1)
        inner = np.flatnonzero(size[front] > 1)
        sure = np.ones(len(front), bool)
        if len(inner) and len(book) > 1:
            if x.dtype == object:
                sure[inner] = False
            else:  # the margin is far above the rounding of the roots
                two = np.sqrt(np.maximum(np.partition(apart[inner], 1, axis=1)[:, :2], 0))
                reach = radius[front[inner]]
                sure[inner] = (two[:, 1] - two[:, 0] > 2 * reach + 1e-6 * (1 + two[:, 1] + reach)) | (reach == 0)
        unsure[front[~sure]] = True
        nodes.append(front)
        entries.append(best)
        whole.append(sure)
    if not nodes:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return np.concatenate(nodes), np.concatenate(entries), np.concatenate(whole)


def _parts(batches: Iterator[pa.RecordBatch], book: list[list[list[int]]], width: int):
    """(row, part, points in preorder, tree, codebook) of every block's parts, as numbers that hold all distances exactly."""
    far = max((abs(c) for part in book for entry in part for c in entry), default=0) >= EXACT
    for batch in batches:
        for row in batch.to_pylist():
            n, at = len(row["vec_id"]), 0
            points = np.array(row["points"], dtype=np.int64).reshape(n, width)
            wide = far or (n and int(np.abs(points).max(initial=0)) >= EXACT)
            for part, (lo, hi) in enumerate(cuts(width, len(book))):
                tree = {c: np.array(row[c][at : at + n]) for c in _TREE}
                at += n
                x = points[tree["order"], lo:hi].astype(object if wide else np.float64)
                yield row, part, x, tree, np.array(book[part], dtype=object if wide else np.float64).reshape(len(book[part]), hi - lo)


def _sums(batches: Iterator[pa.RecordBatch], book: list[list[list[int]]], width: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, s) of a task: how many parts each entry has and their componentwise sums."""
    spans = cuts(width, len(book))
    n = [np.zeros(len(p), dtype=np.int64) for p in book]
    s = [np.zeros((len(p), hi - lo), dtype=object) for p, (lo, hi) in zip(book, spans)]
    for _, part, x, tree, entries in _parts(batches, book, width):
        nodes, best, whole = descend(x, tree, entries)
        totals = np.concatenate([np.zeros((1, x.shape[1]), x.dtype), np.cumsum(x, axis=0)])
        count = np.where(whole, tree["size"][nodes], 1)
        summed = totals[nodes + count] - totals[nodes]
        n[part] += np.bincount(best, weights=count, minlength=len(entries)).astype(np.int64)
        for j in range(x.shape[1]):
            if x.dtype == object:
                for e, value in zip(best, summed[:, j]):
                    s[part][e, j] += value
            else:
                s[part][:, j] += np.bincount(best, weights=summed[:, j], minlength=len(entries)).astype(np.int64).astype(object)
    rows = [(part, e, int(n[part][e]), [int(v) for v in s[part][e]]) for part in range(len(book)) for e in np.flatnonzero(n[part])]
    part, entry, count, total = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
    sums = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, total)]), pa.int32()), pa.array([v for t in total for v in t], pa.decimal128(38, 0)))
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count, pa.int64()), sums], names=["part", "entry", "n", "s"])


def _codes(batches: Iterator[pa.RecordBatch], book: list[list[list[int]]], width: int) -> Iterator[pa.RecordBatch]:
    """vec_id, label_key, entries and error of every vector."""
    most = np.iinfo(np.int64).max
    row, entries, errors = None, None, None

    def result():
        known = [e if 0 <= e <= most else None for e in map(int, errors)]
        columns = [pa.array(row["vec_id"], pa.int64()), pa.array(row["label_key"], pa.string()), pa.array(list(entries.astype(np.int32)), pa.list_(pa.int32())), pa.array(known, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label_key", "entries", "error"])

    for now, part, x, tree, centers in _parts(batches, book, width):
        if part == 0:
            row, entries, errors = now, np.zeros((len(x), len(book)), dtype=np.int64), np.zeros(len(x), dtype=object)
        nodes, best, whole = descend(x, tree, centers)
        count = np.where(whole, tree["size"][nodes], 1)
        places = np.repeat(nodes - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        found = np.zeros(len(x), dtype=np.int64)
        found[places] = np.repeat(best, count)
        off = x - centers[found]
        entries[tree["order"], part] = found
        errors[tree["order"]] += (off * off).sum(axis=1).astype(object)
        if part == len(book) - 1:
            yield result()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error, codebooks_sha256 of every vector that takes part.

    Codebooks start as the parts of the vectors with the smallest ids. A round sends them, bounded by parts * entries, to
    the trees, which stay where they are stored; tasks return sums a used entry, which are added up by entry. Means are
    rounded down, unused entries stay. error is null where it does not fit 64 bits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hexadecimal digits a part needs 1 to 256 entries")
    spark = vectors.sparkSession
    rows = integers(vectors)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    width = len(first[0]["v"]) if first else 0
    book = [[list(r["v"][lo:hi]) for r in first] for lo, hi in cuts(width, parts)]
    with Scratch(spark) as held:
        trees = held.keep(rows.mapInArrow(lambda it: _blocks(it, width, parts), _BLOCK), "trees")
        for _ in range(rounds if first else 0):
            sums = trees.mapInArrow(lambda it, b=book: _sums(it, b, width), "part int, entry int, n long, s array<decimal(38,0)>")
            widest = max(hi - lo for lo, hi in cuts(width, parts))
            added = [F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(widest)]
            for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # one row an entry
                old = book[r["part"]][r["entry"]]
                book[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(len(old))]
        coded = trees.mapInArrow(lambda it: _codes(it, book, width), "vec_id long, label_key string, entries array<int>, error long")
        digits = F.array_join(F.transform("entries", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
        coded = held.keep(coded.select("vec_id", "label_key", digits.alias("code"), "error"), "codes")
        sums = coded.groupBy("label_key").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("c"))
        out = lookup(coded, sums, "label_key", coded.count())
        shown = hashlib.sha256(",".join(str(c) for part in book for entry in part for c in entry).encode()).hexdigest()
        return materialize(out.select("vec_id", "code", "error", "label_error", F.lit(shown).alias("codebooks_sha256")), "codes")
