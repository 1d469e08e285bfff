"""An exact index for cosine top-k: pages of vectors around pivots, with the range of angles they lie in.

A page holds the vectors whose nearest pivot is the same and whose angle to it falls into one band. For a query at angle t
from the pivot, no vector of a band [lo, hi] is nearer than max(0, t - hi, lo - t), so pages that cannot hold a hit are
not read: rows are stored in page order, and a filter on page leaves out whole row groups and files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.retrieval import QUERIES_AT_ONCE, LocalTop, finite, unit_rows
from tessella.sources.tables import delete_path, scratch_path

PIVOTS = 256
BAND = 0.05  # radians
BANDS = 64  # bands of BAND cover all angles
SLACK = 1e-9  # more than cosines and angles are off by rounding
_HITS = "query_id long, chunk_id long, score double"


def _placed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds page and angle to rows whose last column is the vector; vectors of another length than the pivots go to page -1."""
    for batch in batches:
        vectors = batch.column(batch.num_columns - 1)
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        page, angle = np.full(batch.num_rows, -1, np.int64), np.zeros(batch.num_rows)
        mine = np.flatnonzero(sizes == pivots.shape[1]) if len(pivots) else np.zeros(0, np.int64)
        if len(mine):
            cosine = unit_rows(vectors.take(pa.array(mine))) @ pivots.T
            near = cosine.argmax(axis=1)
            angle[mine] = np.arccos(np.clip(cosine[np.arange(len(mine)), near], -1, 1))
            page[mine] = near * BANDS + np.minimum(angle[mine] // BAND, BANDS - 1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(page), pa.array(angle)], names=[*batch.schema.names, "page", "angle"])


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


@dataclass
class Pages:
    """An index at path: pivots, and of every page its number, smallest and largest angle and rows."""

    path: str
    pivots: np.ndarray
    pages: np.ndarray  # page, lo, hi, rows; page -1 holds vectors that have no angle
    read: int = 0  # pages that searches read so far, each slice of queries for itself
    unread: int = 0
    met: int = 0  # pairs of a query and a page whose vectors it met
    spared: int = 0

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/pages")

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest cosine that each query can have with a vector of each page."""
        out = np.ones((len(queries), len(self.pages)))
        real = self.pages[:, 0] >= 0
        if real.any() and len(queries) and queries.shape[1] == self.pivots.shape[1]:
            to = np.arccos(np.clip(queries @ self.pivots.T, -1, 1))[:, (self.pages[real, 0] // BANDS).astype(int)]
            apart = np.maximum(0, np.maximum(to - self.pages[real, 2], self.pages[real, 1] - to))
            zero = ~queries.any(axis=1)  # a vector of zeros scores 0 with everything
            out[:, real] = np.where(zero[:, None], 0.0, np.cos(np.minimum(apart, np.pi))) + SLACK
        elif real.any():
            out[:, real] = -np.inf  # vectors meet those of their own length
        return out


def build(chunks: DataFrame, path: str, pivots: int = PIVOTS, files: int | None = None) -> Pages:
    """Index chunks (chunk_id, embedding, and any columns that searches are to filter by) at path.

    Pivots are a sample of `pivots` vectors of the most frequent length; every usable row is stored, in page order.
    """
    spark = chunks.sparkSession
    usable = finite(chunks, "chunk_id")
    usable = usable.select(*[F.col(f"`{c}`") for c in usable.columns if c != "embedding"], "embedding")
    width = usable.groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    sample = usable.where((F.size("embedding") == width[0]["w"]) & F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots).select("embedding").toArrow() if width and width[0]["w"] > 0 else None
    centers = unit_rows(sample.column(0).combine_chunks()) if sample is not None and sample.num_rows else np.zeros((0, 0))
    held = spark.sparkContext.broadcast(centers)
    placed = usable.mapInArrow(lambda it: _placed(it, held.value), _schema(usable) + ", page long, angle double")
    parts = files or spark.sparkContext.defaultParallelism
    # chunk_id in the range key lets a page of many rows span files
    placed.repartitionByRange(parts, "page", "chunk_id").sortWithinPartitions("page", "chunk_id").write.parquet(f"{path}/pages")
    summary = spark.read.parquet(f"{path}/pages").groupBy("page").agg(F.min("angle"), F.max("angle"), F.count(F.lit(1))).orderBy("page").collect()  # at most pivots * BANDS rows
    return Pages(path, centers, np.array([tuple(r) for r in summary], dtype=np.float64).reshape(-1, 4))


def _search_pages(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, wanted: dict[int, np.ndarray], k: int, least: float | None) -> Iterator[pa.RecordBatch]:
    """Local top-k over rows (chunk_id, embedding, page): a page's rows meet only the queries that want it."""

    top = LocalTop(ids, q, k, least)
    for batch in batches:
        pages = batch.column(2).to_numpy()
        edges = [0, *(np.flatnonzero(pages[1:] != pages[:-1]) + 1).tolist(), len(pages)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                top.add(batch.slice(lo, hi - lo), wanted[int(pages[lo])])
    yield top.batch()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _slice_hits(index: Pages, spark: SparkSession, ids: np.ndarray, q: np.ndarray, k: int, least: float | None, test: Column | None) -> DataFrame:
    bounds = index.bounds(q)
    numbers = index.pages[:, 0].astype(np.int64)

    def run(need: np.ndarray, floor: float | None) -> DataFrame:
        used = np.flatnonzero(need.any(axis=0))
        wanted = {int(numbers[p]): np.flatnonzero(need[:, p]) for p in used}
        held = spark.sparkContext.broadcast((ids, q, wanted))
        rows = index.rows(spark).where(F.col("page").isin([int(numbers[p]) for p in used]))
        rows = rows if test is None else rows.where(test)
        return rows.select("chunk_id", "embedding", "page").mapInArrow(lambda it: _search_pages(it, *held.value, k, floor), _HITS)

    order = np.argsort(-bounds, axis=1, kind="stable")
    enough = np.cumsum(index.pages[order, 3], axis=1)
    first = np.zeros_like(bounds, dtype=bool)
    np.put_along_axis(first, order, (enough - index.pages[order, 3]) < k, axis=1)  # the likeliest pages that hold k rows
    first &= bounds > -np.inf
    if least is not None:
        first &= bounds >= least
    hits = _ranked(run(first, least), k).select("query_id", "chunk_id", "score").toArrow()  # at most k rows a query of the slice
    kth = np.full(len(ids), -np.inf if least is None else least)
    place = {int(i): n for n, i in enumerate(ids)}
    scores: dict[int, list[float]] = {}
    for i, s in zip(hits.column(0).to_pylist(), hits.column(2).to_pylist()):
        scores.setdefault(i, []).append(s)
    for i, s in scores.items():
        if len(s) == k:
            kth[place[i]] = max(kth[place[i]], min(s))
    more = (bounds >= kth[:, None]) & (bounds > -np.inf) & ~first
    used = first | more
    index.read += int(used.any(axis=0).sum())
    index.unread += int((~used.any(axis=0)).sum())
    index.met += int(used.sum())
    index.spared += int((~used).sum())
    found = spark.createDataFrame(hits, _HITS)
    return found.union(run(more, least)) if more.any() else found


def search(index: Pages, queries: DataFrame, k: int = 5, score_threshold: float | None = None, test: Column | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the k nearest chunks by cosine that pass test; the same rows as retrieval.vector_topk gives.

    Queries (query_id, embedding; a query_id once) go by the pivot they lie next to, so that those of a slice want the same
    pages. A slice first reads the pages of highest bounds, and then those whose bound reaches its queries' k-th scores.
    """
    spark = queries.sparkSession
    near = finite(queries, "query_id").select("query_id", "embedding")
    held = spark.sparkContext.broadcast(index.pivots)
    placed = near.mapInArrow(lambda it: _placed(it, held.value), _schema(near) + ", page long, angle double")
    path = scratch_path(spark, "queries")
    placed.withColumns({"home": F.floor(F.col("page") / BANDS), "width": F.size("embedding")}).write.parquet(path)
    saved = spark.read.parquet(path)
    counts = saved.groupBy("width", "home").agg(F.count(F.lit(1)).alias("n")).orderBy("width", "home").collect()  # one row a pivot and length
    slices: list[tuple[int, list[int], int, int]] = []  # width, pivots, parts, part
    for r in counts:
        parts = -(-r["n"] // QUERIES_AT_ONCE)
        if parts > 1:
            slices += [(r["width"], [r["home"]], parts, i) for i in range(parts)]
        elif slices and slices[-1][0] == r["width"] and slices[-1][2] == 1 and sum(c["n"] for c in counts if c["width"] == r["width"] and c["home"] in slices[-1][1]) + r["n"] <= QUERIES_AT_ONCE:
            slices[-1][1].append(r["home"])
        else:
            slices.append((r["width"], [r["home"]], 1, 0))
    found = None
    for width, homes, parts, part in slices:
        rows = saved.where((F.col("width") == width) & F.col("home").isin(homes) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).select("query_id", "embedding").toArrow()
        if not rows.num_rows or not width:
            continue
        hits = _slice_hits(index, spark, np.asarray(rows.column("query_id").combine_chunks()), unit_rows(rows.column("embedding").combine_chunks()), k, score_threshold, test)
        found = hits if found is None else found.union(hits)
    delete_path(spark, path)
    return _ranked(spark.createDataFrame([], _HITS) if found is None else found, k)
