"""Filtered vector top-k, context assembly and retrieval logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.sources.tables import scratch_path

_WIDTHS = [1_000_000 * 3600, 1_000_000 * 60, 1_000_000, 1_000, 1]  # an hour to a microsecond, in microseconds
QUERIES_AT_ONCE = 4096  # query vectors sent to the tasks together


def metadata_filter(subject: str | None = None, class_level: str | int | None = None, chapter_number: str | int | None = None, pdf_name: str | None = None) -> Column:
    """AND of the given equality tests; without any, everything passes."""
    tests = []
    if subject and subject.strip():
        tests.append(F.col("subject") == subject.strip())
    if class_level is not None and str(class_level).strip() and str(class_level).strip().lower() != "all":
        tests.append(F.col("class_level").cast("string") == str(class_level).strip())
    if chapter_number is not None and str(chapter_number).strip():
        text = str(chapter_number).strip()
        tests.append(F.col("chapter_number").try_cast("int") == int(text) if text.lstrip("-").isdigit() else F.col("chapter_number").cast("string") == text)
    if pdf_name and pdf_name.strip():
        tests.append(F.col("pdf_name") == pdf_name.strip())
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Lists of one length as rows of length 1; a vector of zeros stays one."""
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    largest = np.abs(v).max(axis=1, initial=0)[:, None]
    v = v / np.where(largest > 0, largest, 1)  # squares of very large and very small components stay in range
    return v / np.where(largest > 0, np.sqrt((v * v).sum(axis=1))[:, None], 1)


class LocalTop:
    """Top-k of every query (ids and rows of one length) over the blocks of a task, by block matrix products; only scores that can still count are sorted."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, least: float | None):
        self.ids, self.q, self.k, self.every = ids, q, k, np.arange(len(ids))
        self.who, self.which, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(ids), -np.inf if least is None else least)

    def add(self, batch: pa.RecordBatch, asked: np.ndarray | None = None) -> None:
        """Rows (chunk_id, embedding) that the queries at the places `asked`, or all, meet if they are of the same length."""
        asked = self.every if asked is None else asked
        same = np.flatnonzero(batch.column(1).value_lengths().to_numpy(zero_copy_only=False) == self.q.shape[1])
        if not len(same) or not len(asked):
            return
        batch = batch if len(same) == batch.num_rows else batch.take(pa.array(same))
        chunk, v = np.asarray(batch.column(0)), unit_rows(batch.column(1))
        for at in range(0, len(v), 2048):
            s = self.q[asked] @ v[at : at + 2048].T
            if s.shape[1] > self.k:
                self.floor[asked] = np.maximum(self.floor[asked], np.partition(s, -self.k, axis=1)[:, -self.k])
            rows, columns = np.nonzero(s >= self.floor[asked][:, None])
            who, which, score = np.concatenate([self.who, asked[rows]]), np.concatenate([self.which, chunk[at + columns]]), np.concatenate([self.score, s[rows, columns]])
            order = np.lexsort((which, -score, who))
            who, which, score = who[order], which[order], score[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            full = place == self.k - 1
            self.floor[who[full]] = np.maximum(self.floor[who[full]], score[full])
            self.who, self.which, self.score = (x[place < self.k] for x in (who, which, score))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.who]), pa.array(self.which), pa.array(self.score)], names=["query_id", "chunk_id", "score"])


def _block_top(batches: Iterator[pa.RecordBatch], queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: float | None) -> Iterator[pa.RecordBatch]:
    """Top-k of queries (ids and rows of one length each) over all batches of a task."""
    tops = [LocalTop(ids, q, k, least) for ids, q in queries]
    for batch in batches:
        for top in tops:
            top.add(batch)
    for top in tops:
        yield top.batch()


def finite(rows: DataFrame, key: str) -> DataFrame:
    """rows with a key and a vector without null and non-finite components."""
    v = F.col("embedding")
    return rows.where(F.col(key).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int = 5, score_threshold: float | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the k nearest chunks by cosine; ties go to the smaller chunk id.

    Chunks (chunk_id, embedding) stay where they are: tasks keep k rows for each query, and only those are shuffled.
    Queries (query_id, embedding) of up to QUERIES_AT_ONCE are met in one scan; for more, chunks are indexed in pages first
    and a slice reads the pages that it needs only (see operators.vectorpages). Vectors meet those of their own length.
    Rows with a null id, with a null vector or one holding null or non-finite components take no part; a vector of zeros
    scores 0 with everything.
    """
    spark = chunks.sparkSession
    chunks, queries = finite(chunks, "chunk_id").select("chunk_id", "embedding"), finite(queries, "query_id").select("query_id", "embedding")
    rows = queries.where("size(embedding) > 0").limit(QUERIES_AT_ONCE + 1).toArrow()
    if rows.num_rows > QUERIES_AT_ONCE:
        from tessella.operators import vectorpages  # it builds on this module

        return vectorpages.search(vectorpages.build(chunks, scratch_path(spark, "pages")), queries, k, score_threshold)
    if not rows.num_rows:
        return spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    ids, vectors = rows.column("query_id").combine_chunks(), rows.column("embedding").combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    each = [np.flatnonzero(sizes == w) for w in np.unique(sizes)]
    held = spark.sparkContext.broadcast([(np.asarray(ids)[at], unit_rows(vectors.take(pa.array(at)))) for at in each])
    found = chunks.mapInArrow(lambda it: _block_top(it, held.value, k, score_threshold), "query_id long, chunk_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scroll_chunks(chunks: DataFrame, test: Column, n: int = 5) -> DataFrame:
    return chunks.where(test).orderBy("chunk_id").limit(n)


def _shown(c: str) -> Column:
    text = F.col(c).cast("string")
    return F.when(text.isNull() | text.isin("", "0"), "N/A").otherwise(text)


def assemble_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One context text for each query from its hits (with payload) in rank order; '' without hits."""
    head = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit(": Class "), _shown("class_level"), F.lit(" "), _shown("subject"), F.lit(" - Ch "), _shown("chapter_number"), F.lit(" ("), _shown("chapter_name"),
        F.lit(") | Section: "), F.when(F.coalesce("section", F.lit("")) == "", "General").otherwise(F.col("section")), F.lit("]\n"), F.trim(F.coalesce("content", F.lit(""))),
    )
    texts = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", head.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))
    return queries.select("query_id").join(texts, "query_id", "left").select("query_id", F.coalesce("context", F.lit("")).alias("context"))


def retrieval_summary(queries: DataFrame, hits: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    sums = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.max("score").alias("top_score"), F.min("score").alias("low_score"))
    named = [F.lit(x) for pair in filters.items() for x in pair]
    active = F.map_filter(F.create_map(*named), lambda _, v: v.isNotNull()) if named else F.create_map().cast("map<string,string>")
    out = queries.select("query_id").join(sums, "query_id", "left")
    return out.select("query_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce("low_score", F.lit(0.0)).alias("low_score"), active.alias("filters"))


def retrieval_log(queries: DataFrame, hits: DataFrame, caller: str, filters: dict[str, str | None], at: Column) -> DataFrame:
    """One event for each query (query_id, query) with its hits, empty ones too; append it with sources.tables.write_json_lines.

    logged_at, caller, query, filters as text (None without any), total, top_score, low_score, hits in rank order.
    """
    named = ", ".join(f"{k}={v}" for k, v in filters.items() if v is not None) or "None"
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("hits"), F.max("score").alias("top_score"), F.min("score").alias("low_score"))
    none = F.array().cast("array<struct<rank:int,chunk_id:bigint,score:double>>")
    rows = queries.select("query_id", "query").join(lists, "query_id", "left").withColumn("hits", F.coalesce("hits", none))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.select("query_id", at.alias("logged_at"), F.lit(caller).alias("caller"), "query", F.lit(named).alias("filters"), F.size("hits").alias("total"), zero("top_score"), zero("low_score"), "hits")


def recent_log(entries: DataFrame, max_bytes: int, text: str, ts: str, tie: str) -> DataFrame:
    """Newest entries that fit in max_bytes together.

    Sums by hour tell in which hour the cut lies; that hour alone is summed by minute, and so on down to the microsecond.
    What is then put in order are entries that fit and those of one microsecond, hour by hour, so no task orders an hour
    that the cut goes through.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = entries.withColumn("_t", at).withColumn("_n", F.octet_length(text))
    since, used = None, 0  # entries from `since` on use `used` bytes and fit
    low, high = None, None  # the bucket of the cut
    for width in _WIDTHS:
        inside = rows if low is None else rows.where((F.col("_t") >= low) & (F.col("_t") < high))
        sums = inside.where("_t IS NOT NULL").groupBy(F.floor(F.col("_t") / width).cast("long").alias("b")).agg(F.sum("_n").alias("n")).orderBy(F.desc("b"))
        cut = None
        for r in sums.toLocalIterator():  # newest first, no further than the cut
            if used + (r["n"] or 0) > max_bytes:
                cut = r["b"]
                break
            used += r["n"] or 0
            since = r["b"] * width
        if cut is None:
            break
        low, high = cut * width, (cut + 1) * width
        since = low if width == 1 else since
    if since is None:
        return rows.where("false").drop("_t", "_n").withColumn("used", F.lit(0).cast("long"))
    rows = rows.where(F.col("_t") >= since).withColumn("_b", F.floor(F.col("_t") / _WIDTHS[0]))
    newer = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("_b").agg(F.sum("_n").alias("n"))
    sums = sums.select("_b", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("before"))
    order = W.partitionBy("_b").orderBy(F.desc(ts), F.desc(tie))
    out = rows.join(sums, "_b").withColumn("used", F.col("before") + F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return out.where(F.col("used") <= max_bytes).drop("_b", "_n", "_t", "before")


def hit_preview(hits: DataFrame) -> DataFrame:
    """Short forms for reading: the end of the previous text and the beginning of the content."""
    before = F.regexp_replace(F.coalesce("previous_text", F.lit("")), "\n", " ")
    content = F.coalesce("content", F.lit(""))
    return hits.withColumn("before_preview", F.when(F.length(before) > 200, F.concat(F.lit("..."), F.right(before, F.lit(200)))).otherwise(before)).withColumn(
        "content_preview", F.when(F.length(content) > 200, F.concat(F.left(content, F.lit(200)), F.lit("..."))).otherwise(content)
    )
