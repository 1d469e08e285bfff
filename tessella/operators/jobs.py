"""Job events and run metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.learners import newest
from tessella.sources.tables import dealt, small_side

#: fixed percent of each known stage
STAGE_PERCENT = {"queued": 5, "retrieval": 15, "script": 30, "scenes": 45, "speech": 60, "slides": 78, "assembly": 92, "done": 100}
CACHE_SECONDS = 86_400
BUSY_REQUESTS = 100_000  # a key with more is cut at gaps


def job_latest_state(events: DataFrame) -> DataFrame:
    """The last event of each job; where it brings no progress (a failure), the last known progress stays."""
    at = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(
        F.max_by("stage", at).alias("stage"), F.max_by("status", at).alias("status"), F.max_by("error", at).alias("error"),
        F.max_by("progress", F.when(F.col("progress").isNotNull(), at)).alias("progress"), F.count(F.lit(1)).alias("events"),
    )


def stage_progress(events: DataFrame) -> DataFrame:
    """Events with the percent of their stage; unknown stages are rejected."""
    percent = F.create_map(*[F.lit(x) for pair in STAGE_PERCENT.items() for x in pair])
    return events.withColumn("percent", percent[F.col("stage")]).where("percent IS NOT NULL")


def list_user_jobs(jobs: DataFrame, n: int = 20) -> DataFrame:
    return newest(jobs, "user_id", "ts", "event_id", n)


def stage_timing(events: DataFrame, run: str = "job_id") -> DataFrame:
    """Seconds and calls of each run's stages, their share of the run, and their place by time spent.

    Sums are kept to the microsecond, so that stages of equal time stay equal in whatever order their seconds were added.
    """
    sums = events.groupBy(run, "stage").agg(F.round(F.sum("seconds"), 6).alias("seconds"), F.count(F.lit(1)).alias("calls"))
    whole = W.partitionBy(run)
    return sums.withColumn("share", F.when(F.sum("seconds").over(whole) > 0, F.col("seconds") / F.sum("seconds").over(whole)).otherwise(0.0)).withColumn("place", F.row_number().over(whole.orderBy(F.desc("seconds"), "stage")))


def realtime_factor(events: DataFrame, output_seconds: Column, run: str = "job_id") -> DataFrame:
    return events.groupBy(run).agg(F.sum("seconds").alias("total"), F.max(output_seconds).alias("output")).withColumn("factor", F.when(F.col("output") > 0, F.round(F.col("total") / F.col("output"), 2)))


def engine_comparison(runs: DataFrame, subjects: list[str]) -> DataFrame:
    """Per engine: mean latency and realtime factor of its successful runs, latency by subject, or why it is unavailable."""
    good = F.col("error").isNull()
    by_subject = [F.round(F.avg(F.when(good & (F.col("subject") == s), F.col("latency"))), 4).alias(f"latency_{s}") for s in subjects]
    return runs.groupBy("engine").agg(
        F.round(F.avg(F.when(good, F.col("latency"))), 4).alias("latency"), F.round(F.avg(F.when(good & (F.col("duration") > 0), F.col("latency") / F.col("duration"))), 4).alias("factor"),
        F.count_if(good).alias("runs"), *by_subject, F.max(F.when(~good, F.col("error"))).alias("last_error"),
    ).withColumn("reason", F.when(F.col("runs") == 0, F.col("last_error"))).drop("last_error")


def overhead_vs_baseline(variants: DataFrame, baseline: str) -> DataFrame:
    """Seconds, items a second, factor, difference and percent of each variant against the baseline variant."""
    base = variants.where(F.col("variant") == baseline).select("config", F.col("seconds").alias("base"))
    rows = variants.join(base, "config")
    return rows.select(
        "config", "variant", F.round("seconds", 4).alias("seconds"), F.round(F.col("items") / F.col("seconds"), 4).alias("rate"), F.round(F.col("seconds") / F.col("base"), 4).alias("factor"),
        F.round(F.col("seconds") - F.col("base"), 4).alias("delta"), F.round((F.col("seconds") / F.col("base") - 1) * 100, 4).alias("percent"),
    )


def response_cache_key(parts: dict[str, Column]) -> Column:
    """SHA-256 of the parts as JSON with sorted names; null parts are left out of the JSON."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)


def _fold_cache(batches: Iterator[pa.RecordBatch], ttl: int) -> Iterator[pa.RecordBatch]:
    """Hits of requests sorted by key, piece and time; from a write the next one is found by search, and carried over batches."""
    piece, written = None, -np.inf
    for batch in batches:
        keys, pieces = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "piece"))
        at = batch.column("seconds").to_numpy()
        hit = np.ones(len(at), bool)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (pieces[1:] != pieces[:-1])) + 1).tolist(), len(at)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if (keys[lo], pieces[lo]) != piece:
                piece, written = (keys[lo], pieces[lo]), -np.inf
            i = lo
            while (i := i + int(np.searchsorted(at[i:hi] - written, ttl, side="left"))) < hi:
                hit[i], written = False, at[i]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("request_id"), pa.array(hit)], names=["key", "request_id", "hit"])


def cache_pieces(requests: DataFrame, ttl: int, busy: int = BUSY_REQUESTS) -> DataFrame:
    """requests (key, request_id, seconds) with piece: busy keys are cut where no request came for ttl seconds, which restarts their state.

    Requests that far apart lie in different stretches of ttl seconds, so the cuts are found from the first and last request
    of each stretch. Keys of at most `busy` requests are one piece. The table of stretches is of busy keys only.
    """
    rows = requests.select("key", "request_id", "seconds").where("seconds IS NOT NULL")
    if rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > busy).isEmpty():
        return rows.withColumn("piece", F.lit(0).cast("long"))
    stretch = F.floor(F.col("seconds") / ttl)
    spans = rows.groupBy("key", stretch.alias("_s")).agg(F.min("seconds").alias("lo"), F.max("seconds").alias("hi"), F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("key").orderBy("_s")
    spans = spans.withColumn("total", F.sum("n").over(W.partitionBy("key"))).where(F.col("total") > busy)
    cut = F.coalesce((F.col("lo") - F.lag("hi").over(order) >= ttl).cast("int"), F.lit(0))
    places = spans.withColumn("cut", cut).select("key", "_s", F.sum("cut").over(order).alias("piece")).where("piece > 0")
    named = places.select(F.col("key").alias("_key"), F.col("_s").alias("_at"), F.col("piece").cast("long").alias("_piece"))
    met = rows.withColumn("_s", stretch).join(small_side(named), F.col("key").eqNullSafe(F.col("_key")) & (F.col("_s") == F.col("_at")), "left")
    return met.select("key", "request_id", "seconds", F.coalesce("_piece", F.lit(0)).alias("piece"))


def cache_hits_ttl(requests: DataFrame, ttl: int = CACHE_SECONDS, busy: int = BUSY_REQUESTS) -> DataFrame:
    """Each request (key, request_id, seconds) as hit or miss: a hit lies within ttl seconds of the last write of its key; only a miss writes.

    A key's requests depend on one another in order, up to a gap of ttl seconds: pieces between such gaps are folded by
    different tasks, each in batches with one number kept. Requests without a time take no part.
    """
    ordered = dealt(cache_pieces(requests, ttl, busy), "key", "piece").sortWithinPartitions("key", "piece", "seconds", "request_id")
    return ordered.mapInArrow(lambda it: _fold_cache(it, ttl), "key string, request_id long, hit boolean")
