"""Streaming forms of the batch operators, with the same results on the same input in whatever batches it comes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.jobs import CACHE_SECONDS
from tessella.sources.tables import is_folder, path_exists
from tessella.streaming.ordered import CacheState, LearnerState

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files in the folder path, or of the one file there, with the schema they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


@contextmanager
def _state_store(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, in so many partitions (fixed by a checkpoint's first start)."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": _ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partitions: int | None = None) -> None:
    """Run all input there is and append each batch, with its number, to a Parquet table; a replayed batch replaces itself.

    Started again with the same checkpoint it goes on after the last batch that was finished, with the state of then.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _state_store(stream.sparkSession, partitions):
        running = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()


def _tick(rows: DataFrame) -> Column:
    return F.coalesce(F.col("tick"), F.lit(False)) if "tick" in rows.columns else F.lit(False)


def stream_learner_state(graded: DataFrame, delay: str = "1 day") -> DataFrame:
    """(user_id, event_id, at, ability, mastery, next_topic) of each graded attempt, at in microseconds, as learners.ability_trace and
    mastery_trace have them up to it.

    Attempts may come late by up to delay and in any batches: they wait for the watermark and are folded in the order of
    created_at and event_id. Later ones are left out (Spark counts them). Rows whose column tick is true only move the
    clock. A null answer counts as wrong, a null topic as ''; rows without a user or a time take no part.
    """
    rows = graded.withColumn("tick", _tick(graded)).where("user_id IS NOT NULL").withWatermark("created_at", delay).where("created_at IS NOT NULL")
    rows = rows.select("user_id", "created_at", F.unix_micros("created_at").alias("at"), F.col("event_id").alias("id"), "topic", "difficulty", F.coalesce("correct", F.lit(False)).alias("correct"), "tick")
    out = "user_id long, event_id long, at long, ability double, mastery double, next_topic string"
    return rows.groupBy("user_id").transformWithStateInPandas(LearnerState(), outputStructType=out, outputMode="Append", timeMode="EventTime")


def stream_job_state(events: DataFrame) -> DataFrame:
    """Latest state of each job, for update mode; its keyed upsert is latest_of over the batches."""
    at = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(F.max_by("stage", at).alias("stage"), F.max_by("status", at).alias("status"), F.max_by("progress", F.when(F.col("progress").isNotNull(), at)).alias("progress"), F.count(F.lit(1)).alias("events"))


def latest_of(batches: DataFrame, key: str) -> DataFrame:
    """The newest batch's row of each key."""
    columns = [c for c in batches.columns if c not in (key, "batch")]
    return batches.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(key, "r.*")


def stream_ingest(sources: DataFrame, store: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame]) -> None:
    """New sources, less those whose pdf_name the store has, chunked by chunk(df) and stored; exactly once through the checkpoint."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        least = batch.groupBy("pdf_name").agg(F.min_by(F.struct(*batch.columns), "doc_id").alias("r")).select("r.*")
        if path_exists(spark, store):  # a batch that is run again must not be kept out by its own first try
            seen = spark.read.parquet(store).where(F.col("batch") != number).select("pdf_name").distinct()
            least = least.join(seen, "pdf_name", "left_anti")
        chunk(least).write.mode("overwrite").parquet(f"{store}/batch={number}")

    sources.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_cache_dedupe(requests: DataFrame, ttl: int = CACHE_SECONDS, delay: str = "1 hour") -> DataFrame:
    """(key, request_id, at, hit) of each request (key, request_id, ts), at in microseconds, as jobs.cache_hits_ttl has it by event time.

    A miss writes; its state is forgotten by a timer when the watermark is ttl seconds past the write. Requests may come
    late by up to delay, in any batches; later ones are left out. Rows whose column tick is true only move the clock.
    Rows without a key or a time take no part.
    """
    rows = requests.withColumn("tick", _tick(requests)).where("key IS NOT NULL").withWatermark("ts", delay).where("ts IS NOT NULL")
    rows = rows.select("key", "ts", F.unix_micros("ts").alias("at"), F.col("request_id").alias("id"), "tick")
    return rows.groupBy("key").transformWithStateInPandas(CacheState(ttl * 1_000_000), outputStructType="key string, request_id long, at long, hit boolean", outputMode="Append", timeMode="EventTime")
