"""A store of chunks with a commit log: new files are written first, then one list makes them the live ones of their documents.

    data/batch_id=.../subject=.../class_level=.../   chunks as they were written, never changed
    log/batch_id=.../                                the documents that the batch speaks for, moved here when complete

A document's live chunks are those of the last batch in the log that speaks for it, so a document that moved to another
subject or lost all its chunks leaves nothing behind. Files of a batch that never got into the log are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.tables import delete_path, list_names, move_path, path_exists, small_side


def published(spark: SparkSession, path: str) -> list[str]:
    """Batches in the log, in order."""
    return sorted(n.removeprefix("batch_id=") for n in list_names(spark, f"{path}/log") if n.startswith("batch_id="))


def _next_batch(spark: SparkSession, path: str) -> str:
    last = published(spark, path)
    number = int(last[-1].split("-")[0]) + 1 if last else 0
    return f"{number:010d}-{uuid.uuid4().hex[:8]}"


def commit(chunks: DataFrame, documents: DataFrame, path: str, key: str, partitions: list[str]) -> str:
    """Write chunks and then publish that documents (a column key) now have them and no others; returns the batch."""
    spark = chunks.sparkSession
    batch = _next_batch(spark, path)
    chunks.write.partitionBy(*partitions).parquet(f"{path}/data/batch_id={batch}")
    documents.select(key).where(F.col(key).isNotNull()).distinct().write.parquet(f"{path}/pending/{batch}")
    move_path(spark, f"{path}/pending/{batch}", f"{path}/log/batch_id={batch}")
    return batch


def live(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The live chunks, with the columns they were stored with.

    Only documents that several batches speak for are looked up by name; filters on the partition columns still reach the files.
    """
    names = published(spark, path)
    wanted = [b for b in names if path_exists(spark, f"{path}/data/batch_id={b}")]
    rows = spark.read.option("basePath", f"{path}/data").option("mergeSchema", True).parquet(*[f"{path}/data/batch_id={b}" for b in wanted])
    log = spark.read.option("basePath", f"{path}/log").parquet(*[f"{path}/log/batch_id={b}" for b in names])
    last = log.groupBy(key).agg(F.max("batch_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_key"), "_last")
    old = rows.join(small_side(last), F.col(key) == F.col("_key"), "left").where(F.col("_last").isNull() | (F.col("batch_id") == F.col("_last")))
    return old.drop("_key", "_last", "batch_id")


def compact(spark: SparkSession, path: str, key: str, partitions: list[str]) -> None:
    """Rewrite the live chunks as one batch that speaks for every document, then delete older batches."""
    before = published(spark, path)
    log = spark.read.parquet(*[f"{path}/log/batch_id={b}" for b in before])
    commit(live(spark, path, key), log, path, key, partitions)
    for batch in before:  # a batch whose files are gone is still in the log until the next line, and read as superseded
        delete_path(spark, f"{path}/data/batch_id={batch}")
        delete_path(spark, f"{path}/log/batch_id={batch}")
