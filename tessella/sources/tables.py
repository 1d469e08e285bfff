"""Tables of a data folder, and typed reads of the file kinds the library takes in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, dealt over all of them for row-wise work; larger ones as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all cores and shuffle partitions, however few bytes it has: for costly work on each row, which should not be merged into few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked to be sent to all tasks, if it has at most so many rows; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _path_status(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, at


def path_exists(spark: SparkSession, path: str) -> bool:
    files, at = _path_status(spark, path)
    return files.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, at = _path_status(spark, path)
    return files.exists(at) and files.getFileStatus(at).isDirectory()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    files, at = _path_status(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def move_path(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file or folder to a name that is not taken, in one step where the file system can."""
    files, at = _path_status(spark, old)
    to = _path_status(spark, new)[1]
    if files.exists(to):
        raise FileExistsError(new)
    files.mkdirs(to.getParent())
    if not files.rename(at, to):
        raise OSError(f"cannot move {old} to {new}")


def delete_path(spark: SparkSession, path: str) -> None:
    files, at = _path_status(spark, path)
    files.delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir. Where that is unset, in an own folder on a local master, else an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = folder or "file://" + tempfile.mkdtemp(prefix="tessella-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with their paths."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """A rating sheet; criteria stay text so that bad cells can be dropped one by one."""
    schema = "listener_id string, sample_id string, naturalness string, clarity string, pacing string, comments string"
    return spark.read.csv(path, header=True, schema=schema)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
