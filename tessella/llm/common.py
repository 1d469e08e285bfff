"""Helpers shared by the training-data operators: tables, shared storage, row fingerprints."""

from __future__ import annotations

import tempfile
import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, an own one on a local master, else an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="tessella-")
    return "file://" + _OWN_DIRS[app]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    return _written(df, name)[0]


class Scratch:
    """Tables that one call needs for itself: kept in the shared folder, deleted at the end.

        with Scratch(spark) as held:
            rows = held.keep(rows, "rows")
            return materialize(result(rows), "result")
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """materialize, until the end."""
        out, path = _written(df, name)
        self.paths.append(path)
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underlines before it if df has such a column, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_of(col: Column | str) -> Column:
    """crc32 of a value written as text (0 to 2**32 - 1); null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(col.cast("string").cast("binary"))


def held_out(col: Column | str, modulus: int, remainder: int) -> Column:
    """True where crc32(key as text) mod modulus is the remainder; a null key counts as not held out."""
    return F.coalesce(crc_of(col) % F.lit(modulus) == F.lit(remainder), F.lit(False))


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes in a column, by one distributed sum."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"])
