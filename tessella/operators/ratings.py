"""Listening-test ratings: cleaning, mean opinion scores, coverage, blind sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.sources.tables import small_side

CRITERIA = ("naturalness", "clarity", "pacing")
LOW, HIGH = 1.0, 5.0


def clean_ratings(sheet: DataFrame) -> DataFrame:
    """(listener_id, sample_id, criterion, score): cells that are blank, not numbers or out of range are dropped."""
    long = sheet.unpivot(["listener_id", "sample_id"], list(CRITERIA), "criterion", "cell")
    return long.withColumn("score", F.expr("try_cast(trim(cell) AS double)")).where(F.col("score").between(LOW, HIGH)).drop("cell")


def _summary(score: str) -> list[Column]:
    n, sd = F.count(score), F.coalesce(F.stddev_samp(score), F.lit(0.0))
    sd = F.when(F.count(score) > 1, sd).otherwise(0.0)
    half = 1.96 * sd / F.sqrt(F.count(score))
    return [n.alias("n"), F.round(F.avg(score), 2).alias("mean"), F.round(sd, 2).alias("sd"), F.round(F.avg(score) - half, 2).alias("low"), F.round(F.avg(score) + half, 2).alias("high")]


def mos_summary(clean: DataFrame, manifest: DataFrame) -> DataFrame:
    """Statistics of each subject and criterion, and of each criterion over all subjects, in one pass."""
    named = clean.join(manifest, "sample_id", "left").withColumn("subject", F.coalesce("subject", F.lit("unknown")))
    sets = named.groupingSets([[F.col("subject"), F.col("criterion")], [F.col("criterion")]], F.col("subject"), F.col("criterion"))
    return sets.agg(*_summary("score")).withColumn("subject", F.coalesce("subject", F.lit("All")))


def rating_coverage(clean: DataFrame) -> DataFrame:
    return clean.agg(F.count_distinct("listener_id").alias("listeners"), F.count_distinct("sample_id").alias("samples"), F.count(F.lit(1)).alias("scores"))


def blind_sheet(listeners: DataFrame, samples: DataFrame, seed: int = 92) -> DataFrame:
    """Every listener with every sample, which is what a sheet is, in one shuffled order that all listeners share.

    Samples are placed by the hash of their id, in 4,096 runs of hashes side by side; the smaller of both lists is sent
    to the tasks if it is small enough.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "sample_id"))
    rows = samples.select("sample_id").distinct().withColumn("_h", order).withColumn("_run", F.substring("_h", 1, 3))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = rows.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")).select("_run", before.alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_run").orderBy("_h", "sample_id"))
    placed = rows.join(F.broadcast(runs), "_run").select("sample_id", place.cast("int").alias("place"))  # 4,096 runs at most
    return placed.crossJoin(small_side(listeners.select("listener_id").distinct()))


def mos_matrix(summary: DataFrame) -> DataFrame:
    """Subjects by criteria with an All row; a cell reads `mean ± sd`, or a dash where there is no score."""
    cell = F.format_string("%.2f ± %.2f", F.col("mean"), F.col("sd"))
    wide = summary.withColumn("cell", cell).groupBy("subject").pivot("criterion", list(CRITERIA)).agg(F.first("cell"))
    return wide.select("subject", *[F.coalesce(c, F.lit("—")).alias(c) for c in CRITERIA])
