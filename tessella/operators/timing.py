"""Word timing: ticks, shifts, the active word at a time, scene durations and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TICK = 1e-7
HOLD = 3.0
CARD = 2.5


def ticks_to_seconds(rows: DataFrame) -> DataFrame:
    """start, end and duration seconds from offset and duration ticks of 100 ns."""
    start, length = F.col("offset_ticks") * TICK, F.col("duration_ticks") * TICK
    return rows.withColumns({"start_sec": start, "end_sec": start + length, "duration_sec": length})


def shift_words(words: DataFrame, offsets: DataFrame) -> DataFrame:
    """Words moved by their clip's offset; those that end at or before 0 go, starts are held at 0."""
    rows = words.join(offsets, "clip_id", "left").withColumn("_by", F.coalesce("offset_sec", F.lit(0.0)))
    rows = rows.withColumn("end_sec", F.col("end_sec") - F.col("_by")).withColumn("start_sec", F.when(F.col("_by") == 0, F.col("start_sec")).otherwise(F.greatest(F.lit(0.0), F.col("start_sec") - F.col("_by"))))
    return rows.where((F.col("_by") == 0) | (F.col("end_sec") > 0)).drop("_by", "offset_sec")


def active_word_at(words: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (clip_id, t) the last word that began by then if it has not ended, else -1: an as-of join by union and window."""
    w = words.select("clip_id", F.col("start_sec").alias("t"), F.lit(0).alias("kind"), "idx", "end_sec")
    p = probes.select("clip_id", "t", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("double").alias("end_sec"))
    order = W.partitionBy("clip_id").orderBy("t", "kind", "idx").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("idx", "end_sec")), ignorenulls=True).over(order)
    rows = w.unionByName(p).withColumn("_w", last).where("kind = 1")
    return rows.select("clip_id", "t", F.when(F.col("t") <= F.col("_w.end_sec"), F.col("_w.idx")).otherwise(-1).alias("idx"))


def scene_duration(audio: Column, hint: Column) -> Column:
    return F.when(audio <= 0, F.greatest(F.lit(0.1), F.coalesce(hint, F.lit(0.1)))).when(hint.isNull() | (hint <= audio), audio).otherwise(F.least(hint, audio + HOLD))


def scene_timeline(scenes: DataFrame, lesson: str = "lesson_id") -> DataFrame:
    """Start and end of each scene after the opening card, and the total with both cards."""
    order = W.partitionBy(lesson).orderBy("pos")
    before = F.coalesce(F.sum("duration").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = scenes.withColumn("start_sec", before + CARD)
    return rows.withColumn("end_sec", F.col("start_sec") + F.col("duration")).withColumn("total_sec", F.sum("duration").over(W.partitionBy(lesson)) + 2 * CARD)
