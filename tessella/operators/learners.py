"""Learner analytics: grading, ability and mastery, dashboards, upserts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.rounding import rounded
from tessella.sources.tables import dealt

ABILITY_STEP = 0.3
MASTERY_STEP = 0.15
FIRST_MASTERY = 0.5
WEAK, STRONG = 0.45, 0.75
#: fixed difficulty offsets
OFFSETS = {"EASY": -1.0, "MEDIUM": 0.0, "HARD": 1.5}


def grade_attempts(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Each attempt with its question's outcome; attempts at unknown questions are left to rejected_attempts."""
    known = questions.select("question_id", F.col("correct_option"), F.upper(F.coalesce("difficulty", F.lit("MEDIUM"))).alias("difficulty"))
    rows = attempts.join(known, "question_id")
    return rows.withColumn("correct", F.upper("selected") == F.upper("correct_option")).withColumn("attempt_id", F.concat_ws(":", F.col("user_id").cast("string"), F.col("question_id").cast("string")))


def rejected_attempts(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    return attempts.join(questions.select("question_id"), "question_id", "left_anti")


def _offset(difficulty: Column) -> Column:
    out = F.lit(0.0)
    for name, value in OFFSETS.items():
        out = F.when(F.upper(difficulty) == name, value).otherwise(out)
    return out


def _fold_ability(batches: Iterator[pa.RecordBatch], each: bool) -> Iterator[pa.RecordBatch]:
    """Attempts sorted by user and time to (user_id, attempts, ability), or to every attempt with the ability after it.

    Carried from batch to batch: the user, how many attempts were seen and the ability they led to.
    """
    user, seen, ability = None, 0, 0.0
    for batch in batches:
        users = batch.column("user_id").to_pylist()
        ids, numbers, values = [], [], []
        for i, (u, d, obs) in enumerate(zip(users, batch.column("d").to_pylist(), batch.column("obs").to_pylist())):
            if u != user or not seen:
                if seen and not each:
                    ids.append(user)
                    numbers.append(seen)
                    values.append(ability)
                user, seen, ability = u, 0, 0.0
            seen += 1
            ability = max(-3.0, min(3.0, ability + ABILITY_STEP * (obs - 1 / (1 + math.exp(d - ability)))))
            if each:
                values.append(ability)
        if each:
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), batch.column("event_id"), pa.array(values, pa.float64())], names=["user_id", "event_id", "ability"])
        elif ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("user_id").type), pa.array(numbers, pa.int32()), pa.array(values, pa.float64())], names=["user_id", "attempts", "ability"])
    if seen and not each:
        yield pa.RecordBatch.from_arrays([pa.array([user], batch.schema.field("user_id").type), pa.array([seen], pa.int32()), pa.array([ability], pa.float64())], names=["user_id", "attempts", "ability"])


def _sorted_steps(graded: DataFrame) -> DataFrame:
    steps = graded.select("user_id", "created_at", "event_id", _offset(F.col("difficulty")).alias("d"), F.coalesce(F.col("correct"), F.lit(False)).cast("double").alias("obs"))
    return dealt(steps, "user_id").sortWithinPartitions("user_id", "created_at", "event_id")


def ability_trace(graded: DataFrame) -> DataFrame:
    """(user_id, attempts, ability): final ability of each user; a null answer counts as wrong.

    Each step depends on the last one's clamp, so a user's attempts go through one task in order, but in batches: three
    values are carried and no history stands in one row.
    """
    kind = graded.schema["user_id"].dataType.simpleString()
    return _sorted_steps(graded).mapInArrow(lambda it: _fold_ability(it, False), f"user_id {kind}, attempts int, ability double")


def ability_history(graded: DataFrame) -> DataFrame:
    """(user_id, event_id, ability): the ability after every attempt, by the same fold."""
    kinds = {c: graded.schema[c].dataType.simpleString() for c in ("user_id", "event_id")}
    return _sorted_steps(graded).mapInArrow(lambda it: _fold_ability(it, True), f"user_id {kinds['user_id']}, event_id {kinds['event_id']}, ability double")


def mastery_trace(graded: DataFrame) -> DataFrame:
    """Final mastery of each (user, topic), by the closed form of the exponential average; no ordered state is kept."""
    order = W.partitionBy("user_id", "topic").orderBy(F.desc("created_at"), F.desc("event_id"))
    weighted = graded.withColumn("age", F.row_number().over(order) - 1)
    keep = 1 - MASTERY_STEP
    return weighted.groupBy("user_id", "topic").agg((F.lit(FIRST_MASTERY) * F.pow(F.lit(keep), F.count(F.lit(1))) + F.sum(F.lit(MASTERY_STEP) * F.pow(F.lit(keep), "age") * F.coalesce(F.col("correct"), F.lit(False)).cast("double"))).alias("mastery"))


def weak_strong_topics(mastery: DataFrame) -> DataFrame:
    weak, strong = F.when(F.col("mastery") < WEAK, F.col("topic")), F.when(F.col("mastery") >= STRONG, F.col("topic"))
    return mastery.groupBy("user_id").agg(F.array_sort(F.collect_list(weak)).alias("weak"), F.array_sort(F.collect_list(strong)).alias("strong"))


def next_topic(mastery: DataFrame) -> DataFrame:
    """The weakest weak topic of each user, null if none is weak."""
    weak = F.col("mastery") < WEAK
    return mastery.groupBy("user_id").agg(F.min_by(F.when(weak, F.col("topic")), F.when(weak, F.struct("mastery", "topic"))).alias("next_topic"))


def learner_dashboard(graded: DataFrame, videos: DataFrame) -> DataFrame:
    """Ability, mastery by topic, weak and strong topics, and videos watched, one row for each learner."""
    mastery = mastery_trace(graded)
    topics = mastery.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", rounded(F.col("mastery")).alias("mastery"))))).alias("mastery"))
    seen = videos.groupBy("user_id").agg(F.count(F.lit(1)).alias("watched"))
    out = ability_trace(graded).select("user_id", F.round("ability", 4).alias("ability")).join(topics, "user_id", "left").join(weak_strong_topics(mastery), "user_id", "left").join(seen, "user_id", "left")
    return out.withColumn("watched", F.coalesce("watched", F.lit(0)))


def newest(rows: DataFrame, owner: str, ts: str, tie: str, n: int = 20) -> DataFrame:
    """The newest n rows of each owner with their place; the limit is pushed below the shuffle."""
    order = W.partitionBy(owner).orderBy(F.desc(ts), F.desc(tie))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def attempt_history(attempts: DataFrame, n: int = 20) -> DataFrame:
    """Newest n attempts of each user; total is the number returned."""
    kept = newest(attempts, "user_id", "created_at", "event_id", n)
    return kept.withColumn("total", F.count(F.lit(1)).over(W.partitionBy("user_id")))


def upsert_latest(current: DataFrame, changes: DataFrame, key: str, updated: str, tie: str) -> DataFrame:
    """Union of two tables with one row for each key, the newest; changes win ties over current rows."""
    both = current.withColumn("_from", F.lit(0)).unionByName(changes.withColumn("_from", F.lit(1)))
    order = W.partitionBy(key).orderBy(F.desc(updated), F.desc("_from"), F.desc(tie))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_from")


def register_users(requests: DataFrame, users: DataFrame, admins: DataFrame, order: str) -> DataFrame:
    """New profiles for requests whose normalised email is not registered yet; the first request of an email wins."""
    email = F.lower(F.trim("email"))
    fresh = requests.withColumn("email", email).withColumn("_n", F.row_number().over(W.partitionBy("email").orderBy(order))).where("_n = 1").drop("_n")
    fresh = fresh.join(users.select(F.lower(F.trim("email")).alias("email")).distinct(), "email", "left_anti")
    flags = admins.select(F.lower(F.trim("email")).alias("email")).distinct().withColumn("is_admin", F.lit(True))
    return fresh.join(flags, "email", "left").select("name", "email", F.coalesce("is_admin", F.lit(False)).alias("is_admin"), F.lit(0.0).alias("ability"), F.lit(0).alias("answered"))
