"""Views over the given tables that the registered queries read, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.tables import read_table

TOPIC_K = "cast(regexp_extract(props, '([0-9]+)', 1) AS int)"

ATTEMPTS_SQL = """
attempts AS (
  SELECT user_id, event_id, ts AS created_at, event_type AS topic, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS question_id,
         substr('abCD', CAST(event_id % 4 AS INT) + 1, 1) AS selected FROM events),
questions AS (
  SELECT question_id, topic, correct_option, CASE question_id % 4 WHEN 0 THEN 'Easy' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'hard' ELSE NULL END AS difficulty FROM (
    SELECT question_id, min(topic) AS topic, substr('ABCD', CAST(question_id % 4 AS INT) + 1, 1) AS correct_option
    FROM attempts WHERE question_id % 11 <> 7 GROUP BY question_id))
"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("topic"), F.expr(TOPIC_K).alias("question_id"), F.expr("substr('abCD', cast(event_id % 4 AS int) + 1, 1)").alias("selected")
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir).where("question_id % 11 <> 7").groupBy("question_id").agg(F.min("topic").alias("topic"))
    return rows.select(
        "question_id", "topic", F.expr("substr('ABCD', cast(question_id % 4 AS int) + 1, 1)").alias("correct_option"),
        F.expr("CASE question_id % 4 WHEN 0 THEN 'Easy' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'hard' END").alias("difficulty"),
    )


JOB_EVENTS_SQL = """
job_events AS (
  SELECT user_id AS job_id, event_id, ts,
         list_extract(['queued', 'retrieval', 'script', 'scenes', 'speech', 'slides', 'assembly', 'done', 'unheard-of'], CAST(k % 9 AS INT) + 1) AS stage,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS status,
         CASE WHEN event_type = 'error' THEN NULL ELSE k % 101 END AS progress,
         CASE WHEN event_type = 'error' THEN 'failed at ' || event_id END AS error, value AS seconds
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))
"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").withColumn("k", F.expr(TOPIC_K))
    return rows.selectExpr(
        "user_id AS job_id", "event_id", "ts",
        "element_at(array('queued', 'retrieval', 'script', 'scenes', 'speech', 'slides', 'assembly', 'done', 'unheard-of'), cast(k % 9 AS int) + 1) AS stage",
        "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS status", "CASE WHEN event_type = 'error' THEN NULL ELSE k % 101 END AS progress",
        "CASE WHEN event_type = 'error' THEN 'failed at ' || event_id END AS error", "value AS seconds",
    )


RATINGS_SQL = """
ratings AS (
  SELECT 'L' || (user_id % 10) AS listener_id, 'S' || (event_id % 16) AS sample_id,
         CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE CAST(k % 7 AS VARCHAR) END AS naturalness,
         CASE event_id % 6 WHEN 0 THEN ' ' ELSE CAST(event_id % 6 AS VARCHAR) || '.5' END AS clarity,
         CASE WHEN k % 5 = 4 THEN '9' ELSE CAST(1 + k % 5 AS VARCHAR) END AS pacing
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)),
manifest AS (
  SELECT DISTINCT 'S' || (event_id % 15) AS sample_id, list_extract(['physics', 'biology', 'chemistry'], CAST(event_id % 15 % 3 AS INT) + 1) AS subject FROM events)
"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").withColumn("k", F.expr(TOPIC_K))
    return rows.selectExpr(
        "'L' || (user_id % 10) AS listener_id", "'S' || (event_id % 16) AS sample_id",
        "CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE cast(k % 7 AS string) END AS naturalness",
        "CASE event_id % 6 WHEN 0 THEN ' ' ELSE cast(event_id % 6 AS string) || '.5' END AS clarity",
        "CASE WHEN k % 5 = 4 THEN '9' ELSE cast(1 + k % 5 AS string) END AS pacing",
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr("'S' || (event_id % 15) AS sample_id", "element_at(array('physics', 'biology', 'chemistry'), cast(event_id % 15 % 3 AS int) + 1) AS subject").distinct()


PAIRS_SQL = """
pairs AS (
  SELECT conv_id * 1000 + turn AS pair_id, list_extract(['Physics', 'Biology', 'Chemistry', 'General', 'Unheard'], CAST(conv_id % 5 AS INT) + 1) AS subject,
         'topic ' || CAST(conv_id // 2 AS VARCHAR) AS topic, 'v' || CAST(1 + conv_id % 3 AS VARCHAR) AS version, CAST(conv_id % 2 AS INT) AS mode,
         text || ' The speed of light is 299792458 m/s and F = ma holds for a body. Water gives hydrogen. The kinetic energy is defined as half the mass times speed squared.' AS context,
         nxt || CASE turn % 4 WHEN 0 THEN ' The kinetic energy is defined as half the mass times speed squared [1]. Then F = ma holds here.' WHEN 1 THEN ' The mass of it is 25 kg or so. Photosynthesis needs Blue light always, E = mc^2 where c is speed.' WHEN 2 THEN ' Iron + Oxygen -> Rust in wet air. Dr. Smith found 9.8 N for it.' ELSE '' END AS generated
  FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nrole = 'assistant')
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = PAIRS_SQL.strip().removeprefix("pairs AS (").removesuffix(")")
    sql = sql.replace("list_extract([", "element_at(array(").replace("'Unheard']", "'Unheard')").replace("//", "div").replace("VARCHAR", "STRING").replace("FROM conversations", "FROM {conversations}")
    return spark.sql(sql, conversations=read_table(spark, sf_dir, "conversations"))
