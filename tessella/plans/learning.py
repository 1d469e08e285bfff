"""Registered queries over learners, job events and ratings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.rounding import rounded
from tessella.operators import jobs, learners, ratings
from tessella.plans import fixtures as fx
from tessella.sources.tables import read_table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_GRADED = f"WITH {fx.ATTEMPTS_SQL}, graded AS (SELECT a.*, upper(coalesce(q.difficulty, 'MEDIUM')) AS difficulty, upper(a.selected) = upper(q.correct_option) AS correct FROM attempts a JOIN questions q USING (question_id))"
_MASTERY = (
    _GRADED
    + """, aged AS (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY created_at DESC, event_id DESC) - 1 AS age FROM graded),
mastery AS (SELECT user_id, topic, 0.5 * pow(0.85, count(*)) + sum(0.15 * pow(0.85, age) * CAST(correct AS INT)) AS mastery FROM aged GROUP BY 1, 2)"""
)
_ABILITY = """, steps AS (
  SELECT user_id, list([CASE difficulty WHEN 'EASY' THEN -1.0 WHEN 'MEDIUM' THEN 0.0 WHEN 'HARD' THEN 1.5 ELSE 0.0 END::DOUBLE, CAST(correct AS INT)::DOUBLE] ORDER BY created_at, event_id) AS s
  FROM graded GROUP BY user_id),
ability AS (
  SELECT user_id, len(s) AS attempts, list_reduce(list_concat([[0.0::DOUBLE, 0.0::DOUBLE]], s),
    lambda a, x : [greatest(-3.0, least(3.0, a[1] + 0.3 * (x[2] - 1 / (1 + exp(-(a[1] - x[1])))))), 0.0])[1] AS ability FROM steps)"""


def _graded(s: SparkSession, d: str) -> DataFrame:
    return learners.grade_attempts(fx.attempts(s, d), fx.questions(s, d))


@query("grade_attempts", _GRADED + " SELECT user_id, event_id, question_id, difficulty, correct, user_id || ':' || question_id AS attempt_id FROM graded")
def _(s: SparkSession, d: str) -> DataFrame:
    return _graded(s, d).select("user_id", "event_id", "question_id", "difficulty", "correct", "attempt_id")


@query("rejected_attempts", f"WITH {fx.ATTEMPTS_SQL} SELECT user_id, event_id, question_id FROM attempts WHERE question_id NOT IN (SELECT question_id FROM questions)")
def _(s: SparkSession, d: str) -> DataFrame:
    return learners.rejected_attempts(fx.attempts(s, d), fx.questions(s, d)).select("user_id", "event_id", "question_id")


@query("ability_trace", _GRADED + _ABILITY + " SELECT user_id, attempts::INT AS attempts, round(ability, 4) AS ability FROM ability")
def _(s: SparkSession, d: str) -> DataFrame:
    return learners.ability_trace(_graded(s, d)).withColumn("ability", F.round("ability", 4))


@query("mastery_trace", _MASTERY + " SELECT user_id, topic, round(mastery, 4) AS mastery FROM mastery")
def _(s: SparkSession, d: str) -> DataFrame:
    return learners.mastery_trace(_graded(s, d)).withColumn("mastery", rounded(F.col("mastery")))


_WEAK = "coalesce(list(topic ORDER BY topic) FILTER (mastery < 0.45), []::VARCHAR[])"
_STRONG = "coalesce(list(topic ORDER BY topic) FILTER (mastery >= 0.75), []::VARCHAR[])"


@query("weak_strong_topics", _MASTERY + f" SELECT user_id, {_WEAK} AS weak, {_STRONG} AS strong FROM mastery GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return learners.weak_strong_topics(learners.mastery_trace(_graded(s, d)))


@query("next_topic", _MASTERY + " SELECT user_id, list_extract(list(topic ORDER BY mastery, topic) FILTER (mastery < 0.45), 1) AS next_topic FROM mastery GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return learners.next_topic(learners.mastery_trace(_graded(s, d)))


@query(
    "learner_dashboard",
    _MASTERY + _ABILITY + f""", topics AS (SELECT user_id, string_agg(topic || '=' || printf('%.4f', round(mastery, 4)), ',' ORDER BY topic) AS mastery, {_WEAK} AS weak, {_STRONG} AS strong FROM mastery GROUP BY 1),
seen AS (SELECT user_id, count(*) AS watched FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT a.user_id, round(a.ability, 4) AS ability, t.mastery, t.weak, t.strong, coalesce(s.watched, 0) AS watched FROM ability a LEFT JOIN topics t USING (user_id) LEFT JOIN seen s USING (user_id)""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    out = learners.learner_dashboard(_graded(s, d), read_table(s, d, "events").where("event_type = 'view'"))
    return out.withColumn("mastery", F.array_join(F.transform(F.map_entries("mastery"), lambda e: F.format_string("%s=%.4f", e["key"], e["value"])), ","))


@query(
    "attempt_history",
    f"WITH {fx.ATTEMPTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS place FROM attempts) SELECT user_id, event_id, place::INT AS place, count(*) OVER (PARTITION BY user_id) AS total FROM r WHERE place <= 20",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return learners.attempt_history(fx.attempts(s, d)).select("user_id", "event_id", "place", "total")


@query(
    "upsert_latest",
    """WITH r AS (SELECT user_id, event_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END DESC, event_id DESC) AS n FROM events)
SELECT user_id, event_id, value FROM r WHERE n = 1""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "events").select("user_id", "event_id", "value", "ts")
    return learners.upsert_latest(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), "user_id", "ts", "event_id").drop("ts")


@query(
    "register_users",
    """WITH reqs AS (SELECT c_custkey, c_name AS name, lower(trim(' Mail' || (c_custkey % 500) || '@Example.org ')) AS email FROM customer),
first AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY c_custkey) AS n FROM reqs)
SELECT name, email, email IN (SELECT 'mail' || s_suppkey || '@example.org' FROM supplier WHERE s_suppkey % 2 = 0) AS is_admin, 0.0::DOUBLE AS ability, 0 AS answered
FROM first WHERE n = 1 AND email NOT IN (SELECT 'mail' || s_suppkey || '@example.org' FROM supplier WHERE s_suppkey % 3 = 0)""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    reqs = read_table(s, d, "customer").selectExpr("c_custkey", "c_name AS name", "' Mail' || (c_custkey % 500) || '@Example.org ' AS email")
    sup = read_table(s, d, "supplier").selectExpr("s_suppkey", "'MAIL' || s_suppkey || '@example.org' AS email")
    return learners.register_users(reqs, sup.where("s_suppkey % 3 = 0"), sup.where("s_suppkey % 2 = 0"), "c_custkey")


_JOBS = f"WITH {fx.JOB_EVENTS_SQL}"


@query(
    "job_latest_state",
    _JOBS + """ SELECT job_id, max_by(stage, (ts, event_id)) AS stage, max_by(status, (ts, event_id)) AS status,
  list_extract(list(error ORDER BY ts DESC, event_id DESC), 1) AS error, list_extract(list(progress ORDER BY ts DESC, event_id DESC) FILTER (progress IS NOT NULL), 1) AS progress, count(*) AS events FROM job_events GROUP BY 1""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return jobs.job_latest_state(fx.job_events(s, d))


_PERCENT = "CASE stage WHEN 'queued' THEN 5 WHEN 'retrieval' THEN 15 WHEN 'script' THEN 30 WHEN 'scenes' THEN 45 WHEN 'speech' THEN 60 WHEN 'slides' THEN 78 WHEN 'assembly' THEN 92 WHEN 'done' THEN 100 END"


@query("stage_progress", _JOBS + f" SELECT job_id, event_id, stage, {_PERCENT} AS percent FROM job_events WHERE {_PERCENT} IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return jobs.stage_progress(fx.job_events(s, d)).select("job_id", "event_id", "stage", "percent")


@query("list_user_jobs", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT user_id, event_id, place::INT AS place FROM r WHERE place <= 20")
def _(s: SparkSession, d: str) -> DataFrame:
    return jobs.list_user_jobs(read_table(s, d, "events")).select("user_id", "event_id", "place")


@query(
    "stage_timing",
    _JOBS + """, t AS (SELECT job_id, stage, sum(seconds) AS seconds, count(*) AS calls FROM job_events GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN sum(seconds) OVER w > 0 THEN seconds / sum(seconds) OVER w ELSE 0 END AS share, sum(seconds) OVER w AS total FROM t WINDOW w AS (PARTITION BY job_id))
SELECT job_id, stage, round(seconds, 4) AS seconds, calls, round(share, 4) AS share, row_number() OVER (PARTITION BY job_id ORDER BY seconds DESC, stage)::INT AS place FROM u""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return jobs.stage_timing(fx.job_events(s, d)).withColumn("seconds", F.round("seconds", 4)).withColumn("share", F.round("share", 4))


@query("realtime_factor", _JOBS + " SELECT job_id, round(sum(seconds), 4) AS total, max(k2) AS output, CASE WHEN max(k2) > 0 THEN round(sum(seconds) / max(k2), 2) END AS factor FROM (SELECT *, coalesce(progress, 0) AS k2 FROM job_events) GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return jobs.realtime_factor(fx.job_events(s, d), F.coalesce("progress", F.lit(0))).withColumn("total", F.round("total", 4))


_ENGINES = """WITH runs AS (SELECT CASE user_id % 4 WHEN 3 THEN 'engine9' ELSE 'engine' || (user_id % 4) END AS engine, value AS latency, 1 + event_id % 9 AS duration,
  list_extract(['physics', 'biology', 'chemistry'], CAST(event_id % 3 AS INT) + 1) AS subject, CASE WHEN user_id % 4 = 3 THEN 'no voice' WHEN event_type = 'error' THEN 'failed' END AS error FROM events)"""


@query(
    "engine_comparison",
    _ENGINES + """ SELECT engine, round(avg(latency) FILTER (error IS NULL), 4) AS latency, round(avg(latency / duration) FILTER (error IS NULL), 4) AS factor, count(*) FILTER (error IS NULL) AS runs,
  round(avg(latency) FILTER (error IS NULL AND subject = 'physics'), 4) AS latency_physics, round(avg(latency) FILTER (error IS NULL AND subject = 'biology'), 4) AS latency_biology, round(avg(latency) FILTER (error IS NULL AND subject = 'chemistry'), 4) AS latency_chemistry,
  CASE WHEN count(*) FILTER (error IS NULL) = 0 THEN max(error) END AS reason FROM runs GROUP BY 1""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    runs = read_table(s, d, "events").selectExpr(
        "CASE user_id % 4 WHEN 3 THEN 'engine9' ELSE 'engine' || (user_id % 4) END AS engine", "value AS latency", "1 + event_id % 9 AS duration",
        "element_at(array('physics', 'biology', 'chemistry'), cast(event_id % 3 AS int) + 1) AS subject", "CASE WHEN user_id % 4 = 3 THEN 'no voice' WHEN event_type = 'error' THEN 'failed' END AS error",
    )
    return jobs.engine_comparison(runs, ["physics", "biology", "chemistry"])


@query(
    "overhead_vs_baseline",
    """WITH v AS (SELECT event_type AS config, 'v' || (event_id % 5) AS variant, sum(value) + 1 AS seconds, count(*) AS items FROM events GROUP BY 1, 2)
SELECT v.config, v.variant, round(v.seconds, 4) AS seconds, round(v.items / v.seconds, 4) AS rate, round(v.seconds / b.seconds, 4) AS factor, round(v.seconds - b.seconds, 4) AS delta, round((v.seconds / b.seconds - 1) * 100, 4) AS percent
FROM v JOIN v b ON v.config = b.config AND b.variant = 'v0'""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "events").groupBy(F.col("event_type").alias("config"), F.expr("'v' || (event_id % 5)").alias("variant")).agg((F.sum("value") + 1).alias("seconds"), F.count(F.lit(1)).alias("items"))
    return jobs.overhead_vs_baseline(rows, "v0")


_KEY = """sha256('{"model":"m' || (k % 2) || '","system":"' || event_type || '","temperature":"0.2","template":"t' || (k % 10) || '","version":"v1"}')"""
_ASKS = f"asks AS (SELECT event_id AS request_id, epoch(ts)::DOUBLE AS seconds, {_KEY} AS key FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"


def asks_of(events: DataFrame) -> DataFrame:
    """events with request_id, seconds and key of the cache request that each stands for."""
    rows = events.withColumn("k", F.expr(fx.TOPIC_K))
    parts = {"template": F.expr("'t' || (k % 10)"), "version": F.lit("v1"), "system": F.col("event_type"), "temperature": F.lit("0.2"), "model": F.expr("'m' || (k % 2)")}
    return rows.withColumns({"request_id": F.col("event_id"), "seconds": F.expr("unix_micros(cast(ts AS timestamp)) / 1000000D"), "key": jobs.response_cache_key(parts)})


def _asks(s: SparkSession, d: str) -> DataFrame:
    return asks_of(read_table(s, d, "events")).select("request_id", "seconds", "key")


@query("response_cache_key", f"WITH {_ASKS} SELECT request_id, key FROM asks")
def _(s: SparkSession, d: str) -> DataFrame:
    return _asks(s, d).select("request_id", "key")


CACHE_SQL = """lists AS (SELECT key, list({'at': seconds, 'id': request_id} ORDER BY seconds, request_id) AS asked FROM asks GROUP BY 1),
folded AS (SELECT key, list_reduce(list_concat([{'w': -1e18::DOUBLE, 'out': []::STRUCT(id BIGINT, hit BOOLEAN)[]}], list_transform(asked, lambda x : {'w': x.at, 'out': [{'id': x.id, 'hit': false}]::STRUCT(id BIGINT, hit BOOLEAN)[]})),
  lambda acc, x : CASE WHEN x.w - acc.w < 86400 THEN {'w': acc.w, 'out': list_append(acc.out, {'id': x.out[1].id, 'hit': true})} ELSE {'w': x.w, 'out': list_append(acc.out, {'id': x.out[1].id, 'hit': false})} END) AS f FROM lists),
folded_hits AS (SELECT key, o.id AS request_id, o.hit AS hit FROM (SELECT key, unnest(f.out) AS o FROM folded))"""


@query("cache_hits_ttl", f"WITH {_ASKS}, {CACHE_SQL} SELECT key, request_id, hit FROM folded_hits")
def _(s: SparkSession, d: str) -> DataFrame:
    return jobs.cache_hits_ttl(_asks(s, d))


_CLEAN = f"""WITH {fx.RATINGS_SQL}, clean AS (SELECT listener_id, sample_id, criterion, TRY_CAST(trim(cell) AS DOUBLE) AS score FROM ratings UNPIVOT INCLUDE NULLS (cell FOR criterion IN (naturalness, clarity, pacing)) WHERE TRY_CAST(trim(cell) AS DOUBLE) BETWEEN 1 AND 5)"""
_SUMMARY = _CLEAN + """, s AS (SELECT coalesce(subject, 'All') AS subject, criterion, count(score) AS n, avg(score) AS m, CASE WHEN count(score) > 1 THEN stddev_samp(score) ELSE 0 END AS sd
  FROM (SELECT c.*, coalesce(m.subject, 'unknown') AS subject FROM clean c LEFT JOIN manifest m USING (sample_id)) GROUP BY GROUPING SETS ((subject, criterion), (criterion)))"""


def _clean(s: SparkSession, d: str) -> DataFrame:
    return ratings.clean_ratings(fx.ratings(s, d))


@query("clean_ratings", _CLEAN + " SELECT * FROM clean")
def _(s: SparkSession, d: str) -> DataFrame:
    return _clean(s, d)


@query("mos_summary", _SUMMARY + " SELECT subject, criterion, n, round(m, 2) AS mean, round(sd, 2) AS sd, round(m - 1.96 * sd / sqrt(n), 2) AS low, round(m + 1.96 * sd / sqrt(n), 2) AS high FROM s")
def _(s: SparkSession, d: str) -> DataFrame:
    return ratings.mos_summary(_clean(s, d), fx.manifest(s, d))


@query("rating_coverage", _CLEAN + " SELECT count(DISTINCT listener_id) AS listeners, count(DISTINCT sample_id) AS samples, count(*) AS scores FROM clean")
def _(s: SparkSession, d: str) -> DataFrame:
    return ratings.rating_coverage(_clean(s, d))


@query("blind_sheet", f"WITH {fx.RATINGS_SQL} SELECT l.listener_id, s.sample_id, s.place::INT AS place FROM (SELECT DISTINCT listener_id FROM ratings) l, (SELECT sample_id, row_number() OVER (ORDER BY md5('92:' || sample_id), sample_id) AS place FROM manifest) s")
def _(s: SparkSession, d: str) -> DataFrame:
    return ratings.blind_sheet(fx.ratings(s, d), fx.manifest(s, d))


@query(
    "mos_matrix",
    _SUMMARY + """ SELECT subject, coalesce(max(c) FILTER (criterion = 'naturalness'), '—') AS naturalness, coalesce(max(c) FILTER (criterion = 'clarity'), '—') AS clarity, coalesce(max(c) FILTER (criterion = 'pacing'), '—') AS pacing
FROM (SELECT *, printf('%.2f ± %.2f', round(m, 2), round(sd, 2)) AS c FROM s) GROUP BY 1""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return ratings.mos_matrix(ratings.mos_summary(_clean(s, d), fx.manifest(s, d)))
