"""Registered queries over the streaming forms: each runs the whole table as a stream and returns what it stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import corpus
from tessella.plans import fixtures as fx
from tessella.plans import ingest, learning
from tessella.sources.tables import read_table, scratch_path
from tessella.streaming import jobs as stream

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _place(s: SparkSession, name: str) -> tuple[str, str]:
    """(table path, checkpoint path) in the folder that driver and executors share."""
    base = scratch_path(s, name)
    return f"{base}/table", f"{base}/checkpoint"


BATCHES = 6


def _arrivals(s: SparkSession, path: str) -> DataFrame:
    """The stream of what feed wrote, an arrival a batch."""
    return stream.read_stream(s, path, s.sparkContext.defaultParallelism)


def feed(rows: DataFrame, path: str, ts: str | None = None, tick: dict | None = None) -> int:
    """Writes rows as BATCHES arrivals into the folder path, one after another; returns the seconds that a row may be late.

    With ts a batch is a stretch of time, but every fifth row comes one batch later, and one last arrival holds the row
    `tick`, far ahead, which moves the clock past all others. Without ts rows are dealt by doc_id, and every fifth comes twice.
    An arrival is as many files as there are cores, so that no task writes or holds a whole one.
    """
    files = rows.sparkSession.sparkContext.defaultParallelism
    if ts is None:
        turn, again = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)), F.col("doc_id") % 5 == 0
        dealt = rows.withColumn("_turn", F.explode(F.when(again, F.array(turn, turn + 1)).otherwise(F.array(turn))))
        late = 0
    else:
        first, last = rows.agg(F.min(ts), F.max(ts)).first()
        span = max(1.0, (last - first).total_seconds()) if first else 1.0
        place = F.floor((F.unix_micros(ts) - F.unix_micros(F.lit(first))) / F.lit(span * 1e6 / BATCHES))
        dealt = rows.withColumn("_turn", F.least(F.lit(BATCHES - 1), place) + (F.col("event_id") % 5 == 0).cast("int"))
        late = int(2 * span / BATCHES) + 1
    for i in range(BATCHES + 1):
        dealt.where(F.col("_turn") == i).drop("_turn").repartition(files).write.mode("append").parquet(path)
    if tick:
        far = rows.limit(1).select(*[F.lit(tick[c]).cast(t).alias(c) if c in tick else (F.lit(last) + F.expr("INTERVAL 400 DAYS")).alias(c) if c == ts else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
        far.coalesce(1).write.mode("append").parquet(path)
    return late


def _events(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("tick", F.lit(False))


@query(
    "stream_learner_state",
    learning._MASTERY + learning._ABILITY + ", w AS (SELECT user_id, list_extract(list(topic ORDER BY mastery, topic) FILTER (mastery < 0.45), 1) AS next_topic FROM mastery GROUP BY 1) SELECT a.user_id, attempts, round(a.ability, 4) AS ability, w.next_topic FROM ability a JOIN w USING (user_id)",
)
def _(s, d):
    """The events come in batches, some late; the states after each learner's last attempt must be those of the batch folds."""
    table, check = _place(s, "learner")
    late = feed(_events(s, d), f"{table}-in", "ts", {"event_id": -1, "user_id": -1, "tick": True})
    e = _arrivals(s, f"{table}-in").select("user_id", "event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("topic"), F.expr(fx.TOPIC_K).alias("question_id"), F.expr("substr('abCD', cast(event_id % 4 AS int) + 1, 1)").alias("selected"), "tick")
    # a tick answers no question, so it goes round the grading
    known = fx.questions(s, d).select("question_id", "correct_option", F.upper(F.coalesce("difficulty", F.lit("MEDIUM"))).alias("difficulty"))
    graded = e.join(known, "question_id", "left").where("tick OR correct_option IS NOT NULL").withColumn("correct", F.upper("selected") == F.upper("correct_option"))
    stream.run_available(stream.stream_learner_state(graded, f"{late} seconds"), table, check, partitions=s.sparkContext.defaultParallelism)
    last = F.struct("at", "event_id")
    return s.read.parquet(table).groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.round(F.max_by("ability", last), 4).alias("ability"), F.max_by("next_topic", last).alias("next_topic"))


@query(
    "stream_job_state",
    f"WITH {fx.JOB_EVENTS_SQL} SELECT job_id, max_by(stage, (ts, event_id)) AS stage, max_by(status, (ts, event_id)) AS status, list_extract(list(progress ORDER BY ts DESC, event_id DESC) FILTER (progress IS NOT NULL), 1) AS progress, count(*) AS events FROM job_events GROUP BY 1",
)
def _(s, d):
    table, check = _place(s, "job")
    feed(_events(s, d).drop("tick"), f"{table}-in", "ts")
    e = _arrivals(s, f"{table}-in").withColumn("k", F.expr(fx.TOPIC_K)).selectExpr(
        "user_id AS job_id", "event_id", "ts", "element_at(array('queued', 'retrieval', 'script', 'scenes', 'speech', 'slides', 'assembly', 'done', 'unheard-of'), cast(k % 9 AS int) + 1) AS stage",
        "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS status", "CASE WHEN event_type = 'error' THEN NULL ELSE k % 101 END AS progress",
    )
    stream.run_available(stream.stream_job_state(e), table, check, "update", s.sparkContext.defaultParallelism)
    return stream.latest_of(s.read.parquet(table), "job_id")


@query("stream_ingest", f"WITH {ingest._CHUNKS}, {ingest._PATHS} SELECT pdf_name, count(*) AS chunks, min(doc_id) AS doc_id FROM chunks JOIN meta USING (doc_id) WHERE NOT contains(lower(pdf_name), 'answer') GROUP BY 1")
def _(s, d):
    """Documents come in batches, some again in the next one, which must leave them out."""
    table, check = _place(s, "ingest")
    feed(ingest.md_docs(s, d, F.expr(ingest._PATH).alias("path")), f"{table}-in")
    sources = corpus.skip_documents(corpus.path_metadata(_arrivals(s, f"{table}-in"))).select("doc_id", "pdf_name", "text")
    stream.stream_ingest(sources, table, check, lambda b: corpus.chunk_documents(b).join(b.select("doc_id", "pdf_name"), "doc_id"))
    return s.read.parquet(table).groupBy("pdf_name").agg(F.count(F.lit(1)).alias("chunks"), F.min("doc_id").alias("doc_id"))


@query("stream_cache_dedupe", f"WITH {learning._ASKS}, {learning.CACHE_SQL} SELECT key, request_id, hit FROM folded_hits")
def _(s, d):
    """By event time, in batches with late requests: the same hits as the batch fold, expiries included."""
    table, check = _place(s, "dedupe")
    late = feed(learning.asks_of(_events(s, d)).select("key", "request_id", "ts", "event_id", "tick"), f"{table}-in", "ts", {"key": "", "request_id": -1, "event_id": -1, "tick": True})
    stream.run_available(stream.stream_cache_dedupe(_arrivals(s, f"{table}-in"), delay=f"{late} seconds"), table, check, partitions=s.sparkContext.defaultParallelism)
    return s.read.parquet(table).select("key", "request_id", "hit")
