"""Streams in many batches: late rows, timers, a stop and a crash between batches, against the batch operators."""

import random
from types import SimpleNamespace

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.operators import jobs as batch
from tessella.operators import learners
from tessella.plans import flowing
from tessella.streaming import jobs as stream
from tessella.streaming import ordered

START = 1_700_000_000


def arrivals(spark, rows, schema, path, batches, late, tick, at=2):
    """Folders of one arrival each: time slices, some rows one slice late; the last moves the clock."""
    rnd = random.Random(7)
    rows = sorted(rows, key=lambda r: r[at])
    size = -(-len(rows) // batches)
    turns = [[] for _ in range(batches + 2)]
    for i, r in enumerate(rows):
        turns[i // size + (late and rnd.random() < 0.3)].append((*r, False))
    turns[-1].append((*tick, True))
    for i, part in enumerate(turns):
        frame = spark.createDataFrame(rnd.sample(part, len(part)), schema + ", tick boolean") if part else None
        if frame is not None:
            frame.withColumn("at", F.timestamp_micros("at")).coalesce(1).write.parquet(f"{path}/in-{i}")
    return [f"{path}/in-{i}" for i, p in enumerate(turns) if p]


def move_in(spark, folder, into):
    spark.read.parquet(folder).coalesce(1).write.mode("append").parquet(into)


def starts(spark, parts, into, run):
    """Moves the arrivals in and starts the query after each third one: every file is a batch, every start goes on from the checkpoint."""
    for i, folder in enumerate(parts):
        move_in(spark, folder, into)
        if i % 3 == 2 or i == len(parts) - 1:
            run()


def batches_run(folder):
    return sum(1 for p in folder.glob("commits/*") if p.name.isdigit())


def requests():
    rnd = random.Random(3)
    return [(f"k{rnd.randrange(6)}", i, int((START + rnd.random() * 86_400 * 6) * 1e6)) for i in range(900)] + [("lone", 900 + i, int((START + 86_400 * i) * 1e6)) for i in range(6)]


@pytest.mark.parametrize("late", [False, True])
def test_cache_hits_expire_in_the_stream_as_in_the_batch(spark, tmp_path, late):
    base = f"file://{tmp_path}"
    parts = arrivals(spark, requests(), "key string, request_id long, at long", base, 6, late, ("", -1, int((START + 86_400 * 60) * 1e6)))

    def run():
        source = stream.read_stream(spark, f"{base}/all").withColumnRenamed("at", "ts")
        stream.run_available(stream.stream_cache_dedupe(source, delay="2 days" if late else "0 seconds"), f"{base}/out", f"{base}/check", partitions=2)

    starts(spark, parts, f"{base}/all", run)
    got = spark.read.parquet(f"{base}/out")
    assert batches_run(tmp_path / "check") >= 6 and got.select("batch").distinct().count() >= 4
    whole = spark.createDataFrame(requests(), "key string, request_id long, at long").withColumn("seconds", F.col("at") / 1e6)
    want = sorted(map(tuple, batch.cache_hits_ttl(whole).select("key", "request_id", "hit").collect()))
    assert sorted(map(tuple, got.select("key", "request_id", "hit").collect())) == want
    assert 0 < sum(not hit for _, _, hit in want) < len(want) and sum(not hit for k, _, hit in want if k == "lone") == 6


def test_a_late_request_beyond_the_delay_is_left_out(spark, tmp_path):
    base = f"file://{tmp_path}"
    days = lambda n: int((START + 86_400 * n) * 1e6)
    for i, rows in enumerate([[("a", 1, days(0), False)], [("a", 2, days(5), False)], [("a", 3, days(1), False), ("a", 4, days(5.5), False)], [("", -1, days(50), True)]]):
        spark.createDataFrame(rows, "key string, request_id long, at long, tick boolean").withColumn("ts", F.timestamp_micros("at")).drop("at").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream.run_available(stream.stream_cache_dedupe(stream.read_stream(spark, f"{base}/in"), delay="1 day"), f"{base}/out", f"{base}/check", partitions=1)
    assert {r.request_id: r.hit for r in spark.read.parquet(f"{base}/out").collect()} == {1: False, 2: False, 4: True}


def attempts():
    rnd = random.Random(5)
    return [(rnd.randrange(4), i, int((START + rnd.randrange(400) * 900) * 1e6), rnd.choice(["a", "b", "c", "d"]), rnd.choice(["EASY", "MEDIUM", "HARD"]), rnd.choice([True, False, False, None])) for i in range(500)]


def test_learner_states_in_late_batches_equal_the_folds(spark, tmp_path):
    base, schema = f"file://{tmp_path}", "user_id long, event_id long, at long, topic string, difficulty string, correct boolean"
    parts = arrivals(spark, attempts(), schema, base, 6, True, (-1, -1, int((START + 86_400 * 60) * 1e6), None, None, None))
    starts(spark, parts, f"{base}/all", lambda: stream.run_available(stream.stream_learner_state(stream.read_stream(spark, f"{base}/all").withColumnRenamed("at", "created_at"), "2 days"), f"{base}/out", f"{base}/check", partitions=2))
    got = spark.read.parquet(f"{base}/out").cache()
    assert batches_run(tmp_path / "check") >= 6 and got.count() == 500
    graded = spark.createDataFrame(attempts(), schema).withColumn("created_at", F.timestamp_micros("at"))
    last = F.struct("at", "event_id")
    final = {r.user_id: (round(r.a, 9), r.n) for r in got.groupBy("user_id").agg(F.max_by("ability", last).alias("a"), F.max_by("next_topic", last).alias("n")).collect()}
    ability = {r.user_id: round(r.ability, 9) for r in learners.ability_trace(graded).collect()}
    mastery = learners.mastery_trace(graded).cache()
    topics = {r.user_id: r.next_topic for r in learners.next_topic(mastery).collect()}
    assert final == {u: (ability[u], topics[u]) for u in ability}
    topic = {r.event_id: r.topic for r in graded.select("event_id", "topic").collect()}
    ends = {}
    for r in sorted(got.collect(), key=lambda r: (r["at"], r.event_id)):
        ends[r.user_id, topic[r.event_id]] = r.mastery
    assert {k: round(v, 9) for k, v in ends.items()} == {(r.user_id, r.topic): round(r.mastery, 9) for r in mastery.collect()}


def job_events(n):
    rnd = random.Random(9)
    return [(i, rnd.randrange(20), START + rnd.randrange(100), rnd.choice(["queued", "speech", "done"]), rnd.choice(["running", "failed"]), rnd.choice([None, 5, 60])) for i in range(n)]


def test_job_states_after_a_crash_between_batches(spark, tmp_path, monkeypatch):
    base, schema = f"file://{tmp_path}", "event_id long, job_id long, ts long, stage string, status string, progress int"
    rows = job_events(300)
    for i in range(6):
        spark.createDataFrame(rows[i * 50 : i * 50 + 50], schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    run = lambda: stream.run_available(stream.stream_job_state(stream.read_stream(spark, f"{base}/in")), f"{base}/out", f"{base}/check", "update", 2)
    from pyspark.sql.readwriter import DataFrameWriter

    plain = DataFrameWriter.parquet

    def dies(self, path, *a, **b):
        plain(self, path, *a, **b)  # the third batch is stored, and the query dies before it is marked as done
        if path.endswith("batch=3"):
            raise OSError("lost")

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.undo()
    assert spark.read.parquet(f"{base}/out").agg(F.max("batch")).first()[0] == 3
    run()
    got = spark.read.parquet(f"{base}/out")
    assert got.select("batch").distinct().count() == 6
    whole = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts")).withColumn("error", F.lit(None).cast("string"))
    want = batch.job_latest_state(whole).select("job_id", "stage", "status", "progress", "events")
    assert sorted(map(tuple, stream.latest_of(got, "job_id").select("job_id", "stage", "status", "progress", "events").collect())) == sorted(map(tuple, want.collect()))


def test_sources_are_stored_once_over_batches_and_a_crash(spark, tmp_path):
    base = f"file://{tmp_path}"
    batches = [[(1, "a", "x"), (2, "b", "y")], [(3, "c", "z"), (4, "a", "again")], [(5, "d", "w"), (6, "d", "twice")], [(7, "c", "again"), (8, "e", "v")]]
    for rows in batches:
        spark.createDataFrame(rows, "doc_id long, pdf_name string, text string").coalesce(1).write.mode("append").parquet(f"{base}/in")
    tries = []

    def chunk(df):
        tries.append(1)
        if len(tries) == 3:
            raise OSError("lost")
        return df.withColumn("chunk_id", F.lit(1))

    go = lambda: stream.stream_ingest(stream.read_stream(spark, f"{base}/in"), f"{base}/store", f"{base}/check", chunk)
    with pytest.raises(Exception, match="lost"):
        go()
    go()
    go()  # nothing new: nothing changes
    assert sorted(map(tuple, spark.read.parquet(f"{base}/store").select("pdf_name", "doc_id", "batch").collect())) == [("a", 1, 0), ("b", 2, 0), ("c", 3, 1), ("d", 5, 2), ("e", 8, 3)]


def test_an_arrival_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    flowing.feed(rows, f"file://{tmp_path}/in")
    counts = [pq.ParquetFile(f).metadata.num_rows for f in tmp_path.glob("in/*.parquet")]
    assert sum(counts) == 7200 and max(counts) < 400  # six arrivals of about 1,200 rows


class Held:
    """A list state that counts its elements."""

    def __init__(self):
        self.items = []

    def get(self):
        return iter(self.items)

    def exists(self):
        return bool(self.items)

    def appendList(self, new):  # noqa: N802
        self.items += new

    def put(self, new):
        self.items = list(new)

    def clear(self):
        self.items = []


def test_waiting_rows_are_one_element_of_the_state():
    class Counted(ordered.InOrder):
        waiting, out = ["at", "id"], ["id"]

        def start(self, handle):
            pass

        def fold(self, key, rows):
            return [(r[1],) for r in rows]

    held, clock, timers = Held(), [0], []
    state = Counted()
    state.init(SimpleNamespace(getListState=lambda *_: held, registerTimer=timers.append))
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: clock[0])
    come = lambda *at: [i for f in state.handleInputRows(("k",), iter([pd.DataFrame({"at": at, "id": at, "tick": False})]), times) for i in f["id"]]
    assert come(*range(9000, 1000, -1000)) == [] and len(held.items) == 1 and timers == [2]
    assert come(3500, 20_000) == [] and len(held.items) == 2
    clock[0] = 4
    assert come(30_000) == [2000, 3000, 3500, 4000] and timers[-1] == 5
    clock[0] = 20
    assert [i for f in state.handleExpiredTimer(("k",), times, None) for i in f["id"]] == [5000, 6000, 7000, 8000, 9000, 20_000]
    assert len(held.items) == 1
