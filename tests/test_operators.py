"""Hand-computed cases and invariants of operators that SQL does not check."""

import difflib
import math
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import linediff
from tessella.functions import text as tx
from tessella.operators import corpus, grounding, jobs, learners, metrics, outputs, ratings, retrieval, speech, templates, timing, vectorpages
from tessella.sources import chunkstore


def test_sentences_keep_numbers_and_abbreviations(spark):
    rows = spark.createDataFrame([("Dr. Rao measured 9.8 newtons here. It was then noted down. Ok.",), ("Short.",)], "t string").select(tx.sentences(F.col("t")).alias("s")).collect()
    assert rows[0].s == ["Dr. Rao measured 9.8 newtons here.", "It was then noted down."]
    assert rows[1].s == ["Short."]


PAIRS = [
    (1, "Physics", "t", "Force equals mass times acceleration. F = ma is used here.", "Force equals mass times acceleration [1]. F = mv is wrong here now."),
    (2, "Biology", "t", "The cell has a nucleus inside it.", "Dragons breathe purple fire over mountains daily."),
    (3, "Nope", "t", "", "text without any context"),
]


def test_verdict_invariants(spark):
    pairs = spark.createDataFrame(PAIRS, "pair_id long, subject string, topic string, context string, generated string")
    loose, strict = (grounding.verdicts(pairs, t).collect() for t in (0.45, 0.75))
    report = {r.pair_id: r for r in grounding.grounding_report(pairs, grounding.verdicts(pairs)).collect()}
    assert set(report) == {1, 2} and [r.pair_id for r in grounding.rejected_pairs(pairs).collect()] == [3]
    assert all(r.supported + r.hallucinated == r.sentences for r in report.values())
    assert sum(r.is_hallucination for r in strict) >= sum(r.is_hallucination for r in loose)
    assert all(0 <= r.support <= 1 and 0 <= r.confidence <= 1 for r in loose)
    first = {(r.pair_id, r.idx): r for r in loose}
    assert first[1, 0].types == ["supported"] and "wrong_equation" in first[1, 1].types
    assert "external_knowledge" in first[2, 0].types and first[2, 0].risk == "critical"


def test_missing_citation_hides_unsupported_fact(spark):
    pairs = spark.createDataFrame([(1, "General", "t", "Alpha beta gamma delta words.", "Quite other things are told here today.")], "pair_id long, subject string, topic string, context string, generated string")
    types = grounding.verdicts(pairs).first().types
    assert "missing_citation" in types and "unsupported_fact" not in types
    assert "unsupported_fact" in grounding.verdicts(pairs, citations=False).first().types


def test_rouge_against_plain_dynamic_programme(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    texts = [("a b c d e", "b c x e a"), ("same same", "same same"), ("", "x"), ("p q", "r s"), ("the cat sat on the mat", "on the mat the cat sat")]
    rows = metrics.rouge_l(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "pair_id long, context string, generated string")).collect()
    for r in rows:
        a, b = (x.split() for x in texts[r.pair_id])
        n = lcs(a, b)
        assert r.rouge_l == (round(2 * n / (len(a) + len(b)), 4) if n else 0.0)


def test_version_scores_and_winner(spark):
    rows = [(v, *[x] * 13) for v, x in (("v1", 0.5), ("v2", 0.5), ("v10", 0.4))]
    samples = spark.createDataFrame(rows, "version string, " + ", ".join(f"{m} double" for m in metrics.METRICS))
    scores = metrics.version_scores(samples)
    assert {r.version: r.overall for r in scores.collect()}["v1"] == pytest.approx(0.5)
    assert metrics.winning_version(scores).first().version == "v1"
    assert metrics.metric_matrix(scores, ["v1", "v2", "v10"]).where("metric = 'bar'").first().v1 == "█" * 15 + "░" * 15


def test_diffs_match_the_standard_library(spark):
    rows = [("a", "v1", "v2", "x\ny\nz", "x\nq\nz\nw"), ("b", "v1", "v2", "", "one")]
    for r in templates.line_diffs(spark.createDataFrame(rows, "name string, from_version string, to_version string, old string, new string")).collect():
        old, new = next((o, n) for name, _, _, o, n in rows if name == r.name)
        assert r.diff == list(difflib.unified_diff(old.splitlines(), new.splitlines(), "v1", "v2", lineterm=""))
    assert (r.added, r.removed) in {(2, 1), (1, 0)}


def test_latest_is_numeric(spark):
    t = spark.createDataFrame([("a", f"v{i}", "c") for i in range(1, 12)], "name string, version string, content string")
    row = templates.latest_version(t).first()
    assert (row.latest, row.next_version) == ("v11", "v12")


@pytest.mark.parametrize(
    "subject, raw, spoken",
    [
        ("physics", "v² = u² + 2as", "v squared equals u squared plus 2 a s."),
        ("physics", "The force is 20 N over 5 m", "The force is 20 newtons over 5 metres."),
        ("chemistry", "3H2 and AgNO3 with Na+", "3 hydrogen and Ag N O three with Na ion."),
        ("biology", "mRNA at the 70S unit", "messenger R N A at the seventy S unit."),
        ("nope", r"\frac{a}{b} of m_1 m_2", "a upon b of m 1 m 2."),
        ("physics", "HOOK: remember the units: now", "remember the units, now."),
        ("physics", "", ""),
        ("physics", None, ""),
        ("physics", "9.8 m/s2 and 9.8 m/s^2, 3 m/s 4, 7 km/h. m_1 m then 3kg", "9.8 metres per second squared and 9.8 metres per second squared, 3 metres/s 4, 7 kilometres per hour. m 1 m then 3 kilograms."),
        ("physics", "x^2 + y^{3} - z^{-4} = w^15, a^25", "x squared plus y cubed minus z to the power minus 4 equals w to the power 15, a squared 5."),
        ("physics", r"**Bold** # head `c` \alpha \to \beta_1 \foo $x$ α≤Σ ½ ⁻¹", "Bold head c alpha gives 1 x alpha is less than or equal to sigma half to the power minus to the power one."),
        ("physics", "5/ 6 a/b (x)+(y) up-down 3 - 4 50% 90°", "5 over 6 a/b (x) plus (y) up-down 3 minus 4 50 percent 90 degrees."),
        ("physics", "key units, the formula NEET formula. zero units x units", "key, units, the formula NEET formula. zero units x units."),
        ("chemistry", "H2SO4 (aq) + 2NaOH → C20H42 + O3 at 300 K, SN1 E2 Na+ and Cl+x NEET", "sulphuric acid aqueous plus 2 sodium hydroxide gives C 20 H 42 plus O three at 300 kelvin, S N one E two Na ion and Cl plus x NEET."),
        ("chemistry", "Na+,K+ Fe2 Xy9 CO Hello2 the SN2 mechanism", "Na ion,K ion Fe two Xy9 carbon monoxide Hello2 the S N two mechanism."),
        ("biology", "NADPH, NADP; ATP:: 5' to 3' F1 gen important exception DNAs", "N A D P H, N A D P; A T P, five prime to three prime F one gen, important exception DNAs."),
    ],
)
def test_spoken_text(spark, subject, raw, spoken):
    assert speech.normalize_notation(spark.createDataFrame([(subject, raw)], "subject string, text string")).first().text == spoken


def test_long_texts_are_cut_into_grams_in_linear_time(spark):
    words = [f"w{i % 700}" for i in range(16_000)]
    row = spark.createDataFrame([(" ".join(words),)], "t string").select(tx.ngrams(tx.word_tokens(F.col("t")), 3).alias("g"), tx.ngrams(tx.word_tokens(F.lit("a b")), 3).alias("few"), tx.ngrams(tx.word_tokens(F.col("t")), 1).alias("one")).first()
    assert row.g == [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] and row.few == [] and row.one == words


def test_empty_registry_starts_at_v1(spark):
    row = templates.latest_version(spark.createDataFrame([], "name string, version string, content string")).first()
    assert (row.name, row.latest, row.next_version) == (None, None, "v1")


T = "name string, version string, content string"
ASK = T + ", author string, source_version string"


def test_saved_versions_are_numbered_one_by_one(spark):
    have = spark.createDataFrame([("a", "v1", "x\ny"), ("a", "v2", "x\nz"), ("b", "v1", "q")], T)
    asked = spark.createDataFrame([("a", None, "x\nw", "ann", "v1"), ("a", None, "k", "ann", None), ("b", "v9", "r", "ann", None), ("b", "v9", "s", "ann", None), ("a", "v1", "t", "ann", None), ("a", None, " ", "ann", None)], ASK)
    new = {(r.name, r.version): (r.content, r.source_version, r.added, r.removed) for r in templates.save_version(have, asked).where("operation = 'save'").collect()}
    assert new == {("a", "v10"): ("k\n", "v2", 1, 2), ("a", "v11"): ("x\nw\n", "v1", 1, 1), ("b", "v9"): ("r\n", "v1", 1, 1)}
    assert sorted((r.version or "", r.reason) for r in templates.rejected_requests(have, asked).collect()) == [("", "empty"), ("v1", "exists"), ("v9", "repeated")]
    over = templates.save_version(have, asked.where("version = 'v1'"), overwrite=True).where("name = 'a' AND version = 'v1'").collect()
    assert [(r.content, r.operation, r.source_version, r.added, r.removed) for r in over] == [("t\n", "overwrite", None, 1, 2)]


def test_rollbacks_get_versions_of_their_own(spark):
    have = spark.createDataFrame([("a", "v1", "x"), ("a", "v2", "y"), ("a", "v3", "z")], T)
    rows = templates.rollback_version(have, have.where("version < 'v3'").select("name", "version"), "eve").where("operation = 'rollback'").collect()
    assert sorted((r.version, r.content, r.source_version, r.notes) for r in rows) == [("v4", "x\n", "v1", "Rollback to v1."), ("v5", "y\n", "v2", "Rollback to v2.")]


def test_changelog_of_one_template(spark):
    rows = spark.createDataFrame([("a", "v2", "ann", "t2", "save", "v1", "", {"z": 1.0, "b": 2.0}, 3, 1), ("b", "v1", None, None, None, None, "first", {}, None, None)], "name string, version string, author string, saved_at string, operation string, source_version string, notes string, performance map<string,double>, added int, removed int")
    entries = {r.name: r.entry for r in templates.changelog(rows).collect()}
    assert entries["a"] == '## a v2\n- Author: ann\n- Timestamp: t2\n- Operation: save\n- Source Version: v1\n- Performance: {"b":2.0,"z":1.0}\n- Changes: +3 / -1 lines'
    assert entries["b"] == "## b v1\n- Author: unknown\n- Timestamp: \n- Operation: save\n- Notes: first\n- Changes: +0 / -0 lines"
    assert [r.name for r in templates.changelog(rows, "b").collect()] == ["b"]


def test_unusable_vectors_take_no_part(spark):
    nan = float("nan")
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 0.0])], "chunk_id long, embedding array<double>")
    rows = retrieval.vector_topk(chunks, spark.createDataFrame([(0, [2.0, 0.0]), (1, None)], "query_id long, embedding array<double>"), 5).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in rows] == [(0, 1, 1.0), (0, 8, 1.0), (0, 7, 0.0)]


def test_top_k_by_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (5000, 6)).astype(float) + 0.5
    chunks = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "chunk_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.vector_topk(chunks, chunks.where("chunk_id < 20").withColumnRenamed("chunk_id", "query_id"), 7).collect()}
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    for q in range(20):
        s = np.round(unit @ unit[q], 12)
        best = np.lexsort((np.arange(5000), -s))[:7]
        assert all(s[got[q, r + 1]] == s[b] for r, b in enumerate(best))


def chunk_rows(spark, *rows):
    return spark.createDataFrame([(n, i, text, v, s, "9") for n, i, text, v, s in rows], "pdf_name string, chunk_id int, content string, embedding array<double>, subject string, class_level string")


def stored(spark, path):
    return sorted((r.pdf_name, r.chunk_id, r.content, r.subject) for r in corpus.read_chunks(spark, path).collect())


def test_a_document_that_moves_leaves_nothing_behind(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    corpus.write_chunks(chunk_rows(spark, ("p", 1, "one", [1.0], "s"), ("p", 2, "more", [1.0], "s"), ("q", 1, "other", [1.0], "s"), ("r", 1, "far", [1.0], "u")), path)
    before = sorted(str(f) for f in (tmp_path / "chunks" / "data").rglob("*.parquet"))
    corpus.write_chunks(chunk_rows(spark, ("p", 1, "two", [1.0], "t"), ("r", 1, "gone", None, "u")), path)
    assert stored(spark, path) == [("p", 1, "two", "t"), ("q", 1, "other", "s")]
    assert set(before) < {str(f) for f in (tmp_path / "chunks" / "data").rglob("*.parquet")}
    corpus.compact_chunks(spark, path)
    assert stored(spark, path) == [("p", 1, "two", "t"), ("q", 1, "other", "s")]
    assert len(list((tmp_path / "chunks" / "log").glob("batch_id=*"))) == len(list((tmp_path / "chunks" / "data").glob("batch_id=*"))) == 1


def test_chunks_are_worked_out_once_for_their_files_and_their_documents(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = chunk_rows(spark, ("p", 1, "one", [1.0], "s"), ("q", 1, "other", None, "s"))
    corpus.write_chunks(rows.mapInArrow(counted, rows.schema), f"file://{tmp_path}/chunks")
    assert seen.value == 2 and stored(spark, f"file://{tmp_path}/chunks") == [("p", 1, "one", "s")]
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    held = rows.cache()
    corpus.write_chunks(held, f"file://{tmp_path}/more")
    assert held.is_cached and held.storageLevel.useMemory
    held.unpersist()


def test_a_batch_that_dies_before_its_list_is_never_seen(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/chunks"
    corpus.write_chunks(chunk_rows(spark, ("p", 1, "one", [1.0], "s"), ("q", 1, "other", [1.0], "s")), path)
    for dies in ("move_path", None):
        if dies:
            monkeypatch.setattr(chunkstore, dies, lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            corpus.write_chunks(chunk_rows(spark, ("p", 1, "two", [1.0], "t")), path)
        except OSError:
            assert stored(spark, path) == [("p", 1, "one", "s"), ("q", 1, "other", "s")]
        monkeypatch.undo()
    assert stored(spark, path) == [("p", 1, "two", "t"), ("q", 1, "other", "s")]


def test_filters_on_subject_reach_the_stored_files(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    corpus.write_chunks(chunk_rows(spark, *[(f"d{i}", 1, "x", [1.0], f"s{i % 3}") for i in range(9)]), path)
    corpus.write_chunks(chunk_rows(spark, ("d0", 1, "y", [1.0], "s1")), path)
    plan = corpus.read_chunks(spark, path).where("subject = 's1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subject" in plan and len(corpus.read_chunks(spark, path).where("subject = 's1'").collect()) == 4


def test_cache_of_a_hot_key(spark):
    asks = [("k", i, 10.0 * i) for i in range(3000)] + [("j", 9000 + i, float(i)) for i in range(5)]
    got = {r.request_id: r.hit for r in jobs.cache_hits_ttl(spark.createDataFrame(asks, "key string, request_id long, seconds double").repartition(4), 95).collect()}
    assert all(got[i] == (i % 10 != 0) for i in range(3000)) and [got[9000 + i] for i in range(5)] == [False, True, True, True, True]


def test_scene_duration_cases(spark):
    rows = spark.createDataFrame([(0.0, None), (-1.0, 5.0), (4.0, None), (4.0, 3.0), (4.0, 6.0), (4.0, 20.0)], "a double, h double").select(timing.scene_duration(F.col("a"), F.col("h")).alias("d")).collect()
    assert [r.d for r in rows] == [0.1, 5.0, 4.0, 4.0, 6.0, 7.0]


def test_a_mastery_between_two_figures_is_rounded_up(spark):
    graded = spark.createDataFrame([(1, i, i, "t", "MEDIUM", i == 0) for i in range(2)], "user_id long, event_id long, created_at long, topic string, difficulty string, correct boolean")
    row = learners.learner_dashboard(graded, spark.createDataFrame([], "user_id long")).first()
    assert row.mastery == {"t": 0.4888}  # 0.5 * 0.85 ** 2 + 0.15 * 0.85 = 0.48875


def test_ability_is_clamped_and_ordered(spark):
    rows = [(1, i, 1.0 * i, "easy", False) for i in range(60)]
    graded = spark.createDataFrame(rows, "user_id long, event_id long, created_at double, difficulty string, correct boolean")
    assert -3.0 <= learners.ability_trace(graded).first().ability < -2


def test_chunks_are_numbered_without_gaps(spark):
    text = "intro line\n" + "x" * 6000 + "\n## Part\n| a | b | c |\n| --- | --- | --- |\n| 1 |  | 3 |\n|  |  |  |\ntail"
    rows = corpus.chunk_documents(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).orderBy("doc_id", "chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(1, len(rows) + 1))
    assert [r.content for r in rows if r.chunk_type == "table_row"] == ["a: 1 | c: 3"]
    assert rows[0].previous_text == "" and rows[1].previous_text == rows[0].content[-500:]


def test_encoder_vectors_are_unit_length(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, embedding_text string")
    rows = corpus.embed_batch(chunks, lambda texts: [[len(t) + 1.0, 1.0] for t in texts]).collect()
    assert all(math.isclose(sum(x * x for x in r.embedding), 1, rel_tol=1e-5) for r in rows)


def test_topk_without_queries_or_chunks(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    assert retrieval.vector_topk(none, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")).count() == 0
    assert retrieval.vector_topk(none, spark.createDataFrame([], "query_id long, embedding array<double>")).count() == 0


def test_repair(spark):
    raws = ['{"a": 1}', '```json\n{"a": 1,}\n```', 'see {"a": [1, 2, ]} there', "no json", '{"a": ']
    rows = outputs.repair_json(spark.createDataFrame([(r,) for r in raws], "raw string")).collect()
    assert [r.json for r in rows] == ['{"a": 1}', '{"a": 1}', '{"a": [1, 2]}', None, None]


def test_what_follows_a_json_value_makes_it_malformed(spark):
    raws = ["47 Of the", '{"a": 1}, {"b": 2}', "1, 2", "1], [2", '1}, {"a": 2', '{"a": 1}]', "", " [1]\n", "null", '"x"', "7 ", None]
    rows = outputs.repair_json(spark.createDataFrame([(r,) for r in raws], "raw string")).collect()
    assert [r.json for r in rows] == [None] * 7 + [" [1]\n", "null", '"x"', "7 ", None]
    assert [r.error for r in rows] == ["malformed"] * 7 + [None] * 4 + ["malformed"]
    assert not any(r.was_repaired for r in rows)


def test_stages_of_equal_time_are_placed_by_name(spark):
    rows = spark.createDataFrame([(1, "b", 0.1), (1, "b", 0.2), (1, "a", 0.3), (1, "c", 0.2)], "job_id long, stage string, seconds double")
    assert [(r.stage, r.place) for r in jobs.stage_timing(rows).orderBy("place").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_one_rating_has_no_spread(spark):
    clean = ratings.clean_ratings(spark.createDataFrame([("L", "S", "4", "x", "9")], "listener_id string, sample_id string, naturalness string, clarity string, pacing string"))
    row = ratings.mos_summary(clean, spark.createDataFrame([], "sample_id string, subject string")).where("subject = 'unknown'").first()
    assert (row.n, row["mean"], row.sd) == (1, 4.0, 0.0)


def test_ability_of_one_learner_with_very_many_attempts(spark):
    rows = spark.range(0, 2_000_000, numPartitions=8).select(F.floor(F.col("id") / 1_900_000).alias("user_id"), F.col("id").alias("event_id"), F.col("id").alias("created_at"), F.when(F.col("id") % 3 == 0, "hard").alias("difficulty"), F.when(F.col("id") % 7 != 0, F.col("id") % 2 == 0).alias("correct"))
    got = {r.user_id: (r.attempts, r.ability) for r in learners.ability_trace(rows).collect()}
    a = 0.0
    for i in range(1_900_000):
        a = max(-3.0, min(3.0, a + 0.3 * ((i % 2 == 0 and i % 7 != 0) - 1 / (1 + math.exp((1.5 if i % 3 == 0 else 0.0) - a)))))
    assert got[0] == (1_900_000, pytest.approx(a, abs=1e-9)) and got[1][0] == 100_000
    history = learners.ability_history(rows.where("event_id < 5000")).orderBy("event_id").collect()
    assert len(history) == 5000 and history[-1].ability == learners.ability_trace(rows.where("event_id < 5000")).first().ability
    assert learners.ability_trace(rows.where("false")).count() == 0


def test_a_busy_cache_key_is_cut_at_gaps(spark):
    day = jobs.CACHE_SECONDS
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"), F.col("id").alias("request_id"), (F.col("id") * 7.0 + F.floor(F.col("id") / 5_000) * (day + 1) + F.when(F.col("id") % 15_000 == 0, day / 2).otherwise(0)).alias("seconds"))
    whole = sorted(map(tuple, jobs.cache_hits_ttl(rows).collect()))
    assert sorted(map(tuple, jobs.cache_hits_ttl(rows, busy=1_000).collect())) == whole
    pieces = jobs.cache_pieces(rows, day, 1_000).groupBy("key", "piece").count()
    assert pieces.where("key = 'hot'").count() == 5 and pieces.where("key = 'k1' AND piece > 0").count() == 0
    assert pieces.agg(F.max("count")).first()[0] <= 5_000


def test_a_query_of_another_length_drops_only_itself(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 0.0]), (4, [])], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(10, [1.0, 0.1]), (11, [0.0, 0.0, 5.0]), (12, [1.0] * 9), (13, [])], "query_id long, embedding array<double>")
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in retrieval.vector_topk(chunks, queries, 2).collect()) == [(10, 1, 1), (10, 2, 2), (11, 3, 1)]


@pytest.mark.parametrize("least", [None, 0.6])
def test_pages_give_the_same_hits_and_are_skipped(spark, tmp_path, least, monkeypatch):
    rng = np.random.default_rng(8)
    centers = rng.normal(0, 1, (40, 24))
    v = centers[rng.integers(0, 40, 6000)] + rng.normal(0, 0.15, (6000, 24))
    v[17] = 0
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(7000, [1.0, 2.0], 0), (7001, None, 0), (7002, [float("nan")] * 24, 0)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, kind int").repartition(6).cache()
    queries = chunks.where("chunk_id % 50 = 17 OR chunk_id >= 7000").select(F.col("chunk_id").alias("query_id"), "embedding")
    monkeypatch.setattr(vectorpages, "QUERIES_AT_ONCE", 25)
    index = vectorpages.build(chunks, f"file://{tmp_path}/pages", pivots=64, files=8)
    for test in (None, F.col("kind") == 1):
        got = sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in vectorpages.search(index, queries, 4, least, test).collect())
        want = sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in retrieval.vector_topk(chunks if test is None else chunks.where(test), queries, 4, least).collect())
        assert got == want and len(want) > 400
    assert index.spared > 5 * index.met > 0
    index.read = index.unread = 0
    one = queries.where("query_id = 67")
    assert vectorpages.search(index, one, 4).count() == 4 and index.unread > 5 * index.read > 0


def test_many_queries_go_through_pages(spark, monkeypatch):
    rng = np.random.default_rng(9)
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(0, 1, (300, 5)))], "chunk_id long, embedding array<double>").cache()
    queries = chunks.withColumnRenamed("chunk_id", "query_id")
    want = sorted(map(tuple, retrieval.vector_topk(chunks, queries, 3).select("query_id", "rank", "chunk_id").collect()))
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 50)
    assert sorted(map(tuple, retrieval.vector_topk(chunks, queries, 3).select("query_id", "rank", "chunk_id").collect())) == want


def test_empty_pages(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    index = vectorpages.build(none, f"file://{tmp_path}/pages")
    assert vectorpages.search(index, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")).count() == 0


def plain_matches(generated, context):
    """(idx, best_idx, cosine, evidence) by the definition."""
    tokens = lambda s: [w for w in re.findall("[a-z0-9]+", s.lower()) if len(w) > 1 and w not in tx.STOP_WORDS]
    g, c = [tokens(s) for s in generated], [tokens(s) for s in context]
    df = Counter(w for s in c for w in set(s))
    idf = lambda w: math.log((len(c) + 1) / (df[w] + 1)) + 1 if w in df else math.log(2) + 1
    weigh = lambda s: {w: math.floor(n / len(s) * idf(w) * 1e6 + 0.5 + 1e-9) / 1e6 for w, n in Counter(s).items()}
    gw, cw = [weigh(s) for s in g], [weigh(s) for s in c]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for i, a in enumerate(gw):
        best = (0.0, 0)
        for j, b in enumerate(cw):
            both = norm(a) * norm(b)
            cosine = math.floor(sum(x * b[w] for w, x in a.items() if w in b) / both * 1e6 + 0.5) / 1e6 if both else 0.0
            best = max(best, (cosine, -j))
        if best[0] > 0:
            b = cw[-best[1]]
            shared = sorted((-round(a[w] + b[w], 6), w) for w in a if w in b)
            out.append((i, -best[1], best[0], [w for _, w in shared[:5]]))
    return out


def test_matches_of_long_and_odd_pairs_like_the_definition(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(400)] + ["the", "x", "Größe"])
    text = lambda n: " ".join(f"{' '.join(words[rng.zipf(1.4, 14) % len(words)])}. The end is here now." for _ in range(n))
    pairs = [(1, "Physics", "t", text(60), text(40)), (2, "General", "t", "Only one sentence is here.", text(5)), (3, "General", "t", "one two three", "! ? ."), (None, "General", "t", text(3), text(3))]
    df = spark.createDataFrame(pairs, "pair_id long, subject string, topic string, context string, generated string")
    for most in (1 << 20, 500):
        monkeypatch.setattr(grounding, "PRODUCTS", most)
        got = {}
        for r in sorted(grounding.matched_sentences(df).collect(), key=lambda r: r.idx):
            if r.best_idx is not None:
                got.setdefault(r.pair_id, []).append((r.idx, r.best_idx, r.cosine, r.evidence))
        cut = df.select("pair_id", tx.sentences(F.col("generated")).alias("g"), tx.sentences(F.col("context")).alias("c")).collect()
        assert got == {r.pair_id: m for r in cut if (m := plain_matches(r.g, r.c))}
        tables = [grounding.segment_sentences(df.where("pair_id IS NOT NULL"), s) for s in ("generated", "context")]
        idf = grounding.tfidf_fit(tables[1])
        rows = grounding.matches(grounding._two_sides(*[grounding.tfidf_transform(t, idf) for t in tables])).collect()
        assert sorted((r.pair_id, r.idx, r.best_idx, r.evidence) for r in rows) == sorted((p, i, b, e) for p, m in got.items() if p for i, b, _, e in m)


def test_a_pair_of_twenty_thousand_words_holds_few_products(monkeypatch):
    rng = np.random.default_rng(7)
    sides = [pa.array([[f"t{w}" for w in rng.zipf(1.3, 20) % 3000] for _ in range(1000)], pa.list_(pa.string())) for _ in range(2)]
    tracemalloc.start()
    began = time.time()
    found = grounding._pair_matches(*grounding._weighed(*sides), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1000 and peak < 200e6 and time.time() - began < 10


def edited(rnd, a, k):
    b = list(a)
    for _ in range(rnd.randrange(20)):
        if b:
            i, turn = rnd.randrange(len(b)), rnd.randrange(4)
            if turn == 0:
                del b[i : i + rnd.randrange(1, 9)]
            elif turn == 1:
                b[i:i] = [str(rnd.randrange(k)) for _ in range(rnd.randrange(1, 6))]
            elif turn == 2:
                b[i] = str(rnd.randrange(k))
            else:
                j = rnd.randrange(len(b))
                b[i:i] = b[j : j + rnd.randrange(1, 30)]
    return b


def test_line_diffs_equal_the_standard_ones(monkeypatch):
    monkeypatch.setattr(linediff, "SHORT", 0)
    rnd = random.Random(1)
    for _ in range(500):
        n, k = rnd.choice([0, 1, 3, 10, 40, 230, 400]), rnd.choice([2, 5, 30, 300])
        a = [str(rnd.randrange(k)) for _ in range(n)]
        b = edited(rnd, a, k) if rnd.random() < 0.9 else [str(rnd.randrange(k)) for _ in range(rnd.choice([5, 250]))]
        assert linediff.matching_blocks(a, b) == [tuple(m) for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()]
        assert linediff.unified_lines(a, b, "v1", "v2") == list(difflib.unified_diff(a, b, "v1", "v2", lineterm=""))


def test_a_diff_of_twenty_thousand_lines_is_quick():
    a = [f"line {i % 9000}" for i in range(20_000)]
    every_other = [line if i % 2 else f"new {i}" for i, line in enumerate(a)]
    began = time.time()
    assert len(linediff.matching_blocks([f"l{i}" for i in range(20_000)], [f"l{i}" if i % 2 else "" for i in range(20_000)])) == 10_001
    lines = linediff.unified_lines(a, every_other, "v1", "v2")
    assert sum(x.startswith("+new") for x in lines) == 10_000 and time.time() - began < 2


def test_performance_of_one_side_or_no_number_is_kept(spark):
    rows = spark.createDataFrame([("p", "v1", "v2", "a", "b", {"f1": "0.5", "speed": "2", "note": "x", "same": "s"}, {"f1": "0.75", "note": "y", "same": "s", "new": "3"}), ("q", "v1", "v2", "a", "a", None, {"z": "1"})], "name string, from_version string, to_version string, old string, new string, old_performance map<string,string>, new_performance map<string,string>")
    got = {r.name: {k: tuple(v) for k, v in r.performance_delta.items()} for r in templates.compare_versions(rows).collect()}
    assert got == {"p": {"f1": (0.25, None, None), "new": (None, None, "3"), "note": (None, "x", "y"), "speed": (None, "2", None)}, "q": {"z": (None, None, "1")}}


def test_very_many_names_are_numbered_in_their_order(spark):
    have = spark.createDataFrame([("a", "v7", "old")], "name string, version string, content string")
    asked = spark.range(3000).select(F.concat(F.lit("n"), F.col("id") % 1500).alias("name"), F.lit(None).cast("string").alias("version"), F.concat(F.lit("c"), "id").alias("content"), F.lit("x").alias("author"))
    rows = templates.save_version(have, asked).where("operation = 'save'").select("name", "content", "version").collect()
    order = sorted((r.name, r.content) for r in rows)
    assert {(r.name, r.content): r.version for r in rows} == {k: f"v{8 + i}" for i, k in enumerate(order)} and len(order) == 3000


def test_recent_log_cuts_inside_one_microsecond(spark):
    rnd = random.Random(2)
    at = [1_700_000_000_000_000 + rnd.choice([0, 1, 5_000, 70_000_000, 70_000_001, 9_000_000_000]) for _ in range(400)]
    rows = [(i, t, "x" * rnd.randrange(9)) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "id long, at long, props string").withColumn("ts", F.timestamp_micros("at")).drop("at")
    newest = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    for most in (0, 3, 40, 333, 900, 1500, 10_000):
        want, used = {}, 0
        for i, _, text in newest:
            used += len(text)
            if used > most:
                break
            want[i] = used
        assert {r.id: r.used for r in retrieval.recent_log(df, most, "props", "ts", "id").collect()} == want


def test_marks_inside_a_text_are_left_out(spark):
    rows = spark.createDataFrame([("5 kg of \ufdd0H\ufdd1 and 3 m/s", "Physics"), ("5 kg of H and 3 m/s", "Physics")], "text string, subject string")
    spoken = [r.text for r in speech.normalize_notation(rows).collect()]
    assert spoken[0] == spoken[1] and "\ufdd0" not in spoken[0]
    units = rows.select(speech.expand_units(F.col("text")).alias("u")).collect()
    assert units[0].u == units[1].u


def test_versions_are_compared_without_sending_their_tokens(spark):
    none = F.create_map().cast("map<string,string>")
    rows = spark.createDataFrame([("n", "v1", "v2", "a A b", "A b\nc"), ("n", "v2", "v3", "", None)], "name string, from_version string, to_version string, old string, new string")
    out = templates.compare_versions(rows.withColumns({"old_performance": none, "new_performance": none}))
    assert [(r.to_version, r.added, r.removed, r.changed, r.similarity) for r in out.orderBy("to_version").collect()] == [("v2", 2, 1, 3, 0.7746), ("v3", 0, 0, 0, 0.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_a_quiz_context_meets_all_its_questions_at_once(spark, monkeypatch):
    """The context's words are made in one row a quiz and context; nulls, empty references and repeated contexts count as before."""
    questions = spark.createDataFrame([(1, "alpha beta"), (1, "alpha no1 no2 no3"), (1, None), (2, "one"), (2, "One ONE"), (3, "lost"), (4, "x y")], "id long, reference string")
    contexts = spark.createDataFrame([(1, "Alpha, beta and gamma."), (2, None), (4, "x"), (4, "nothing"), (5, "more")], "id long, context string")
    times = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            times.add(batch.num_rows)
            yield batch

    joined = type(contexts).join

    def counted(left, right, *on):
        out = joined(left, right, *on)
        return out.mapInArrow(seen, out.schema) if "context" in out.columns else out

    monkeypatch.setattr(type(contexts), "join", counted)
    got = {tuple(r) for r in outputs.quiz_grounding(questions, contexts).select("id", "is_grounded", "errors").collect()}
    assert got == {(1, False, 2), (2, False, 2), (4, False, 1)} and times.value == 4


def test_signs_are_translated_only_in_texts_that_hold_them(spark):
    rows = [("physics", "3a 4ab 5abc 6abcd 7Ab x8a _9a 0a_ 1é 2é3a \ufdd04b\ufdd1 x₂ 10a 5ab."), ("physics", "Learn  the FORMULA, learn\tformula; One formula _a units ab units a units"), ("chemistry", "a rare Trend and REMEMBER that x₁")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, subject string, text string")
    passed = [r.text for r in speech.subject_pass(frame).orderBy("i").collect()]
    assert passed[0] == "3 a 4 a b 5 a b c 6abcd 7Ab x8a _9a 0a_ 1é 2é3a 4 b x₂ 10a 5 a b."
    assert [r.text for r in speech.inject_prosody(frame).orderBy("i").collect()][1:] == ["Learn the FORMULA, learn, formula; One formula _a, units ab, units a units.", "a rare, Trend and REMEMBER that x₁."]
    plan = speech.normalize_notation(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2 and not [part for part in plan.split("translate(")[:-1] if not part.endswith("THEN ")]


def plain_split(text):
    return re.sub(r"(?<!\w)[0-9][a-z]{1,3}(?!\w)", lambda m: " ".join(m.group()), text)


def test_letters_glued_to_a_digit_are_split_as_by_a_plain_rule(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("01abcA_ .,é\n") for _ in range(60)) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", speech._SPLIT(F.col("text")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [plain_split(t) for t in texts]
