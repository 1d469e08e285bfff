"""The training-data operators against brute force, and on awkward input."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontam, langid, lm, mixing, mtree, neardup, pii, sharding, textkit, tokencount, toxicity
from tessella.llm.gru import END, GRU
from tests.llm import brute
from tests.llm.conftest import ODD_TEXTS


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("kind, words", [(textkit.SPACED, brute.spaced), (textkit.ALNUM, brute.alnum)])
def test_scan_finds_the_words_of_every_row(kind, words):
    texts = [*ODD_TEXTS, "Ab cD", "ab  cd"]
    seen: dict[int, bytes] = {}
    for w in textkit.scan(pa.array(texts), kind, 64):
        hashes, at = w.hashes(), w.bounds
        for r in range(len(w.per_row)):
            own = [w.word(i).decode() for i in range(at[r], at[r + 1])]
            assert own == words(texts[w.first + r])
            for text, h in zip(own, hashes[at[r] : at[r + 1]]):
                assert seen.setdefault(int(h), text) == text
    assert len(set(seen.values())) == len(seen)


def test_interleaving_laws(spark, odd, none):
    rows = sharding.interleave(odd, 4).collect()
    assert len(rows) == odd.count() and sharding.interleave(none, 4).count() == 0
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.get(s, 0) for s in range(4)) <= 1
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
    sizes = {i: len((t or "").encode()) + 1 for i, t in enumerate(ODD_TEXTS)}
    assert all(r.size == sizes[r.doc_id] for r in rows if r.doc_id is not None)


def test_every_shard_matches_the_mixture(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("source"))
    shares = docs.join(sharding.interleave(docs, 8), "doc_id").groupBy("shard").agg(F.avg((F.col("source") == "hot").cast("int")).alias("hot")).collect()
    assert len(shares) == 8 and all(abs(r.hot - 0.6) < 0.01 for r in shares)


def test_near_duplicates_match_brute_force(documents):
    expected = brute.near_components(pairs(documents))
    rows = neardup.near_duplicates(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_an_id_with_two_texts_loses_no_link(spark):
    """Copies that reach one another only through a text whose id also has another text."""
    rng = np.random.default_rng(5)
    rows, groups = [], []
    for letter, first in (("a", 1), ("z", 101)):
        hub = [f"{letter}{i}" for i in range(200)]
        rows.append((50, " ".join(hub)))
        groups.append(set(range(first, first + 6)))
        for copy in range(6):
            own = list(hub)
            for place in range(copy, 30, 6):  # every copy changes other words, so copies are less alike than with the hub
                own[place * 6] = f"{letter}x{copy}"
            rows.append((first + copy, " ".join(own)))
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string").repartition(4)).where("doc_id <> 50").collect()}
    sets = {i: brute.shingles(t) for i, t in rows if i != 50}
    hubs = [brute.shingles(t) for i, t in rows if i == 50]
    for hub, group in zip(hubs, groups):
        assert all(100 * len(hub & sets[i]) >= 80 * len(hub | sets[i]) for i in group)
        assert {found[i] for i in group} == {min(min(group), 50)}


def test_a_large_family_with_members_outside_its_hub(spark):
    """Near copies of one text, some of which are linked with others but not with the original."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(120)]

    def changed(words, n):
        out = list(words)
        for place in rng.choice(len(out), n, replace=False):
            out[place] = f"n{rng.integers(1 << 30)}"
        return out

    rows = [(0, " ".join(base))]
    for i in range(1, 1200):
        near = changed(base, 2)
        rows.append((i, " ".join(near if i % 100 else changed(near, 3))))
    expected = brute.near_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_a_split_family_is_not_met_again_for_each_stranger_in_its_tables(spark, monkeypatch):
    """Only strangers' rows of shared tables are joined; a whole family's class that meets another family is a stranger too."""
    rows = [(key, member) for key in range(20) for member in range(100)] + [(key, 1000 + key) for key in range(20)] + [(50, 2000), (50, 2001), (50, 3000), (60, 2000), (60, 2001)]
    tables = spark.createDataFrame(rows, "key long, class_id long")
    placed = spark.createDataFrame([(m, 0, m % 2) for m in range(100)] + [(2000, 2000, 2000), (2001, 2000, 2000)], "class_id long, family long, root long")
    split = placed.where("family = 0").select("class_id", "root")
    joined, whole = [], neardup.lookup
    monkeypatch.setattr(neardup, "lookup", lambda *a: joined.append(whole(*a).count()) or whole(*a))
    with neardup.Scratch(spark) as held:
        got = {r.class_id for r in neardup._strangers(tables, placed, split, held).collect()}
    assert got == {*range(1000, 1020), 2000, 2001, 3000} and joined == [23]


def test_gru_gradients_and_scores_match_plain_ones():
    """Gradients by small differences; scores by one softmax after another, also where logits are far beyond what exp holds."""
    from tessella.llm.gru import END, GRU

    rng = np.random.default_rng(2)
    for far in (1, 300):
        model = GRU(np.arange(30, 0, -1), hidden=5)
        model.p = {k: a.astype(np.float64) for k, a in model.p.items()}
        model.p["wo"] *= far
        ids, goals, h = rng.integers(0, 20, (6, 4)), rng.integers(0, 20, (6, 4)), rng.normal(0, 0.3, (4, 5))
        ids[2, 1] = END
        loss, g, _ = model.loss_and_gradient(ids, goals, h)
        for k, a in model.p.items():
            rows, values = g[k] if isinstance(g[k], tuple) else (slice(None), g[k])
            whole = np.zeros_like(a)
            whole[rows] = values
            for _ in range(12 if far == 1 else 0):
                at = tuple(rng.integers(0, n) for n in a.shape)
                kept, ends = a[at], []
                for step in (1e-6, -1e-6):
                    a[at] = kept + step
                    ends.append(model.loss_and_gradient(ids, goals, h)[0])
                a[at] = kept
                assert abs((ends[0] - ends[1]) / 2e-6 - whole[at]) < 1e-6
        states, plain = rng.uniform(-1, 1, (24, 5)), []
        for s, i in zip(states, goals.ravel()):
            c, total = i // model.width, 0.0
            for x, at in ((s @ model.p["wc"] + model.p["bc"], c), (s @ model.p["wo"][c] + model.p["bo"][c], i - c * model.width)):
                total += x[at] - x.max() - np.log(np.exp(x - x.max()).sum())
            plain.append(total)
        assert np.allclose(model.log_probs(states, goals.ravel()), plain, atol=1e-9) and np.isfinite(loss)


def test_components_that_fill_one_task_take_no_star_round(spark, monkeypatch):
    """All at once where the edges fill one task; by rounds where they fill more, with the same result."""
    chains = [(10 * c + i, 10 * c + i + 1) for c in range(40) for i in range(8)]
    edges = spark.createDataFrame([*chains, (0, 399), (399, 0), (7, 7), *[(1000, n) for n in range(1001, 1100)], (390, 1050)], "x long, y long").repartition(5).cache()
    expected = {399: 0} | {10 * c + i: 10 * c for c in range(40) for i in range(1, 9)} | {n: 390 for n in range(391, 399)} | {n: 390 for n in range(1000, 1100)}
    for at_once, rounds in ((neardup.EDGES_A_TASK, False), (60, True)):
        monkeypatch.setattr(neardup, "EDGES_A_TASK", at_once)
        with neardup.Scratch(spark) as held:
            got = [(r.node, r.root) for r in neardup.components(edges, held).collect()]
            assert dict(got) == expected and len(got) == len(expected)
            assert any("/stars-" in p for p in held.paths) == rounds


def test_components_of_chains_stars_and_single_links(spark):
    chain, star = [(i, i + 1) for i in range(30)], [(100, i) for i in range(101, 140)]
    edges = spark.createDataFrame([*chain, *star, (200, 201), (7, 7)], "x long, y long")
    with neardup.Scratch(spark) as held:
        got = {r.node: r.root for r in neardup.components(edges, held).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{i: 100 for i in range(101, 140)}, 201: 200}


def test_pages_of_one_template_are_not_compared_all_with_all(spark, monkeypatch):
    """Similarity 0.55 throughout and no duplicates but a few planted ones: compared pairs grow like the pages."""
    compared, blocks = [], []
    confirmed, family = neardup._confirmed, neardup._family_links
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, sets: compared.append(pairs.count()) or confirmed(pairs, sets))
    monkeypatch.setattr(neardup, "_family_links", lambda members, sets: blocks.append(members.count()) or family(members, sets))
    shared, each = [f"t{i}" for i in range(150)], []
    for n in (1000, 4000):
        rows = [(i, " ".join(shared + [f"p{i}w{j}" for j in range(60)])) for i in range(n)]
        rows += [(n + i, text.replace(f"p{i}w7", "other")) for i, text in rows[:50]]
        compared.clear()
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
        assert got == {i: i - n if i >= n else i for i, _ in rows}
        each.append(sum(compared) / len(rows))
    assert not blocks and max(each) < 60 and each[1] < 1.5 * each[0]


def test_recall_just_above_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.82, each by itself: as good as none is missed."""
    rng = np.random.default_rng(8)
    rows, linked = [], []
    for i in range(2500):
        words = [f"d{i}w{j}" for j in range(103)]
        other = list(words)
        for place in [*rng.permutation(np.arange(12, 92, 4))[:2], *range(-2 - i % 2, 0)]:
            other[place] = "x" + other[place]
        a, b = set(zip(*[words[j:] for j in range(4)])), set(zip(*[other[j:] for j in range(4)]))
        if 0.80 <= len(a & b) / len(a | b) <= 0.82:
            linked.append(i)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert len(linked) > 500 and np.mean([got[2 * i + 1] == 2 * i for i in linked]) > 0.999


def test_repeated_and_null_ids_of_near_duplicates(spark):
    words = lambda seed: " ".join(f"{seed}{i}" for i in range(20))
    rows = [(None, words("a")), (None, words("a")), (None, words("b")), (7, words("b")), (3, words("c")), (3, words("c")), (9, None)]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("None", "None", True)] * 2 + [("None", "7", False), ("7", "7", True), ("3", "3", True), ("3", "3", True), ("9", "9", True)])
    empty = neardup.near_duplicates(spark.createDataFrame(rows[:0], "doc_id long, text string"))
    assert empty.count() == 0


@pytest.mark.parametrize("k", [4, 5, 7])
def test_scans_shorter_than_a_shingle(k):
    for n in range(k):
        words = next(textkit.scan(pa.array(["w " * n]), textkit.SPACED))
        assert [len(s) for s in neardup._shingle_sets(words, k)] == [int(n > 0)]


def test_near_duplicates_chain_and_outsiders(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for k in range(60):  # a family of edited copies, some below the threshold of every hub
        w = base.copy()
        for p in rng.choice(120, size=int(rng.integers(0, 9)), replace=False):
            w[p] = f"e{k}_{p}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()} == brute.near_components(list(enumerate(texts)))


def test_near_duplicates_of_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and neardup.near_duplicates(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and all(by[i].component_id == i for i in (0, 1, 2))
    assert by[6].component_id == 5 and not by[6].kept and by[3].n_shingles == 1
    assert sum(r.doc_id == 4 and r.kept for r in rows) == 3


def test_decontamination_matches_brute_force(spark, small, documents):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    expected = brute.contamination(pairs(documents), [(r.item_id, r.text) for r in bench.collect()])
    rows = decontam.decontaminate(documents, bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == expected
    assert all(r.items_sha256 == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() and r.contaminated == (r.n_hit > 0) for r in rows)


def test_decontamination_in_slices_gives_the_same(spark, small, documents, monkeypatch):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    one = sorted((r.doc_id, r.n_hit, r.items_sha256) for r in decontam.decontaminate(documents, bench, slop=0).collect())
    monkeypatch.setattr(decontam, "SLICE_BYTES", 1500)
    assert sorted((r.doc_id, r.n_hit, r.items_sha256) for r in decontam.decontaminate(documents, bench, slop=0).collect()) == one


def test_decontamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "word word"), (2, None), (3, "..."), (4, "The SAME words; stand here again and again for a while"), (5, "The same words stand here again and again for a while"), (6, "no such thing")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.decontaminate(odd, bench).collect()}
    assert decontam.decontaminate(none, bench).count() == 0
    assert decontam.decontaminate(odd, bench.where("item_id > 9")).where("contaminated").count() == 0
    assert rows[5]["items"] == ["4", "5"] and rows[5].n_hit == 11 and rows[9].n_hit == 20_000 and rows[0].n_words == 0


def test_proximity_matches(spark):
    item = " ".join(f"t{i}" for i in range(10))
    moved = item.replace("t4", "extra t4")
    docs = spark.createDataFrame([(1, "pre " + item), (2, "pre " + moved), (3, "t1 t2 unrelated words")], "doc_id long, text string")
    rows = {r.doc_id: (r.n_items, r.n_near) for r in decontam.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert rows == {1: (1, 1), 2: (0, 1), 3: (0, 0)}


def test_proximity_matches_brute_force_whatever_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(21)
    vocab = [f"v{i}" for i in range(120)]
    items = [(k, " ".join(rng.choice(vocab, n))) for k, n in enumerate([3, 7, 10, 14, 25, 25, 40])]
    docs = []
    for i in range(160):
        words = list(rng.choice(vocab, 20))
        passage = items[i % len(items)][1].split()
        for _ in range(int(rng.integers(0, 6))):  # words changed, put in, left out or swapped
            at, kind = int(rng.integers(len(passage))), int(rng.integers(4))
            if kind == 0:
                passage[at] = str(rng.choice([*vocab, "unseen"]))
            elif kind == 1:
                passage.insert(at, "extra")
            elif kind == 2 and len(passage) > 2:
                passage.pop(at)
            elif at:
                passage[at - 1], passage[at] = passage[at], passage[at - 1]
        docs.append((i, " ".join([*words[:10], *passage, *words[10:]])))
    expected, exact = brute.near_items(docs, items), brute.contamination(docs, items)
    assert sum(n > len(exact[i][2]) for i, n in expected.items()) > 40  # near only
    bench = spark.createDataFrame(items, "item_id long, text string")
    for parts, block in ((1, decontam.BLOCK_BYTES), (7, 200)):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
        got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), bench).collect()
        assert {r.doc_id: r.n_near for r in got} == expected and all(r.n_items == len(exact[r.doc_id][2]) for r in got)


def test_personal_data_matches_brute_force(spark, documents):
    hard = ["a@b.com%x@y.org and 1.2.3.4.5.6.7.8", "é😀 jo.do@x-y.co.uk, +1 (988) 555-2485 4111 1111 1111 1111", "9" * 5000, "300.1.2.3 001.002.003.004 +12 +1 234 567 8901.", "a@b.c." * 2000, None, "", "x" * 100_000 + "@", "1.2.3.4" * 50, "+" * 500 + "1 2 3 4 5 6 7 8 9"]
    for df in (documents, spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")):
        texts = dict(pairs(df))
        for r in pii.find_personal_data(df).collect():
            base = brute.base_spans(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in base) for k in brute.PII)
            assert set(base) <= set(r.spans.split(",") if r.spans else [])


def test_personal_data_adds_what_the_labelers_agree_on(spark):
    """Written-out addresses in telling surroundings are added, look-alikes without them are not; base spans stay."""
    rows = [(i, f"contact me by mail: user{i}@example.com or call +1 415 555 {1000 + i}, thanks.") for i in range(60)]
    rows += [(100 + i, f"please write, contact mail: user{i} (at) example (dot) com today, or write user{i}@mail.org now") for i in range(20)]
    rows += [(200 + i, f"meet{i}x(at)9noon9xy") for i in range(5)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i, r in got.items():
        base, spans = brute.base_spans(texts[i]), r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans)
        places = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in spans))
        assert all(b <= c for (_, b), (c, _) in zip(places, places[1:]))
        added = [texts[i][int(a) : int(b)] for _, a, b in (x.split(":") for x in spans if x not in base)]
        assert added == ([f"user{i - 100} (at) example (dot) com"] if 100 <= i < 200 else [])


def test_reliabilities_by_a_plain_version():
    """Rates after one round, and the belief that follows from them, by Bayes' rule."""
    table = [((1, 1, 1, 1, 1, 1, 1), 30), ((0, 1, 1, 0, 1, 0, 1), 9), ((0, 0, 0, 0, 0, 1, 0), 50)]
    yes, no, belief = pii.reliabilities(table, 1)
    first = [0.98, 4 / 7, 1 / 7]
    true, n = sum(q * c for q, (_, c) in zip(first, table)), sum(c for _, c in table)
    assert yes[0] == pytest.approx((0.98 * 30 + 0.9) / (true + 1)) and no[5] == pytest.approx((0.02 * 30 + 6 / 7 * 50 + 0.3) / (n - true + 1))
    prior = (true + 1) / (n + 2)
    like = lambda rates, v: math.prod(r if x else 1 - r for r, x in zip([min(r, 0.999) for r in rates], v))
    for q, (v, _) in zip(belief, table):
        a, b = prior * like(yes, v), (1 - prior) * like(no, v)
        assert q == pytest.approx(a / (a + b), abs=1e-9)


def test_personal_data_of_odd_rows(odd, none):
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(none).count() == 0


def test_word_base_matches_brute_force(documents):
    tokens = {i: [*brute.spaced(t), "</>"] for i, t in pairs(documents)}
    held = {i: brute.crc(i) % 7 == 2 for i in tokens}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    rows = lm.score_documents(documents, sample_docs=60, rounds=2).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens[r.doc_id]), sum(count[w] > 0 for w in tokens[r.doc_id]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_language_model_of_odd_rows(odd, none):
    rows = {r.doc_id: r for r in lm.score_documents(odd, sample_docs=10, rounds=1).collect()}
    assert rows[0].n_tokens == rows[1].n_tokens == 1 and rows[9].n_tokens == 20_001 and rows[0].score == rows[1].score
    assert lm.score_documents(none).count() == 0


def test_language_model_learns_from_every_training_text(spark):
    """Word pairs stand only in one text beyond 20,000 bytes and in texts beyond the first 800."""
    rng = np.random.default_rng(3)
    noise = lambda n: " ".join(f"n{j}" for j in rng.integers(0, 1500, n))
    rows = [(i, noise(30)) for i in range(1000)] + [(i, "left right " * 4000) for i in (1000, 1001, 1002)] + [(1003, "left right " * 40), (1004, "right left left right right left left right " * 10)]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    gain = {i: (got[i].score - got[i].base_score) / got[i].n_tokens for i in (1003, 1004)}
    assert gain[1003] > 0.15 and gain[1003] > gain[1004] + 0.2


def test_model_vocabulary_grows(spark, monkeypatch):
    monkeypatch.setattr(lm, "MODEL_WORDS", 8)
    sizes = []
    monkeypatch.setattr(lm, "train", lambda texts, words, counts, hidden, rounds, tokens: sizes.append(len(words)))
    for n in (100, 900):
        lm.score_documents(spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60))) for i in range(n)], "doc_id long, text string"))
    assert sizes[0] > 8 and sizes[1] > 55


def test_recurrent_model_is_a_distribution_and_learns():
    model = GRU(np.array([5, 4, 9, 8, 7, 3, 2.0]), hidden=6)
    h = np.random.default_rng(0).normal(size=(3, 6)).astype(np.float32)
    total = sum(np.exp(model.log_probs(h, np.full(3, w))) for w in range(7))
    assert np.allclose(total, 1, atol=1e-5)
    losses = model.train(np.tile([2, 3, 4, END], 600), lanes=4, steps=8, epochs=4)
    assert losses[-1] < 0.3 * losses[0]
    ids = np.tile([2, 3, 4, END], 30)
    whole = model.score(ids, np.array([0, len(ids)]), window=7)
    assert whole[0] == pytest.approx(model.score(ids, np.array([0, len(ids)]), window=1000)[0], rel=1e-5)


def test_gradients():
    rng = np.random.default_rng(1)
    model = GRU(np.array([5, 4, 9, 8, 7, 3.0]), hidden=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids, goals, h = rng.integers(0, 6, (5, 3)), rng.integers(0, 6, (5, 3)), rng.normal(size=(3, 4))
    _, g, _ = model.loss_and_gradient(ids, goals, h)
    for k, p in model.p.items():
        at = tuple(rng.integers(0, d) for d in p.shape)
        kept, losses = p[at], []
        for e in (1e-4, -1e-4):
            p[at] = kept + e
            losses.append(model.loss_and_gradient(ids, goals, h)[0])
        p[at] = kept
        whole = np.zeros(p.shape)
        rows, values = g[k] if isinstance(g[k], tuple) else (slice(None), g[k])
        whole[rows] = values
        assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(whole[at], abs=2e-5)


def test_document_score_by_a_plain_forward_pass():
    """The score of whole documents is the sum of plain word-by-word logs, with the state restarted at each document."""
    rng = np.random.default_rng(2)
    model = GRU(np.array([5, 4, 9, 8, 7, 3, 2, 2, 1, 1.0]), hidden=5)
    model.p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in model.p.items()}
    docs = [np.append(rng.integers(2, 10, n), END) for n in (0, 1, 40, 7, 95)]
    p, n = {k: v.astype(np.float64) for k, v in model.p.items()}, 5
    plain = []
    for doc in docs:
        h, last, total = np.zeros(n), END, 0.0
        for w in doc:
            x, hu = p["x"][last], h @ p["u"]
            z, r = (1 / (1 + np.exp(-(x[i * n : i * n + n] + hu[i * n : i * n + n]))) for i in (0, 1))
            h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * (hu[2 * n :] + p["q"]))
            c, s = divmod(int(w), model.width)
            for logits, at in ((h @ p["wc"] + p["bc"], c), (h @ p["wo"][c] + p["bo"][c], s)):
                total += logits[at] - np.log(np.exp(logits).sum())
            last = w
        plain.append(total)
    got = model.score(np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs]))), lanes=3, window=8)
    assert got == pytest.approx(plain, rel=1e-4)


def test_rare_words_meet_their_counts_in_the_join(spark, monkeypatch):
    """With no word in the head, every word's count comes from the join; the base is as of the plain sum."""
    monkeypatch.setattr(lm, "HEAD_SHARE", 3)
    rows = [(i, f"alpha beta{i % 5} gamma{i}" + " alpha" * (i % 3)) for i in range(40)]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()}
    tokens = {i: [*brute.spaced(t), "</>"] for i, t in rows}
    count = Counter(w for i, t in tokens.items() if brute.crc(i) % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    for i, words in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.detect_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(odd, none):
    rows = {r.doc_id: r for r in langid.detect_languages(odd).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2, 8)) and rows[9].lang_pred in ("en", "fr")
    assert langid.detect_languages(none).count() == 0
    assert langid.identify(odd, None, keep=["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(5)
    plain, bad = [f"word{i}" for i in range(300)], ["zorgle", "zorglex", "blatwich", "idiot"]
    rows = []
    for i in range(1500):
        words = list(rng.choice(plain, size=30))
        toxic = i % 8 == 0
        if toxic:
            words[int(rng.integers(30))] = str(rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    assert all(got[i].held_out == (brute.crc(i) % 3 == 1) for i in got)
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) > 0.99
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 300)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(9000):
        words = [f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in rng.integers(0, 500, 20)]
        mark = "vexlor" if i % 300 == 7 else "grumbat" if i % 10 == 3 else None  # the rare one: 1 row in 300
        rows.append((i, " ".join([*words, mark] if mark else words), int(mark is not None), mark))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    assert sum(got[i].held_out for i, _, _, mark in rows if mark == "vexlor") > 3
    assert all(got[i].predicted == y for i, _, y, _ in rows)


def test_many_toxic_terms_are_all_learned(spark):
    """More telling patterns than voters: the further ones vote in pools, none is lost."""
    rng = np.random.default_rng(12)
    letters = [chr(97 + i) for i in range(26)]
    terms = sorted({"".join(rng.choice(letters, 9)) for _ in range(200)})
    plain = sorted({"".join(rng.choice(letters, 6)) for _ in range(400)})
    rows = []
    for i in range(24_000):  # each term on 30 toxic rows, some 20 of them to learn from
        words = list(rng.choice(plain, 15))
        if i % 4 == 0:
            words[int(rng.integers(15))] = terms[i // 4 % len(terms)]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p for p, y in held if y) > 0.95 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) < 0.01 * len(held)


def plain_patterns(text: str | None) -> set[bytes]:
    """Whole words, with a mark before them, and beginnings of words."""
    words = [w.encode() for w in re.findall(r"[a-z\x80-\U0010FFFF]+", brute.lower(text))]
    return {b"=" + w for w in words} | {w[:n] for w in words for n in toxicity.PREFIXES if len(w) >= n}


def test_mining_by_a_plain_version(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(3000):
        toxic = int(i % 9 == 0)
        words = [f"w{chr(97 + j % 26)}é{chr(97 + j // 26)}" for j in rng.integers(0, 300, 12)]
        words += ["fair"] * int(rng.random() < (0.02 if toxic else 0.3)) + ["grumbat"] * int(toxic and rng.random() < 0.6) + ["zorgle"] * int(rng.random() < (0.3 if toxic else 0.002))
        rows.append((" ".join(words), toxic))
    n_toxic = sum(y for _, y in rows)
    bad, good = Counter(), Counter()
    for text, y in rows:
        (bad if y else good).update(plain_patterns(text))
    tried = {p: t for p, t in bad.items() if t >= 3}
    least = max(3, math.ceil((math.log(len(tried)) + 4) / math.log(len(rows) / n_toxic)))
    marks = {p: t / (t + good[p]) for p, t in tried.items() if t >= least and t / (t + good[p]) >= toxicity.PRECISION}
    share = {p: good[p] / (len(rows) - n_toxic) for p, t in tried.items() if t >= least}
    clear = {p for p, c in share.items() if c >= toxicity.CLEAN_SHARE and c >= toxicity.CLEAN_RATIO * tried[p] / n_toxic}
    with toxicity.Scratch(spark) as held:
        got = toxicity.mine(spark.createDataFrame(rows, "text string, toxic int").repartition(5), held)

    def hashed(pattern: bytes) -> int:
        word = pattern.removeprefix(b"=")
        (scan,) = textkit.scan(pa.array([word.decode(errors="surrogateescape")], pa.string()), textkit.LETTERS)
        return int((scan.hashes() ^ toxicity._WHOLE)[0]) if pattern != word else int(scan.hash_range(scan.starts, scan.starts + len(word))[0])

    whole = {hashed(p): r for p, r in marks.items() if p == p.decode(errors="ignore").encode()}
    found = dict(zip(got.patterns.tolist(), got.precision.tolist()))
    assert marks and len(found) == len(marks) and all(found[h] == pytest.approx(r) for h, r in whole.items())
    assert set(got.telling.tolist()) <= {hashed(p) for p in clear} and len(got.telling) == min(len(clear), toxicity.MOST_CLEAN_VOTERS)


def test_cover_by_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_VOTERS", 3)
    rng = np.random.default_rng(7)
    lists = [(sorted({int(p) for p in rng.zipf(1.4, 3) if p < 40} | {int(rng.integers(40))}), int(rng.integers(1, 4))) for _ in range(300)]
    alone, pooled = toxicity._cover(spark.createDataFrame(lists, "places array<int>, n long").repartition(4), 40)
    left, want = lists, []
    support = Counter(p for places, n in lists for p in places for _ in range(n))
    for _ in range(3):
        count = Counter(p for places, n in left for p in places for _ in range(n))
        want.append(min(range(40), key=lambda p: (-count[p], -support[p], p)))
        left = [x for x in left if want[-1] not in x[0]]
    assert alone == want and not set(alone) & set(pooled) and len(set(pooled)) == len(pooled)
    left = [x for x in left if not set(pooled) & set(x[0])]
    count = Counter(p for places, n in left for p in places for _ in range(n))
    assert pooled and max(count.values(), default=0) < toxicity.COVERED


def test_label_model_by_a_plain_version():
    """The posterior of each row, voter by voter, and the forest that it stands on."""
    rng = np.random.default_rng(9)
    truth = rng.random(800) < 0.3
    votes = rng.random((800, 5)) < np.where(truth[:, None], [0.7, 0.5, 0.6, 0.4, 0.1], [0.05, 0.1, 0.02, 0.02, 0.4])
    votes[:, 1] |= votes[:, 0]
    label = np.where(rng.random(800) < 0.97, truth, ~truth).astype(int)
    model = toxicity.Model([np.array([v], np.uint64) for v in range(5)])
    model.learn(votes, label, np.ones(800))
    assert model.parent[1] == 0 or model.parent[0] == 1  # the tied pair
    got = model.posterior(votes, 0.3, label)
    for i in range(0, 800, 37):
        odds = math.log(0.3 / 0.7)
        for v in range(5):
            clean, toxic = (model.given[c][int(votes[i, model.parent[v]])][v] for c in (0, 1))
            odds += math.log(toxic / clean) if votes[i, v] else math.log((1 - toxic) / (1 - clean))
        clean, toxic = model.label_rates
        odds += math.log(toxic / clean) if label[i] else math.log((1 - toxic) / (1 - clean))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-odds)))
    assert np.mean((got > 0.5) == truth) > 0.97 and np.mean((model.scores(votes) > 0.5) == truth) > 0.9


def test_vote_vectors_are_sampled_without_bias(spark, monkeypatch):
    rows = [(i % 2, i.to_bytes(4, "big"), 1 + 400 * (i < 20)) for i in range(4000)]
    vectors = spark.createDataFrame(rows, "toxic int, votes binary, n long")
    got, times = toxicity._sampled(vectors)
    assert got.num_rows == 4000 and times.sum() == sum(n for *_, n in rows)
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 1000)
    got, times = toxicity._sampled(vectors)
    kept = {int.from_bytes(v, "big") for v in got.column("votes").to_pylist()}
    assert len(kept) == 1000 and kept >= set(range(20))  # frequent vectors stay, the others are a sample
    assert abs(times[got.column("n").to_numpy() == 1].sum() / 3980 - 1) < 0.05


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (4, None, None), (99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.detect(odd, labels).count() == odd.count() and toxicity.detect(none, labels).count() == 0
    assert toxicity.detect(odd, labels.where("quality > 9")).where("score is null").count() == 0


def brute_top(rows: list[tuple], k: int, every: int) -> set:
    vectors = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in vectors:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)}
    return out


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE_ROWS", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 6))
    rows = [(i, [float(x) for x in np.float32(centres[i % 8] + rng.normal(size=6) * 0.1)]) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(700, 900)]  # one very common vector
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in mtree.search(df, 5, 50).collect()}
    assert got == brute_top([(i, v) for i, v in rows if i != 904] + [(904, [0.0] * 6)], 5, 50)
    assert mtree.search(df.where("vec_id < 3"), 5, 50).count() == 2 and mtree.search(df.where("vec_id < 0"), 5, 50).count() == 0


def test_tree_bounds_save_computations():
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(-5, 5, (500, 4)) + c * 200 for c in range(8)]).astype(np.int64)
    most = int((v * v).sum(axis=1).max())
    tree = mtree.Searcher(mtree.Tree(mtree._lifted(v, most)).record(np.arange(len(v)), v), 4, most)
    ids, scores = tree.top(v[0], 0, 5, float("inf"))
    exact = sorted((-int(v[0] @ v[i]), i) for i in range(1, len(v)))[:5]
    assert sorted(zip((-scores).astype(int).tolist(), ids.tolist())) == exact and tree.computed < len(v)


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_section_tokens_match_brute_force(documents, odd, none, rule):
    with open(tokencount.DEFAULT_RANKS, "rb") as f:
        encoder, _ = tokencount._encoder(f.read())
    for df in (documents.where("doc_id < 40"), odd):
        texts = {i: t or "" for i, t in pairs(df)}
        sums, spans = Counter(), {}
        for r in tokencount.section_tokens(df, rule=rule).dropDuplicates(["doc_id", "section"]).collect():
            sums[r.doc_id] += r.n_tokens
            spans.setdefault(r.doc_id, []).append((r.char_start, r.char_end))
            assert r.doc_tokens == len(encoder.encode_ordinary(texts[r.doc_id]))
        for i, text in texts.items():
            assert sums[i] == len(encoder.encode_ordinary(text))
            assert "".join(text[a:b] for a, b in sorted(spans[i])) == text
    assert tokencount.section_tokens(none, rule=rule).count() == 0


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_tokens_of_each_section_match_brute_force(documents, odd, rule):
    """Every token's bytes are marked with their section one by one."""
    with open(tokencount.DEFAULT_RANKS, "rb") as f:
        encoder, _ = tokencount._encoder(f.read())
    for df in (documents.where("doc_id < 40"), odd.where("doc_id < 9 OR doc_id > 10")):
        expected = {}
        for i, text in pairs(df):
            owner = [n for n, line in enumerate((text or "").split("\n")) for _ in (line + "\n").encode()]
            counts, crossing, at = Counter(), Counter(), 0
            for token in encoder.encode_ordinary(text or ""):
                size = len(encoder.decode_single_token_bytes(token))
                own = Counter(owner[at : at + size])
                at += size
                home = {"first": min(own), "last": max(own), "most": min(own, key=lambda x: (-own[x], x))}[rule]
                counts[home] += 1
                crossing[home] += len(own) > 1
            expected |= {(i, n): (counts[n], crossing[n]) for n in counts}
        got = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in tokencount.section_tokens(df, rule=rule).collect()}
        assert {k: v for k, v in got.items() if v[0]} == expected


def test_boundary_rules():
    edges = np.array([0, 4, 6, 12])
    starts, ends = np.array([0, 3, 3, 6]), np.array([3, 5, 10, 12])
    assert {r: tokencount.allocate(starts, ends, edges, r)[0].tolist() for r in tokencount.RULES} == {"first": [0, 0, 0, 2], "last": [0, 1, 2, 2], "most": [0, 0, 2, 2]}
    assert tokencount.allocate(starts, ends, edges, "first")[1].tolist() == [False, True, True, False]


def test_mixing_reaches_its_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix(docs, labels).toPandas()
    assert len(rows) == docs.count() and (rows.rate >= 0).all()
    whole = rows.n_tokens.sum()
    for d, share in mixing.TARGETS.items():
        assert (rows.rate * rows.n_tokens * rows[f"p_{d}"]).sum() / whole == pytest.approx(share, abs=0.01)


def test_mixing_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, 1, 1), (8, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mix(odd, labels).count() == odd.count() and mixing.mix(none, labels).count() == 0
    assert mixing.mix(odd, labels.where("quality > 5")).where("rate is null").count() == 0


def test_mixing_keeps_columns_beside_clashing_names(odd):
    labels = odd.sparkSession.createDataFrame([(4, 1, 0), (5, 0, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    given = odd.withColumns({"p": F.lit("own"), "rate": F.lit("own"), "kept": F.lit(3), "key": F.lit("k")})
    out = mixing.mix(given, labels, keep=["doc_id", "p", "rate", "kept", "key", "n_words"])
    assert out.columns == ["doc_id", "p", "kept", "key", "n_words", "n_tokens", "p_clean", "p_low", "p_toxic", "rate", "copies"]
    assert out.where("p = 'own' AND kept = 3 AND key = 'k' AND rate >= 0D").count() == odd.count()


@pytest.mark.filterwarnings("error::UserWarning")
def test_rates_far_from_one_meet_their_targets(spark):
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([1, 1, 1], 500), rng.integers(0, 90, 500)
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(n, p)], "n_tokens long, p array<double>").repartition(3)
    targets = {"a": 0.85, "b": 0.1, "c": 0.05}
    rate, goal, shares = mixing.fit_rates(rows, targets)
    w = np.array([r.w for r in rows.select("n_tokens", "p", rate.alias("w")).orderBy("n_tokens", "p").collect()])
    given = [r for r in rows.orderBy("n_tokens", "p").collect()]
    reached = sum(x * r.n_tokens * np.array(r.p) for x, r in zip(w, given)) / n.sum()
    assert w.min() >= 0 and np.abs(reached - np.array(goal)).max() < mixing.TOLERANCE and np.allclose(reached, shares)


def test_targets_out_of_reach_are_told(spark):
    p = [[x, 0.99 - x, 0.01] for x in np.random.default_rng(4).random(300) * 0.99]  # hardly any of the third domain
    rows = spark.createDataFrame([(50, [float(x) for x in q]) for q in p], "n_tokens long, p array<double>").repartition(3)
    with pytest.warns(UserWarning, match="out of reach"):
        _, goal, shares = mixing.fit_rates(rows, {"a": 0.85, "b": 0.1, "c": 0.05})
    assert 0.039 < goal[2] - shares[2] < 0.041


def test_rates_by_a_plain_version(spark):
    """Rates by the same projected gradient over plain arrays, whatever the number of tasks."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet([1, 1, 1], 200)
    n = rng.integers(0, 90, 200)
    targets = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(n, p)], "n_tokens long, p array<double>").repartition(5)
    rate, goal, shares = mixing.fit_rates(rows, targets)
    got = {(r.n_tokens, tuple(r.p)): r.w for r in rows.select("n_tokens", "p", rate.alias("w")).collect()}
    w, whole = np.ones(200), n.sum()
    for _ in range(mixing.STEPS):
        off = (w * n) @ p / whole - np.array(goal)
        if np.abs(off).max() < mixing.TOLERANCE:
            break
        live = n * (w > 0)
        scaled = np.linalg.inv((p * live[:, None]).T @ p / whole + 1e-4 * np.eye(3)) @ off
        w = np.maximum(0, w - mixing.STEP * (p @ scaled + mixing.PULL * (w - 1)))
    assert all(got[int(t), tuple(float(x) for x in q)] == pytest.approx(x, abs=1e-6) for t, q, x in zip(n, p, w))
    assert shares == pytest.approx((w * n) @ p / whole, abs=1e-6) and max(abs(a - b) for a, b in zip(shares, goal)) < mixing.TOLERANCE


def test_language_scores_by_plain_kernels(monkeypatch):
    """Kernels from plain sets of n-grams, with the same landmarks and ridge, give the same probabilities (hashes so wide that none meet)."""
    monkeypatch.setattr(langid, "BITS", 20)
    texts = ["The house is old, and the river runs by.", "We read the news in the morning!", "Das Haus ist alt und der Fluss ist breit.", "Wir lesen am Morgen die Zeitung.", "La casa es vieja y el río es ancho.", "Leemos las noticias por la mañana."]
    langs = ["en", "en", "de", "de", "es", "es"]
    news = ["the old house by the river", "der alte Fluss", "la vieja casa", "Zeitung and news y noticias"]

    def grams(text):
        letters = "".join(c.lower() if c.isalpha() else " " for c in text)
        while "  " in letters:
            letters = letters.replace("  ", " ")
        return {letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)}

    def kernel(a, b):
        return np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in b] for x in a])

    seen = lambda t: np.concatenate([s for _, s, _ in langid.presence(pa.array(t))])
    model = langid.Model(np.packbits(seen(texts), axis=1), langs)
    names = sorted(set(langs))
    order = [i for k in names for i in range(6) if langs[i] == k]
    sets = [grams(t) for t in texts]
    marks = [sets[i] for i in order]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors / np.sqrt(values)
    given = np.column_stack([kernel(sets, marks) @ root, np.ones(6)])
    goal = np.array([[1.0 if x == k else -1.0 for k in names] for x in langs])
    solved = np.linalg.solve(given.T @ given + langid.RIDGE * np.eye(7), given.T @ goal)
    raw = (np.column_stack([kernel([grams(t) for t in news], marks) @ root, np.ones(4)]) @ solved) * langid.SHARPNESS / 2
    plain = np.exp(raw) / np.exp(raw).sum(axis=1, keepdims=True)
    assert model.langs == names and model.scores(seen(news)) == pytest.approx(plain, abs=0.01)


def test_top_k_beyond_exact_floats_and_with_clashing_columns(spark):
    """Products above 2**53 are exact; columns named like the operator's own do not disturb it."""
    rng = np.random.default_rng(9)
    v = [[float(x) / 256 for x in rng.integers(1_400_000_000, 1_400_000_040, 2)] for _ in range(60)]
    rows = [(i, x, 1, 2.0, "t", [1]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double, tree string, v array<int>")
    whole = [[math.floor(256 * x) for x in row] for row in v]
    expected = set()
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in enumerate(whole) if i != q)[:5]
        expected |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in mtree.search(df, 5, 50).collect()} == expected and -best[0][0] > 2**53
    with pytest.raises(ValueError):
        mtree.search(spark.createDataFrame([(0, [1e8])], "vec_id long, embedding array<double>"))


def test_all_columns_kept_beside_clashing_names(odd):
    """By default all columns stay; those named like a result are replaced, others named like inner columns are not disturbed."""
    more = odd.withColumns({"_text": F.lit(1), "Text_": F.lit("x"), "predicted": F.lit("p"), "key": F.lit(2)})
    named = langid.identify(more, langid.fit(more))
    assert named.columns == [c for c in more.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"] and named.count() == odd.count()
    scored = toxicity.score(more, toxicity.fit(more, more.selectExpr("doc_id", "1 AS toxic", "1 AS quality")))
    assert scored.columns == [c for c in more.columns if c not in ("score", "predicted")] + ["score", "predicted"] and scored.where("key = 2").count() == odd.count()
    mixed = mixing.mix(more, more.selectExpr("doc_id", "0 AS toxic", "1 AS quality"), keep=["doc_id", "key"])
    assert mixed.columns[:2] == ["doc_id", "key"] and mixed.where("key = 2").count() == odd.count()
