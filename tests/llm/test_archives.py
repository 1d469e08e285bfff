"""WARC round trips and histories, periodic runs, vector codes: against plain versions and on awkward input."""

import base64
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import pii, runs, vectorcodes, warc

PAGES = [
    (1, "http://a.b/x", "same"), (2, "http://a.b/x", "same"), (0, "http://www.A.b:80/x#f", None), (3, None, ""), (None, "u\r\nv", "same"), (1, "http://a.b/x", "same"),
    (5, "http://a.b/x", "WARC/1.1\r\nWARC-Type: response\r\n\r\nü 😀\r\n\r\n"), (5, "http://a.b/x", "WARC/1.1\r\nWARC-Type: response\r\n\r\nü 😀\r\n\r\n"),
    (7, "https://m.c.org/?q=1", "long " * 50_000), (8, "not a url", "\r\n\r\n"), (9, "", " "),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*r, "x", 7) for r in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload int").repartition(4).cache()


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def by_id(rows, key=lambda r: r[0]):
    return sorted(rows, key=lambda r: (key(r) is None, key(r) or 0, repr(r)))


@pytest.mark.parametrize("least", [0, 5])
def test_pages_come_back_whole(spark, pages, tmp_path, least):
    path = f"file://{tmp_path}/a"
    warc.write_archives(pages, path, least=least, records=3)
    records = warc.read_records(spark, path).cache()
    assert records.where("NOT intact").count() == 0 and records.count() == len(PAGES)
    back = by_id([(r.page_id, r.payload) for r in warc.restored(records).collect()])
    assert back == by_id([(p, h or "") for p, _, h in PAGES])
    rows = records.collect()
    assert all(r.digest == digest(t) and r.bytes == len((t or "").encode()) for r, t in zip(by_id(rows, lambda r: r.page_id), [h for _, _, h in by_id(PAGES)]))
    texts = {}
    for p, _, h in PAGES:
        texts.setdefault(h or "", []).append(p)
    for text, ids in texts.items():
        mine = [r for r in rows if r.digest == digest(text)]
        first = min((i for i in ids if i is not None), default=None)
        small = len(text.encode()) < least
        assert sorted(r.record_type for r in mine) == ["response"] * (len(ids) if small else 1) + ["revisit"] * (0 if small else len(ids) - 1)
        assert small or [r.page_id for r in mine if r.record_type == "response"] == [first]
        assert {r.refers_to_page for r in mine if r.record_type == "revisit"} <= {first}


@pytest.mark.parametrize("entries", [1, 3, 100])
def test_history_is_in_order_over_all_ranges(spark, pages, tmp_path, entries):
    path = f"file://{tmp_path}/a"
    warc.write_archives(pages, path, records=2)
    rows = sorted(warc.history(warc.read_records(spark, path), entries).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(PAGES)))
    keys = [(r.url_key, r["at"], r.page_id is None, r.page_id or 0) for r in rows]
    assert keys == sorted(keys)
    seen = {}
    for r in rows:
        assert r.capture == seen.get(r.url_key, 0)
        seen[r.url_key] = r.capture + 1


def test_one_url_with_most_captures_spans_ranges(spark, tmp_path):
    rows = spark.range(3_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 > 0, "http://hot.example/").otherwise(F.concat(F.lit("http://x.example/"), "id")).alias("url"), F.concat(F.lit("p"), F.col("id") % 50).alias("html"))
    out = warc.archive_history(rows).cache()
    assert out.where("record_type = 'response'").count() == 50
    path = f"file://{tmp_path}/a"
    warc.write_archives(rows, path)
    merged = warc.history(warc.read_records(spark, path), 200)
    assert sorted(map(tuple, merged.select("page_id", "slot", "capture").collect())) == sorted(map(tuple, out.select("page_id", "slot", "capture").collect()))
    assert out.where("url_key = 'example,hot)/'").agg(F.max("capture")).first()[0] == 1999


def test_loser_tree_merges_like_a_sort():
    rnd = random.Random(3)
    for k in range(9):
        lists = [sorted((rnd.randrange(20), i, j) for j in range(rnd.choice([0, 1, 5, 30]))) for i in range(k)]
        assert list(warc.LoserTree(lists)) == sorted(x for one in lists for x in one)


def test_a_changed_payload_is_not_intact(spark, pages, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_archives(pages.where("page_id IN (2, 7)"), path, compression="none")
    for file in (tmp_path / "a" / "archives").glob("part-*"):
        file.write_bytes(file.read_bytes().replace(b"same\r\n", b"sane\r\n"))
    for crc in (tmp_path / "a" / "archives").glob(".*.crc"):
        crc.unlink()
    assert {r.page_id: r.intact for r in warc.read_records(spark, path).collect()} == {2: False, 7: True}


def test_no_pages(spark, pages):
    assert warc.archive_history(pages.where("false")).count() == 0


def plain_runs(w, least=6, times=4):
    n, out = len(w), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(least, times * p):
                out.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def test_runs_like_a_plain_search():
    rnd = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            k, n = rnd.choice([1, 2, 3, 5, 50]), rnd.choice([0, 1, 3, 7, 20, 60, 150])
            w = [rnd.randrange(k) for _ in range(n)]
            block = [rnd.randrange(k) for _ in range(rnd.randint(1, 5))]
            at = rnd.randint(0, n)
            w[at:at] = (block * 20)[: rnd.choice([0, rnd.randint(0, 40)])]
            texts.append(np.array(w, dtype=np.int64))
        for times, least in ((4, 6), (2, 2), (3, 5)):
            assert [list(map(tuple, f.tolist())) for f in runs.block_runs(texts, least, times)] == [plain_runs(t.tolist(), least, times) for t in texts]


def test_extensions_like_comparing_word_by_word():
    rng = np.random.default_rng(5)
    s = np.append(np.concatenate([rng.integers(0, 3, 300), np.tile(rng.integers(0, 4, 7), 40), np.zeros(90, int)]), 9)
    a = rng.integers(0, len(s) - 1, 3000)
    b = rng.integers(0, len(s), 3000)
    a, b = a[a != b], b[a != b]
    plain = [next(i for i in range(len(s)) if s[x + i] != s[y + i]) for x, y in zip(a, b)]
    assert runs.extensions(runs.recompress(s), a, b).tolist() == plain


def expected_digests(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found, keep = plain_runs(w), [True] * n
    for s, size, q in found:
        keep[s + q : s + size] = [False] * (size - q)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(x for x, k in zip(w, keep) if k)))


def test_run_digests_of_documents_and_odd_rows(documents, odd, none):
    small = documents.where("length(text) < 12000").unionByName(odd.where("coalesce(length(text), 0) < 12000").select(documents.columns))
    assert small.where("crc32(cast(doc_id AS string)) % 10 = 0").count() > 5
    want = sorted((expected_digests(r.doc_id, r.text) for r in small.collect()), key=repr)
    assert sorted(map(tuple, runs.run_digests(small).collect()), key=repr) == want
    found = {r.n_words: r.best for r in runs.find_runs(odd).collect()}
    assert tuple(found[20_000]) == (0, 20_000, 1)
    assert runs.run_digests(none).count() == 0


def test_one_long_text_is_one_block(spark):
    words = [str(i * i % 1013) for i in range(300_000)]
    got = runs.find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert got.n_words == 300_000 and (got.best.start, got.best.length, got.best.period) == (0, 300_000, 1013)
    assert got.collapsed == " ".join(words[:1013])


def plain_codes(ids, vectors, parts, entries, rounds):
    order, v = np.argsort(ids, kind="stable"), vectors.astype(object)
    spans = vectorcodes.cuts(v.shape[1], parts)
    books = [v[order][:entries, lo:hi].copy() for lo, hi in spans]

    def nearest(x, book):
        d = ((x[:, None, :] - book[None]) ** 2).sum(-1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p, (lo, hi) in enumerate(spans):
            where = nearest(v[:, lo:hi], books[p])[0]
            for e in set(where):
                mine = v[where == e][:, lo:hi]
                books[p][e] = [int(x) // len(mine) for x in mine.sum(0)]
    found = [nearest(v[:, lo:hi], books[p]) for p, (lo, hi) in enumerate(spans)]
    shown = hashlib.sha256(",".join(str(int(c)) for b in books for r in b for c in r).encode()).hexdigest()
    return sorted((int(i), "".join("%02x" % f[0][n] for f in found), int(sum(f[1][n] for f in found)), shown) for n, i in enumerate(ids))


@pytest.mark.parametrize("kind", ["clustered", "copies", "large"])
def test_codes_like_plain_rounds(spark, kind):
    rng = np.random.default_rng(2)
    n = 700
    v = rng.normal(0, 0.05, (n, 10)) + rng.normal(0, 3, (12, 10))[rng.integers(0, 12, n)]
    if kind == "copies":
        v[rng.random(n) < 0.5] = v[3]
    if kind == "large":
        v = v * 1e6
    rows = spark.createDataFrame([(i, x.tolist(), i % 3 or None) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(5)
    got = vectorcodes.vector_codes(rows, parts=4, entries=30, rounds=3).collect()
    whole = np.array([[int(np.floor(1024 * c)) for c in x] for x in v], dtype=np.int64)
    assert sorted((r.vec_id, r.code, r.error, r.codebooks_sha256) for r in got) == plain_codes(np.arange(n), whole, 4, 30, 3)
    sums = {}
    for r in got:
        sums[r.vec_id % 3] = sums.get(r.vec_id % 3, 0) + r.error
    assert all(r.label_error == sums[r.vec_id % 3] for r in got)


def test_subtrees_go_whole_where_vectors_are_clustered():
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 1000, (8, 16))
    x = np.floor(centers[rng.integers(0, 8, 1024)] + rng.normal(0, 5, (1024, 16)))
    tree = vectorcodes.cover_tree(x)
    x = x[tree["order"]]
    nodes, entries, whole = vectorcodes.descend(x, tree, np.floor(centers))
    assert len(nodes) < 100 and (tree["size"][nodes[whole]].sum() + np.count_nonzero(~whole)) == 1024
    for k in range(1, 1024):
        up = tree["parent"][k]
        assert up < k < up + tree["size"][up] and np.linalg.norm(x[k] - x[up]) <= tree["radius"][up] * (1 + 1e-12)


def test_odd_vectors(spark):
    rows = [
        (1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1), (2, [0.1, -0.1], None), (None, [1.0, 1.0], None), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (7, [1.0, 2.0, 3.0], 2), (8, [], 2),
        (9, [1e300, 0.0], 2),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = vectorcodes.vector_codes(df, rounds=1).collect()
    assert sorted((r.vec_id or -1, r.error, r.label_error) for r in got) == [(-1, 0, 0), (1, 0, 0), (2, 0, 0), (2, 0, 0)]
    assert {r.code for r in got if r.vec_id == 1} == {"00000000"} and len({r.codebooks_sha256 for r in got}) == 1
    assert vectorcodes.vector_codes(df.where("false")).count() == 0


def test_personal_data_in_a_text_of_very_many_finds(spark):
    unit = "call +1 (212) 555-0123 or 212-555-0199 now, "
    rows = spark.createDataFrame([(1, unit * 8_000), (2, unit), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(rows).collect()}
    assert (got[1].n_phone, got[2].n_phone, got[3].spans) == (8_000, 1, "")
    first, last = got[2].spans.split(","), got[1].spans.split(",")[-1].split(":")
    assert got[1].spans.split(",")[: len(first)] == first and int(last[1]) >= 7_999 * len(unit)


def test_loose_spans_beside_taken_ones(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(200):
        spans = [sorted(((s := rnd.randrange(400)), s + rnd.randrange(1, 12), "v", "b", "n") for _ in range(rnd.choice([0, 3, 90]))) for _ in range(2)]
        rows.append((i, *spans))
    df = spark.createDataFrame(rows, f"id long, loose array<{pii._SPAN}>, taken array<{pii._SPAN}>")
    got = {r.id: sorted(map(tuple, r.out)) for r in df.select("id", F.expr(pii._apart("loose", "taken")).alias("out")).collect()}
    assert got == {i: sorted(x for x in loose if not any(t[0] < x[1] and x[0] < t[1] for t in taken)) for i, loose, taken in rows}
