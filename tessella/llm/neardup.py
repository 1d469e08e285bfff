"""MinHash near-duplicate groups by tensored banding, with every link confirmed on full shingle sets.

Two collections of HALVES half-keys each (a half-key is ROWS minhashes) are computed per text. A table key is a
pair (half-key i of the first collection, half-key j of the second), so HALVES**2 tables come from
2 * HALVES * ROWS minhashes instead of HALVES**2 * 2 * ROWS. At similarity s a pair meets in some table with
probability (1 - (1 - s**ROWS)**HALVES)**2; with 16 and 3 it misses at s = 0.8 with probability 2e-5.

Texts with equal shingle sets are one class. Half-keys that only one class has are dropped first (the pair
they would form cannot meet), which leaves few table rows. In a table, classes are compared with one hub (a star, not
all pairs). Classes whose minhashes agree with a hub's in AGREE of the places are its family; families that their best
hub's confirmed links do not cover are finished in blocks, the uncovered members with all, by matrix products of their
sets; classes of different families that share a table are compared as pairs. So no link that
could join two components is lost, but for agreement below AGREE, 5 standard deviations below 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textkit
from tessella.llm.common import Scratch, materialize

SHINGLE = 4
HALVES = 16
ROWS = 3
AGREE = 0.61
PLANES = 4
PERCENT = 80
SETS_A_GROUP = 512  # sets that meet a hub's in one task
BLOCK = 256
HOT = 1024  # a key with over 1/HOT of all rows, and more than HOT_ROWS, is joined without a shuffle
HOT_ROWS = 256
COLUMNS = 8192
SPARSE = 1024  # comparisons over one rare shingle that are made as pairs, so at most 32 for one of its rows
EDGES_A_TASK = 1 << 17  # edges that a task contracts together; more of them go through star rounds
RARITY_BITS = 20  # buckets of the shingle counts that order the sets: 8 MB, whatever the corpus

_N = 2 * HALVES * ROWS
_MULT = textkit.mix(np.arange(1, _N + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_ADD = textkit.mix(np.arange(1001, 1001 + _N, dtype=np.uint64))
_SPREAD = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _shingle_sets(words: textkit.Words, k: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row, sorted; a row with fewer than k words has its whole sequence as one."""
    h = words.hashes()
    n = len(h)
    whole = max(0, n - k + 1)
    joined = np.zeros(whole, dtype=np.uint64)
    for j in range(k):
        joined += h[j : whole + j] * (_SPREAD[j % 4] + np.uint64(2 * j))
    joined = textkit.mix(joined)
    bounds = words.bounds
    for r in range(len(words.per_row)):
        s, e = bounds[r], bounds[r + 1]
        if e - s >= k:
            yield np.unique(joined[s : e - k + 1])
        elif e > s:
            weights = np.array([_SPREAD[j % 4] + np.uint64(2 * j + 1) for j in range(e - s)], dtype=np.uint64)
            yield textkit.mix(np.add.reduce(h[s:e] * weights, keepdims=True) ^ np.uint64(e - s))
        else:
            yield np.zeros(0, dtype=np.uint64)


_PAIRS = pa.schema([("x", pa.int64()), ("y", pa.int64())])
_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("class_id", pa.int64()), ("halves", pa.list_(pa.int64())), ("planes", pa.list_(pa.int64()))])


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digests of all sets, 0 for empty ones; rows of the others; all their hashes, one set after another; where each begins)."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(sizes)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1][full]
    out = np.zeros(len(sets), np.uint64)
    if len(full):
        out[full] = textkit.mix(np.add.reduceat(textkit.mix(flat), at) + sizes[full].astype(np.uint64))
    return out, full, flat, at


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in textkit.scan(batch.column(2), textkit.SPACED):
            sets = list(_shingle_sets(words, k))
            cls, full, flat, at = _digests(sets)
            mins = np.zeros((_N, len(full)), dtype=np.uint64)
            if len(full):
                for f in range(_N):
                    mins[f] = np.minimum.reduceat(flat * _MULT[f] + _ADD[f], at)
            mixed = textkit.mix(mins)
            halves = np.zeros((2 * HALVES, len(full)), dtype=np.uint64)
            for band in range(2 * HALVES):
                x = np.full(len(full), band + 1, dtype=np.uint64)
                for r in range(ROWS):
                    x = textkit.mix(x * np.uint64(31) + mixed[band * ROWS + r])
                halves[band] = x
            keys, bits = halves.T.astype(np.int64), _planes(mixed).T.astype(np.int64)
            marks: list = [None] * len(sets)
            lists: list = [None] * len(sets)
            for i, r in enumerate(full):
                marks[r], lists[r] = bits[i], keys[i]
            own = [batch.column(i).slice(words.first, len(sets)) for i in (0, 1)]
            rest = [pa.array([len(s) for s in sets], pa.int64()), pa.array(cls.astype(np.int64)), pa.array(lists, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*own, *rest], schema=_SKETCH)


def sketch(base: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per row of (doc_id, text_hash, text): n_shingles, class_id (equal for equal shingle sets), half-keys and minhash bits."""
    return base.mapInArrow(lambda it: _sketches(it, k), "doc_id long, text_hash long, n_shingles long, class_id long, halves array<long>, planes array<long>")


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The sets of rows (class_id, text) whose text is of that class, once a task."""
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for words in textkit.scan(batch.column(1), textkit.SPACED):
            sets = list(_shingle_sets(words, k))
            own, keep = ids[words.first : words.first + len(sets)], []
            for i in np.flatnonzero(_digests(sets)[0].astype(np.int64) == own):
                if own[i] not in seen:
                    seen.add(own[i])
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(own[keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["class_id", "hashes"])


def lookup(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left joined with right: one row a key, c at least the key's rows in left, total at most the sum of c.

    A key with over 1/HOT of the total, and more rows than a task is ever to hold anyway, is sent to all tasks, so its
    rows need not meet; there can be HOT such keys at most. The other keys are joined by a shuffle.
    """
    is_hot = F.col("c") > max(HOT_ROWS, total // HOT)
    hot = right.where(is_hot).toArrow()
    if not hot.num_rows:
        return left.join(right.drop("c"), key)
    held = F.broadcast(left.sparkSession.createDataFrame(hot, right.schema))
    rest = left.join(held.select(key), key, "left_anti").join(right.where(~is_hot).drop("c"), key)
    return left.join(held.drop("c"), key).unionByName(rest)


def _tables(classes: DataFrame) -> DataFrame:
    """(key, class_id, n_shingles, planes) of the tensored tables, without keys that can hold one class only."""
    each = classes.select("class_id", F.posexplode("halves").alias("band", "half"))
    shared = each.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    left = each.join(shared, "half").groupBy("class_id").agg(
        F.collect_list(F.when(F.col("band") < HALVES, F.col("half"))).alias("first"), F.collect_list(F.when(F.col("band") >= HALVES, F.col("half"))).alias("second")
    )
    keys = left.select("class_id", F.explode("first").alias("a"), "second").select("class_id", "a", F.explode("second").alias("b"))
    return keys.select(F.xxhash64("a", "b").alias("key"), "class_id").join(classes.select("class_id", "n_shingles", "planes"), "class_id")


def _planes(minhashes: np.ndarray) -> np.ndarray:
    """PLANES low bits of every minhash, packed so that two texts are compared with xor and bit_count."""
    words = -(-_N // 64)
    out = np.zeros((PLANES * words, minhashes.shape[1]), dtype=np.uint64)
    for f in range(_N):
        for b in range(PLANES):
            out[b * words + f // 64] |= ((minhashes[f] >> np.uint64(b)) & np.uint64(1)) << np.uint64(f % 64)
    return out


def _agree(a: str, b: str):
    """Whether minhashes agree in AGREE of the places, as far as PLANES bits tell."""
    words = -(-_N // 64)
    unlike = " + ".join("bit_count(" + " | ".join(f"({a}[{p * words + w}] ^ {b}[{p * words + w}])" for p in range(PLANES)) + ")" for w in range(words))
    return F.expr(f"{unlike} <= {int((1 - AGREE) * _N)}")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y), with cx pairs of x or more, whose full sets have 100 * |intersection| >= PERCENT * |union|.

    Each y carries its set to x; an x of many pairs is split over groups of about SETS_A_GROUP.
    """

    def check(group: pa.Table) -> pa.Table:
        is_hub = pc.is_null(group.column("y"))
        hub, rest = group.filter(is_hub), group.filter(pc.invert(is_hub))
        a = np.frombuffer(hub.column("hashes")[0].as_buffer(), dtype=np.uint64)
        keep = []
        for blob in rest.column("hashes"):
            b = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
            at = np.searchsorted(a, b)
            common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
            keep.append(100 * common >= PERCENT * (len(a) + len(b) - common))
        return rest.select(["x", "y"]).filter(pa.array(keep, pa.bool_())).cast(_PAIRS)

    salted = pairs.select("x", "y", F.expr(f"pmod(xxhash64(y), cast(ceil(cx / {SETS_A_GROUP}) AS int))").cast("int").alias("salt"))
    hubs = salted.select("x", "salt").distinct().join(sets.select(F.col("class_id").alias("x"), "hashes"), "x").select("x", "salt", F.lit(None).cast("long").alias("y"), "hashes")
    rest = salted.join(sets.select(F.col("class_id").alias("y"), "hashes"), "y").select("x", "salt", "y", "hashes")
    return hubs.union(rest).groupBy("x", "salt").applyInArrow(check, "x long, y long")


def components(edges: DataFrame, held: Scratch, a: str = "x", b: str = "y", most_rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node reachable over the edges, a kept table, which is read twice.

    Edges are contracted in as many tasks as they fill, with about EDGES_A_TASK each; components that lie in several
    tasks are joined by alternating large and small stars, until each is a star or the edges left fill one task.
    """
    now, count = edges.select(F.col(a).alias("u"), F.col(b).alias("v")), edges.count()
    if count > EDGES_A_TASK:
        now = held.keep(_contracted(now, -(-count // EDGES_A_TASK)).distinct(), "edges")
    for _ in range(most_rounds):
        if count > EDGES_A_TASK:
            count, unsettled = _unsettled(now)
            if not unsettled:
                return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if count <= EDGES_A_TASK:
            return held.keep(_contracted(now, 1), "edges").select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.select("u", "v").union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("c"))
        large = lookup(both.where("v > u"), least, "u", 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = held.keep(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        small = lookup(large, least, "u", 2 * count).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = held.keep(small.where("u <> v").distinct(), "edges")
    raise RuntimeError("components did not settle")


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (u, v), u > v, that join the same nodes: each of the tasks puts stars in the place of its own edges."""
    return edges.coalesce(tasks).mapInArrow(_stars, "u long, v long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in (0, 1)])
        size += batch.num_rows
        if size >= 8 * EDGES_A_TASK:  # of files of unequal size
            yield _star(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield _star(*map(np.concatenate, zip(*held)))


def _star(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Each node but the smallest of its component with that one."""
    nodes, place = np.unique(np.concatenate((x, y)), return_inverse=True)
    top, (a, b) = np.arange(len(nodes)), place.reshape(2, -1)
    while len(a):
        a, b = top[a], top[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]
    own = np.flatnonzero(top != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own], pa.int64()), pa.array(nodes[top[own]], pa.int64())], names=["u", "v"])


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """(edges (u, v) with u > v; their nodes with two smaller neighbours, or with smaller and larger ones): without such nodes each component is a star."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    found = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 OR (up > 0 AND down > 0)"))).first()
    return found[0], found[1]


def _hub_pairs(tables: DataFrame) -> DataFrame:
    """In each table, every class with the table's hub, where sizes and minhashes let a link be likely."""
    order = F.xxhash64("class_id", F.lit(0))
    hub = tables.groupBy("key").agg(F.min_by(F.struct("class_id", "n_shingles", "planes"), order).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1")
    met = (F.col("h.class_id") != F.col("class_id")) & _sizes_allow(F.col("h.n_shingles"), F.col("n_shingles")) & _agree("h.planes", "planes")
    return lookup(tables, hub, "key", tables.count()).where(met).select(F.least("h.class_id", "class_id").alias("x"), F.greatest("h.class_id", "class_id").alias("y")).distinct()


def _sizes_allow(a, b):
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _link(pairs: DataFrame, texts, k: int, held: Scratch) -> tuple[DataFrame, DataFrame]:
    """(confirmed links, the pairs) among promising pairs; shingle sets are made again only for their classes."""
    promising = held.keep(pairs, "promising")
    total = 2 * promising.count()
    if not total:
        return promising, promising
    # the more common end of a pair becomes the hub that others come to
    weight = held.keep(promising.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("c")), "weights")
    sets = held.keep(_sets_of(texts(weight.select(F.col("node").alias("class_id"))), k), "sets")
    turned = promising
    for end in ("x", "y"):
        turned = lookup(turned, weight.select(F.col("node").alias(end), "c", F.col("c").alias(f"c{end}")), end, total)
    swap = F.col("cx") < F.col("cy")
    turned = turned.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"), F.greatest("cx", "cy").alias("cx"))
    return held.keep(_confirmed(turned, sets), "links"), promising


def _sets_of(texts: DataFrame, k: int) -> DataFrame:
    """(class_id, hashes); a class whose text stands on several equal rows may come once a task, which links nothing else."""
    return texts.mapInArrow(lambda it: _sets(it, k), "class_id long, hashes binary")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of a task's sets in each bucket of their hashes."""
    n = np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        for blob in batch.column(0):
            np.add.at(n, _bucket(np.frombuffer(blob.as_buffer(), dtype=np.uint64)), 1)
    some = np.flatnonzero(n)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _rarest(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(class_id, shingle) of each set's rarest shingles, one of which any linked set shares."""
    for batch in batches:
        parts = []
        for blob in batch.column(1):
            h = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
            least = len(h) - -(-PERCENT * len(h) // 100) + 1
            parts.append(h[np.lexsort((h, counts[_bucket(h)]))[:least]])
        ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in parts])
        shingles = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shingles.view(np.int64))], names=["class_id", "shingle"])


def _rare_shingles(members: DataFrame, sets: DataFrame, held: Scratch) -> tuple[DataFrame, DataFrame]:
    """(shingle, class_id, root) of the members' rarest shingles that different roots share, and (shingle, largest, c, alone) of each.

    largest is the root of most of a shingle's c classes, alone the number of the others.
    """
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    got = sets.select("hashes").mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    rare = sets.select("class_id", "hashes").mapInArrow(lambda it: _rarest(it, sent.value), "class_id long, shingle long").distinct()
    edges = held.keep(rare.join(members, "class_id"), "rare")
    each = edges.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle")
    sizes = each.agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("c"), (F.sum("n") - F.max("n")).alias("alone")).where("alone > 0")
    return edges, held.keep(sizes, "shared")


def _sparse_pairs(edges: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """Pairs (x, y) of different roots that share a rare shingle of few classes; each shingle's list of others is bounded by SPARSE."""
    others = edges.join(sizes.where(f"alone * c <= {SPARSE}"), "shingle").where("root <> largest")
    few = others.groupBy("shingle").agg(F.collect_list(F.struct("class_id", "root")).alias("few"), F.first("c").alias("c"))
    both = lookup(edges, few, "shingle", total).select("class_id", "root", F.explode("few").alias("f")).where("root <> f.root")
    return both.select(F.least("class_id", "f.class_id").alias("x"), F.greatest("class_id", "f.class_id").alias("y")).distinct()


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sizes and minhashes let a link be likely."""
    for end in ("x", "y"):
        pairs = pairs.join(classes.select(F.col("class_id").alias(end), F.col("n_shingles").alias(f"n{end}"), F.col("planes").alias(f"p{end}")), end)
    return pairs.where(_sizes_allow(F.col("nx"), F.col("ny")) & _agree("px", "py")).select("x", "y")


def _dense_members(edges: DataFrame, sizes: DataFrame, held: Scratch) -> DataFrame:
    """(family, class_id, root, single, n, alone) of classes joined by rare shingles of many classes; single: outside the largest root."""
    total = edges.count()
    dense = held.keep(lookup(edges, sizes.where(f"alone * c > {SPARSE}").select("shingle", "c"), "shingle", total), "dense")
    families = _with_roots(components(dense.select(F.col("shingle").alias("x"), F.col("class_id").alias("y")), held), "class_id", "family")
    members = held.keep(dense.select("class_id", "root").distinct().join(families, "class_id"), "members")
    parts = members.groupBy("family", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("family")
    whole = parts.agg(F.max_by("root", F.struct("m", "root")).alias("largest"), F.sum("m").alias("n"), F.sum("m").alias("c"), (F.sum("m") - F.max("m")).alias("alone"))
    return lookup(members, whole.where("alone > 0"), "family", members.count()).withColumn("single", F.col("root") != F.col("largest"))


def _with_roots(found: DataFrame, node: str, root: str) -> DataFrame:
    """components with a row for each root too."""
    return found.select(F.col("node").alias(node), F.col("root").alias(root)).union(found.select("root", "root").distinct())


def _family_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components of one family: members (family, class_id, root, single, n, alone), sets (class_id, hashes).

    Members of the family's largest component need no comparison among themselves, so only the `alone` others are
    compared, with all members. Both are dealt to blocks of about BLOCK; a block of either kind meets in one task, where
    intersections of all the sets come from matrix products over the shingles that occur twice, and only links that
    join two components leave the task.
    """
    count = lambda c: F.expr(f"cast(ceil({c} / {BLOCK}) AS int)")
    blocks = members.withColumns({"rows": count("n"), "few": count("alone")})
    at = lambda c, salt: F.expr(f"pmod(xxhash64(class_id, {salt}), {c})")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    whole = blocks.select("family", "class_id", "root", F.lit(False).alias("single"), every("few").alias("i"), at("rows", 1).alias("j"))
    single = blocks.where("single").select("family", "class_id", "root", F.lit(True).alias("single"), at("few", 2).alias("i"), every("rows").alias("j"))
    return whole.unionByName(single).join(sets, "class_id").groupBy("family", "i", "j").applyInArrow(_compare_block, "x long, y long")


def _compare_block(group: pa.Table) -> pa.Table:
    ids, roots = group.column("class_id").to_numpy(), group.column("root").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group.column("hashes")]
    n, size = len(ids), np.array([len(s) for s in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, twice = np.repeat(np.arange(n), size), times > 1
    number = np.cumsum(twice) - 1
    kept = twice[place]
    row, column = row[kept], number[place[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), dtype=np.float32)
    for first in range(0, int(twice.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + COLUMNS))
        m = np.zeros((n, COLUMNS), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - first] = 1
        common += m @ m.T
    single = group.column("single").to_numpy()
    linked = (100 * common >= PERCENT * (size[:, None] + size[None, :] - common)) & (roots[:, None] != roots[None, :]) & (single[:, None] > single[None, :])
    joined: dict[int, int] = {}

    def top(r: int) -> int:
        while joined.get(r, r) != r:
            r = joined[r]
        return r

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = top(int(roots[i])), top(int(roots[j]))
        if a != b:
            joined[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return pa.table({"x": pa.array([a for a, _ in out], pa.int64()), "y": pa.array([b for _, b in out], pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """Near-duplicate component of every row: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text), root.

    Words are split at ASCII white space after lower-casing A-Z; a row's set holds its distinct k-word shingles.
    Rows link where the similarity of their sets is at least 0.8; component_id is the smallest id reachable, root names
    the component itself.

    Defined cases: null or wordless text has n_shingles 0, root null, and is linked with nothing; fewer than k words form
    one shingle; rows with equal sets are linked; repeated rows each give a row (an id seen with one text twice has kept
    on both); an id with two texts is two rows that are linked or not by their own texts; a null id never names a component
    unless all its ids are null, and only then is kept (null); an empty table gives no rows; other columns are ignored.
    Classes are told apart by 64-bit digests, texts by 64-bit hashes beside their ids.
    """
    with Scratch(docs.sparkSession) as held:
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
        return materialize(_grouped(base, k, held), "groups")


def _grouped(base: DataFrame, k: int, held: Scratch) -> DataFrame:
    rows = held.keep(sketch(base, k), "sketch")
    full = rows.where("n_shingles > 0")
    owner = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = held.keep(
        full.groupBy("class_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves"), F.first("planes").alias("planes"), F.min(owner).alias("owner")), "classes"
    )
    tables = held.keep(_tables(classes), "tables")

    def texts(wanted: DataFrame) -> DataFrame:
        """(class_id, text) of the wanted classes, from the row with the smallest id of each."""
        one = classes.join(wanted, "class_id").select("class_id", F.col("owner.doc_id").alias("_id"), F.col("owner.text_hash").alias("_hash"))
        return base.join(one, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("class_id", "text")

    stars, near = _link(_hub_pairs(tables), texts, k, held)
    first = held.keep(components(stars, held), "parts")
    placed = held.keep(_placed(_with_roots(components(near, held), "class_id", "family"), first), "families")
    split = held.keep(_split_families(placed), "split")
    strangers = _strangers(tables, placed, split, held).select("class_id", F.col("class_id").alias("family"))
    unsure = held.keep(split.union(_placed(strangers, first).select("class_id", "root")), "unsure")
    links = [first.select(F.col("node").alias("x"), F.col("root").alias("y"))]
    if not unsure.isEmpty():
        sets = held.keep(_sets_of(texts(unsure.select("class_id")), k), "sets")
        edges, sizes = _rare_shingles(unsure, sets, held)
        late = _promising(_sparse_pairs(edges, sizes, edges.count()), classes)
        if not sizes.where(f"alone * c > {SPARSE}").isEmpty():
            members = held.keep(_dense_members(edges, sizes, held), "members")
            links.append(held.keep(_family_links(members, sets), "links"))
        links.append(_link(late, texts, k, held)[0])
    roots = components(reduce(DataFrame.union, links), held)
    classed = held.keep(classes.join(roots, F.col("class_id") == F.col("node"), "left").select("class_id", F.coalesce("root", "class_id").alias("root"), F.col("owner.doc_id").alias("least_id")), "roots")
    smallest = classed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("c"))
    named = lookup(classed, smallest, "root", classed.count()).select("class_id", "component_id", "root")
    out = rows.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class_id")).alias("class_id"))
    out = _by_class(out, named)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "root")


def _by_class(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows with what is named of their classes; wordless rows have no class."""
    sizes = rows.where("class_id IS NOT NULL").groupBy("class_id").agg(F.count(F.lit(1)).alias("c"))
    found = lookup(rows.where("class_id IS NOT NULL"), named.join(sizes, "class_id"), "class_id", rows.count())
    return found.unionByName(rows.where("class_id IS NULL"), allowMissingColumns=True)


def _placed(families: DataFrame, parts: DataFrame) -> DataFrame:
    """families (class_id, family) with root, the component of confirmed links that each class is in."""
    return families.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left").select("class_id", "family", F.coalesce("root", "class_id").alias("root"))


def _split_families(placed: DataFrame) -> DataFrame:
    """(class_id, root) of the families that the confirmed links leave in several parts."""
    parts = placed.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("parts"))
    return lookup(placed, parts.where("parts > 1").select("family", "c"), "family", placed.count()).select("class_id", "root")


def _strangers(tables: DataFrame, placed: DataFrame, split: DataFrame, held: Scratch) -> DataFrame:
    """class_id of the classes of whole families, or of none, that share a table with another family.

    Classes of split families are compared over their rarest shingles in any case, so their rows only mark tables here
    and are joined with none: a large family's rows are not met again for each stranger in its tables.
    """
    families = placed.join(split.select("class_id", F.lit(True).alias("split")), "class_id", "left").select("class_id", "family", F.coalesce("split", F.lit(False)).alias("split"))
    rows = tables.select("key", "class_id").join(families, "class_id", "left").select("key", "class_id", F.coalesce("family", "class_id").alias("family"), F.coalesce("split", F.lit(False)).alias("split"))
    rows = held.keep(rows, "rows")
    whole = rows.where("NOT split").select("key", "class_id")
    sizes = rows.groupBy("key", "family").agg(F.count_if(~F.col("split")).alias("n")).groupBy("key")
    mixed = sizes.agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("families")).where("families > 1 AND c > 0").select("key", "c")
    return lookup(whole, held.keep(mixed, "mixed"), "key", whole.count()).select("class_id").distinct()
