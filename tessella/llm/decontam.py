"""Benchmark decontamination with a distributed positional inverted index of the training texts.

build_index cuts the documents into blocks and stores, for every word of a block, the sorted list of its positions
(gaps, so that frequent words compress). A block holds whole documents, so all lists that a phrase needs lie in one
row and no posting is shuffled. A test window is looked up from its rarest word by corpus-wide count: that word's
list, shifted by its offset, is intersected with the shifted lists of the other words in order of rarity. Near matches are
looked up from each of a window's rarest words that the documents have at all, one more than may be missing; so what is
found does not depend on how the documents lie in blocks.

The benchmark is read in slices of at most SLICE_BYTES of text; only one slice's windows are ever sent to the tasks
at once, and the slices' matches are merged per document, so a benchmark of any size works.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textkit
from tessella.llm.common import Scratch, materialize, total_bytes

WIDTH = 10
SLICE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
MOST_CANDIDATES = 1 << 20  # looked at together; more are taken in turns
SLOP = 2
NEAR_SHARE = 0.8

_INDEX = "block string, doc_ids array<long>, bounds binary, terms binary, counts binary, gaps binary"
_HITS = "block string, ord int, spans array<struct<s:int,e:int>>, items array<string>, near array<string>"


def _index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in textkit.scan(batch.column(1), textkit.ALNUM, BLOCK_BYTES):
            h = words.hashes()
            order = np.argsort(h, kind="stable")
            terms, first, counts = np.unique(h[order], return_index=True, return_counts=True)
            gaps = np.diff(order.astype(np.uint32), prepend=np.uint32(0))
            ids = batch.column(0).slice(words.first, len(words.per_row))
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([words.bounds.astype(np.uint32).tobytes()], pa.binary()), pa.array([terms.tobytes()], pa.binary()), pa.array([counts.astype(np.uint32).tobytes()], pa.binary()), pa.array([gaps.tobytes()], pa.binary())],
                names=["block", "doc_ids", "bounds", "terms", "counts", "gaps"],
            )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents: document ids, word bounds, and each term's posting list."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_index_blocks, _INDEX)


@dataclass
class Windows:
    """The distinct windows of a slice of the benchmark."""

    vocab: np.ndarray  # sorted word hashes
    words: np.ndarray  # (windows, width) places in vocab, -1 after a short window's end
    length: np.ndarray
    item_at: np.ndarray  # where each window's items start in items
    items: np.ndarray  # places in names
    names: list[str]
    by_rarity: np.ndarray | None = None  # (windows, width) offsets, rarest word first
    rank: np.ndarray | None = None  # (windows, width) by that order: 1, 2, ... for words that the documents have, 0 for others


def windows_of(items: list[tuple], width: int = WIDTH) -> Windows:
    """Windows of (item_id, text) rows; equal windows are kept once with all their items."""
    names = [str(i) for i, _ in items]
    rows, lengths, owner = [np.zeros((0, width), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for words in textkit.scan(pa.array([t for _, t in items], pa.string()), textkit.ALNUM):
        h, bounds = words.hashes(), words.bounds
        for r, n in enumerate(words.per_row):
            if n == 0:
                continue
            own = h[bounds[r] : bounds[r + 1]]
            w = np.zeros((max(1, n - width + 1), width), dtype=np.uint64)
            if n >= width:
                w[:] = np.lib.stride_tricks.sliding_window_view(own, width)
            else:
                w[0, :n] = own
            rows.append(w)
            lengths.append(np.full(len(w), min(n, width)))
            owner.append(np.full(len(w), words.first + r))
    grams, length, owners = np.concatenate(rows), np.concatenate(lengths), np.concatenate(owner)
    table = np.column_stack([grams, length.astype(np.uint64)])
    distinct, inverse = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
    pairs = np.unique(np.column_stack([inverse.reshape(-1), owners]), axis=0)
    size = distinct[:, width].astype(np.int64)
    inside = np.arange(width)[None, :] < size[:, None]
    vocab = np.unique(distinct[:, :width][inside])
    places = np.where(inside, np.searchsorted(vocab, distinct[:, :width]), -1).astype(np.int32)
    return Windows(vocab, places, size, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1], names)


def _lookup(vocab: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(present, place) of vocab words in a block's sorted terms."""
    if not len(terms):
        return np.zeros(len(vocab), bool), np.zeros(len(vocab), np.int64)
    at = np.minimum(np.searchsorted(terms, vocab), len(terms) - 1)
    return terms[at] == vocab, at


def _count_terms(batches: Iterator[pa.RecordBatch], vocab: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(vocab), dtype=np.int64)
    for batch in batches:
        for terms, counts in zip(batch.column(0), batch.column(1)):
            present, at = _lookup(vocab, np.frombuffer(terms.as_buffer(), np.uint64))
            total[present] += np.frombuffer(counts.as_buffer(), np.uint32)[at[present]]
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["word", "n"])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each range, one after another."""
    if not sizes.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


class _Block:
    """The posting lists of one block, for the words of a slice."""

    def __init__(self, vocab, bounds, terms, counts, gaps):
        self.bounds = bounds.astype(np.int64)
        present, at = _lookup(vocab, terms)
        first = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
        self.size = np.where(present, counts[at], 0).astype(np.int64) if len(terms) else np.zeros(len(vocab), np.int64)
        positions = np.cumsum(gaps, dtype=np.uint32).astype(np.int64)
        picked = positions[_ranges(first[at] if len(terms) else at, self.size)]
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.keys = (np.repeat(np.arange(len(vocab)), self.size) << 32) | picked

    def has(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a posting of word lies in low..high."""
        low = np.maximum(low, 0)
        at = np.searchsorted(self.keys, (word << 32) | low)
        inside = at < len(self.keys)
        found = np.zeros(len(word), bool)
        found[inside] = self.keys[at[inside]] <= ((word[inside] << 32) | high[inside])
        return found

    def matches(self, w: Windows, slop: int, share: float):
        """(kind, window, start word, document) of exact and of near matches, in turns of bounded size."""
        if not len(w.words):
            return
        seen = np.where(w.words >= 0, self.size[w.words] > 0, False)
        known = seen.sum(axis=1)
        whole = np.flatnonzero(known == w.length)
        for win, start, doc in self._starts(w, whole, w.by_rarity[whole, 0]):
            good = (start >= self.bounds[doc]) & (start + w.length[win] <= self.bounds[doc + 1])
            win, start, doc = win[good], start[good], doc[good]
            for j in range(1, w.words.shape[1]):
                off = w.by_rarity[win, j].astype(np.int64)
                word = w.words[win, off].astype(np.int64)
                good = (word < 0) | self.has(np.maximum(word, 0), start + off, start + off)
                win, start, doc = win[good], start[good], doc[good]
            yield "exact", win, start, doc
        if not slop:
            return
        need = np.ceil(share * w.length).astype(np.int64)
        some = np.flatnonzero(known >= need)
        by_rarity, rank = w.by_rarity[some].astype(np.int64), w.rank[some]
        # of so many words that the documents have at least one stands in every near match
        for anchor in range(1, int((w.length - need).max(initial=0)) + 2):
            has = (rank == anchor).any(axis=1) & (anchor <= w.length[some] - need[some] + 1)
            offset = by_rarity[has, (rank[has] == anchor).argmax(axis=1)]
            for win, start, doc in self._starts(w, some[has], offset):
                yield self._near(w, win, start, doc, slop, need)

    def _starts(self, w: Windows, windows: np.ndarray, offset: np.ndarray):
        """(window, start word, document) for every posting of each window's word at offset, in turns of about MOST_CANDIDATES."""
        offset = offset.astype(np.int64)
        word = w.words[windows, offset]
        load = np.cumsum(self.size[word])
        done = 0
        while done < len(windows):
            upto = max(done + 1, int(np.searchsorted(load, (load[done - 1] if done else 0) + MOST_CANDIDATES, side="right")))
            turn = slice(done, upto)
            done = upto
            sizes = self.size[word[turn]]
            at = self.keys[_ranges(self.at[word[turn]], sizes)] & 0xFFFFFFFF
            yield np.repeat(windows[turn], sizes), at - np.repeat(offset[turn], sizes), np.searchsorted(self.bounds, at, side="right") - 1

    def _near(self, w: Windows, win, start, doc, slop: int, need: np.ndarray):
        """Windows of which so many words as needed stand within slop of their places in the document."""
        low, high = self.bounds[doc], self.bounds[doc + 1] - 1
        count, left = np.zeros(len(win), np.int64), w.length[win].copy()
        for j in range(w.words.shape[1]):
            alive = np.flatnonzero(count + left >= need[win])
            off = w.by_rarity[win[alive], j].astype(np.int64)
            word = w.words[win[alive], off].astype(np.int64)
            at = start[alive] + off
            hit = (word >= 0) & self.has(np.maximum(word, 0), np.maximum(at - slop, low[alive]), np.minimum(at + slop, high[alive]))
            count[alive] += hit
            left[alive] -= word >= 0
        good = count >= need[win]
        return "near", win[good], start[good], doc[good]


def _match(batches: Iterator[pa.RecordBatch], w: Windows, slop: int, share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        out: dict[tuple, tuple[list, set, set]] = {}
        for i in range(batch.num_rows):
            name = cols["block"][i].as_py()
            parts = [np.frombuffer(cols[c][i].as_buffer(), t) for c, t in (("bounds", np.uint32), ("terms", np.uint64), ("counts", np.uint32), ("gaps", np.uint32))]
            block = _Block(w.vocab, *parts)
            for kind, win, start, doc in block.matches(w, slop, share):
                for d in np.unique(doc):
                    own = doc == d
                    spans, items, near = out.setdefault((name, int(d)), ([], set(), set()))
                    hit = np.unique(win[own])
                    (items if kind == "exact" else near).update(np.unique(w.items[_ranges(w.item_at[hit], w.item_at[hit + 1] - w.item_at[hit])]).tolist())
                    if kind == "exact":
                        s = start[own] - block.bounds[d]
                        spans += _union(s, s + w.length[win[own]])
        if out:
            yield pa.RecordBatch.from_pydict(
                {"block": [k[0] for k in out], "ord": pa.array([k[1] for k in out], pa.int32()), "spans": pa.array([[{"s": s, "e": e} for s, e in v[0]] for v in out.values()], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), "items": pa.array([[w.names[x] for x in sorted(v[1])] for v in out.values()], pa.list_(pa.string())), "near": pa.array([[w.names[x] for x in sorted(v[2])] for v in out.values()], pa.list_(pa.string()))}
            )


def _union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same places."""
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], s[1:] > reach[:-1]))
    return list(zip(s[fresh].tolist(), reach[np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(s) - 1]))].tolist()))


def _hits(index: DataFrame, items: list[tuple], width: int, slop: int, share: float) -> DataFrame:
    spark = index.sparkSession
    w = windows_of(items, width)
    if not len(w.words):
        return spark.createDataFrame([], _HITS)
    vocab = w.vocab
    counted = index.select("terms", "counts").mapInArrow(lambda it: _count_terms(it, vocab), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    count = np.zeros(len(vocab), np.int64)
    for row in counted.toLocalIterator():
        count[row["word"]] = row["n"]
    w.by_rarity = np.argsort(np.where(w.words >= 0, count[w.words], np.iinfo(np.int64).max), axis=1, kind="stable").astype(np.int16)
    ordered = np.take_along_axis(w.words, w.by_rarity.astype(np.int64), axis=1)
    there = (ordered >= 0) & (count[ordered] > 0)
    w.rank = np.where(there, np.cumsum(there, axis=1), 0).astype(np.int16)
    held = spark.sparkContext.broadcast(w)
    return index.select("block", "bounds", "terms", "counts", "gaps").mapInArrow(lambda it: _match(it, held.value, slop, share), _HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, slop: int = SLOP, share: float = NEAR_SHARE) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, items, n_near.

    Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. A window is width words
    of an item in a row (all words of a shorter one). n_hit counts document words inside an occurrence of a window;
    items lists the items with an occurring window; n_near counts items of which a window occurs with share of its
    words within slop places of where they stand in it (slop 0: not looked for). Such an occurrence is placed by one of
    the window's rarest words in all documents, which stands exactly: of the words that documents have, rarest first
    and ties from the left, so many as may be missing and one more.

    Defined cases: null or wordless texts have no words and are clean; wordless items have no window; equal items all
    count; repeated rows each give a row; an item with a null id counts as the text "None"; empty tables give no rows
    or only clean ones; other columns are ignored. Words are told apart by 64-bit hashes.
    """
    with Scratch(docs.sparkSession) as held:
        index = held.keep(build_index(docs, id_col, text_col), "postings")
        return materialize(_contaminated(index, benchmark, width, slop, share, held), "contaminated")


def _contaminated(index: DataFrame, benchmark: DataFrame, width: int, slop: int, share: float, held: Scratch) -> DataFrame:
    slices = max(1, -(-total_bytes(benchmark, "text") // SLICE_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    hits = None
    for k in range(slices):
        items = [(r["item_id"], r["text"]) for r in benchmark.where(F.coalesce(part, F.lit(0)) == k).select("item_id", "text").toLocalIterator()]
        found = held.keep(_hits(index, items, width, slop, share), "hits")
        hits = found if hits is None else hits.union(found)
    merged = hits.groupBy("block", "ord").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.size(F.array_distinct(F.flatten(F.collect_list("near")))).alias("n_near"))
    covered = F.expr("aggregate(spans, named_struct('n', 0L, 'to', -1), (a, x) -> named_struct('n', a.n + greatest(0, x.e - greatest(x.s, a.to)), 'to', greatest(a.to, x.e)), a -> a.n)")
    merged = merged.select("block", "ord", covered.alias("hit"), "items", "n_near")
    rows = index.select("block", "doc_ids", "bounds").mapInArrow(_row_words, "block string, ord int, doc_id long, n_words long")
    out = rows.join(merged, ["block", "ord"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
        items.alias("items"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def _row_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids, bounds in zip(*batch.columns):
            n = np.diff(np.frombuffer(bounds.as_buffer(), np.uint32).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(n)), pa.array(np.arange(len(n), dtype=np.int32)), ids.values, pa.array(n)], names=["block", "ord", "doc_id", "n_words"])
