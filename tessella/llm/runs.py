"""Periodic runs in texts: maximal stretches of words that repeat with a period, found through a recompression grammar.

The words of a block of texts are one sequence of numbers. Alternating block and pair compression turns it into shorter and
shorter ones (a run-length grammar); two places are compared by climbing that grammar and descending again, so that the
extension of any two places costs a step or two a level. Each period p is tried at every (times - 1) * p words: a run of
times * p words agrees with itself, p words on, at one of these at least, and its exact ends are two extensions from there.

A null text, and one without words, has no runs and an empty collapsed text; very long texts are blocks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import crc_of

LEAST, TIMES = 6, 4  # words of a run, periods of a run
WORDS_AT_ONCE = 1 << 18
PLACES_AT_ONCE = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
_RUNS = "array<struct<start:long,length:long,period:long>>"


class Level:
    """One sequence of the grammar, and how its symbols are grouped into those of the next: first symbols, starts and ends of groups."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray | None = None, blocks: bool = False):
        self.symbols, self.first, self.blocks = symbols, first, blocks
        if first is not None:
            self.start = np.flatnonzero(first)
            self.up = np.cumsum(first) - 1
            self.end = np.append(self.start[1:], len(symbols))[self.up]

    def mirrored(self) -> Level:
        """The level read backwards."""
        last = None if self.first is None else np.append(self.first[1:], True)[::-1]
        return Level(self.symbols[::-1], last, self.blocks)


def _sides(symbols: np.ndarray, turn: int) -> np.ndarray:
    """A side for each symbol, the same wherever it stands: one bit of a hash."""
    mixed = (symbols.astype(np.uint64) + np.uint64(turn * 0x51ED2701)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63) == 1


def recompress(symbols: np.ndarray) -> list[Level]:
    """Levels of the run-length grammar of symbols (0 and up), until no symbol repeats."""
    levels, now, turn = [], symbols, 0
    while True:
        first = np.append(True, now[1:] != now[:-1])
        if not first.all():  # blocks: a symbol with its number of repetitions
            levels.append(Level(now, first, True))
            start = levels[-1].start
            times = np.diff(np.append(start, len(now)))
            now = pd.factorize(now[start] * (int(times.max()) + 1) + times)[0]
        most = int(now.max(initial=0)) + 1
        if most == len(now) and len(np.unique(now)) == len(now) or len(now) < 2:
            return [*levels, Level(now)]
        pairs = np.zeros(0, bool)
        while not pairs.any():  # pairs: a symbol of one side before one of the other
            side, turn = _sides(now, turn), turn + 1
            there, back = side[:-1] & ~side[1:], ~side[:-1] & side[1:]
            pairs = there if np.count_nonzero(there) >= np.count_nonzero(back) else back
        first = np.append(True, ~pairs)
        levels.append(Level(now, first))
        start = levels[-1].start
        second = np.where(levels[-1].end[start] - start == 2, now[np.minimum(start + 1, len(now) - 1)] + 1, 0)
        now = pd.factorize(now[start] * (most + 1) + second)[0]


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from places a and b on are equal, pair by pair; the sequence ends in a symbol that stands nowhere else."""
    x, y, top = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for height, level in enumerate(levels):  # up, as long as both places start equal groups
        live = live[level.symbols[x[live]] == level.symbols[y[live]]]
        if not len(live):
            break
        inside = live[~(level.first[x[live]] & level.first[y[live]])]
        for _ in range(1 if level.blocks else 2):
            step = np.minimum(level.end[x[inside]] - x[inside], level.end[y[inside]] - y[inside]) if level.blocks else 1
            x[inside] += step
            y[inside] += step
            same = level.symbols[x[inside]] == level.symbols[y[inside]]
            top[inside[~same]] = -1 - height
            inside = inside[same & ~(level.first[x[inside]] & level.first[y[inside]])]
        live = live[top[live] >= 0]
        x[live], y[live], top[live] = level.up[x[live]], level.up[y[live]], height + 1
    top = np.where(top < 0, -1 - top, top)
    for height in range(int(top.max(initial=0)), 0, -1):  # down, to the first word that differs
        level, live = levels[height - 1], np.flatnonzero(top == height)
        p, q = level.start[x[live]], level.start[y[live]]
        step = np.minimum(level.end[p] - p, level.end[q] - q) if level.blocks else 1
        step = np.where(level.symbols[p] == level.symbols[q], step, 0)
        x[live], y[live], top[live] = p + step, q + step, height - 1
    return x - a


def _places(words: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grids of all periods in a text of so many words, some at a time."""
    periods = np.arange(1, words // times + 1) if words >= least else np.zeros(0, np.int64)
    counts = (words - periods - 1) // ((times - 1) * periods) + 1
    total = np.cumsum(counts)
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PLACES_AT_ONCE)))
        c = counts[at:to]
        period = np.repeat(periods[at:to], c)
        turn = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield turn * (times - 1) * period, period
        at = to


def block_runs(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """(start, length, smallest period) of the runs of each text, given as word numbers, by start and period."""
    fence = max((int(t.max(initial=-1)) for t in texts), default=-1) + 1  # stands before and between texts, each time another number
    joined = np.concatenate([[fence], *[x for i, t in enumerate(texts) for x in (t, [fence + 1 + i])]]).astype(np.int64)
    firsts = np.cumsum([1, *[len(t) + 1 for t in texts]])[:-1]
    a, p = [], []
    for first, text in zip(firsts, texts):
        for place, period in _places(len(text), least, times):
            hit = np.flatnonzero(text[place] == text[place + period])
            a.append(place[hit] + first)
            p.append(period[hit])
    a, p = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, p))
    if not len(a):
        return [np.zeros((0, 3), np.int64) for _ in texts]
    levels = recompress(joined)
    back = [level.mirrored() for level in levels]
    found = []
    for lo in range(0, len(a), PLACES_AT_ONCE):
        x, y = a[lo : lo + PLACES_AT_ONCE], p[lo : lo + PLACES_AT_ONCE]
        to = x + y + extensions(levels, x, x + y)
        start = x - extensions(back, len(joined) - x, len(joined) - x - y)
        long = to - start >= np.maximum(least, times * y)
        found.append(np.stack([start, to, y], axis=1)[long])
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[: len(found)]  # its smallest period comes first
    found = found[fresh]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    edges = np.searchsorted(found[:, 0], np.append(firsts, len(joined)))
    return [np.stack([f[:, 0] - first, f[:, 1] - f[:, 0], f[:, 2]], axis=1) for first, lo, hi in zip(firsts, edges, edges[1:]) for f in [found[lo:hi]]]


def kept_words(words: int, runs: np.ndarray) -> np.ndarray | None:
    """Mask of the words that no run contains after its first period; None if all stay."""
    if not len(runs):
        return None
    edges = np.zeros(words + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def best_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    return min(((int(s), int(n), int(p)) for s, n, p in runs), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _results(ids: pa.Array, words: list[list[bytes]], least: int, times: int) -> pa.RecordBatch:
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = np.cumsum([len(ws) for ws in words])
    runs = block_runs(np.split(flat, ends[:-1]), least, times)
    collapsed = []
    for ws, found in zip(words, runs):
        keep = kept_words(len(ws), found)
        collapsed.append(b" ".join(ws if keep is None else [w for w, k in zip(ws, keep.tolist()) if k]))
    best = [best_run(found) for found in runs]
    every = np.concatenate(runs)
    parts = pa.StructArray.from_arrays([pa.array(every[:, i], pa.int64()) for i in range(3)], names=["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), parts)
    three = pa.array([None if b is None else dict(zip(("start", "length", "period"), b)) for b in best], parts.type)
    texts = pa.array(collapsed, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array([len(ws) for ws in words], pa.int64()), listed, three, texts], names=["doc_id", "n_words", "runs", "best", "collapsed"])


def _blocks(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    """Whole texts in blocks of about WORDS_AT_ONCE words."""
    for batch in batches:
        words, count, first = [], 0, 0
        for i, text in enumerate(batch.column(1).cast(pa.binary())):
            mine = (text.as_py() or b"").split()  # splits at the white space of ASCII, which is all that divides words
            if words and count + len(mine) > WORDS_AT_ONCE:
                yield _results(batch.column(0).slice(first, len(words)), words, least, times)
                words, count, first = [], 0, i
            words.append(mine)
            count += len(mine)
        if words:
            yield _results(batch.column(0).slice(first), words, least, times)


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs, best, collapsed of each row of docs (doc_id, text; other columns are not looked at).

    runs: all maximal stretches of at least `least` words and `times` (2 or more) of their smallest period, by start and period;
    best: that of the greatest length / period; collapsed: the text, one space between words, without the words that a run
    contains after its first period. Every row counts for itself, repeated ids and null ids too.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _blocks(it, least, times), f"doc_id long, n_words long, runs {_RUNS}, best struct<start:long,length:long,period:long>, collapsed string")


def periodic_text(doc_id: Column, text: Column) -> Column:
    """The text itself, or for one id in ten its words with a tail that repeats with a period, both drawn from the id's crc32; a null id's text stays."""
    h = crc_of(doc_id)
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        return F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda c: F.transform(words, lambda w, i: F.when(i >= c["a"], F.get(words, (c["a"] + F.pmod(i - c["a"], c["p"])).cast("int"))).otherwise(w)))[0]

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    joined = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, F.array_join(tail(ws), " ")).otherwise(""))[0]
    return F.when(text.isNotNull() & (F.pmod(h, F.lit(10)) == 0), joined).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the best run and its exponent in thousandths, digests of all runs and of the collapsed text, over texts as of periodic_text."""
    texts = docs.select("doc_id", periodic_text(F.col("doc_id"), F.col("text")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return find_runs(texts).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli,
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
