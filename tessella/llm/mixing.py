"""Mixing to target weights with soft domain membership.

A softmax classifier, trained on a bounded sample of labelled rows, gives every document posteriors over the label
table's domains. Nonnegative document rates are then fitted so that the expected tokens of each domain match the
targets: minimise |A w - T|^2 (in shares of all tokens) + pull * mean token-weighted (w - 1)^2 by projected gradient. The
rows of A never leave the executors: a step needs only the vector of domain totals, one distributed sum, and a document's
rate after k steps follows from its own posteriors and the k residual vectors. Residuals are scaled by the inverse of the
domains' second moments over documents of positive rate, so that rare domains converge as fast as common ones.

After STEPS steps the pull shrinks from step to step, so that rates far from 1 can meet targets that need them. Targets that no
nonnegative rates can meet are recognised by a separating plane (Farkas): if a scaled residual y has y . p >= -e for every
document, then y . (A w - T) >= -y . T - e for all rates, and the fit ends where it is as near as this allows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import textkit
from tessella.llm.common import Scratch, free_name, materialize

#: domains of the label table, and the share of tokens that the mixture should have of each
TARGETS = {"clean": 0.85, "low": 0.10, "toxic": 0.05}
BUCKETS = 2048
SAMPLE_ROWS = 4_000
STEPS = 20  # with the whole pull; then it shrinks
MOST_STEPS = 80
SHRINK = 0.7
FOLDED = 20  # steps after which the rates so far are kept in a table, so that a sum never goes over more steps than these
NEAREST = 0.01  # of the least distance, by which a fit out of reach may exceed it
STEP = 0.7
TOLERANCE = 5e-4  # of all tokens, on each domain's share
PULL = 0.002
SEED = 11


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "clean").when(quality == 0, "low")


def features(words: textkit.Words) -> np.ndarray:
    """Presence of hashed words and word beginnings, scaled by length, and shape statistics; one row per text."""
    n = len(words.per_row)
    out = np.zeros((n, BUCKETS + 6), dtype=np.float32)
    row = words.row_of
    size = words.ends - words.starts
    for start, end, shift in ((words.starts, words.ends, 3), (words.starts, np.minimum(words.ends, words.starts + 5), 17)):
        h = words.hash_range(start, end) >> np.uint64(shift)
        out[row, (h & np.uint64(BUCKETS - 1)).astype(np.int64)] = 1
    kinds = np.maximum(1, out[:, :BUCKETS].sum(axis=1))
    out[:, :BUCKETS] /= np.sqrt(kinds)[:, None]
    count = np.maximum(1, words.per_row)
    odd = (words.data < 0x30) & (words.data > 0x20) | (words.data >= 0x7B) & (words.data < 0x80)
    odd_before = np.concatenate(([0], np.cumsum(odd)))
    marks = np.bincount(row, odd_before[words.ends] - odd_before[words.starts], n) if len(row) else np.zeros(n)
    letters = np.bincount(row, size, n) if len(row) else np.zeros(n)
    out[:, BUCKETS:] = np.column_stack([np.log1p(words.per_row) / 5, marks / np.maximum(1, letters) * 3, letters / count / 5, kinds / count, words.per_row == 0, np.ones(n)])
    return out


class Classifier:
    def __init__(self, domains: list[str], x: np.ndarray, y: np.ndarray, steps: int = 150):
        self.domains = domains
        goal = np.eye(len(domains))[y]
        w, m, v = (np.zeros((x.shape[1], len(domains))) for _ in range(3))
        for t in range(1, steps + 1):
            g = x.T @ (self._softmax(x @ w) - goal) / max(1, len(x)) + 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.w = w.astype(np.float32)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return self._softmax((x @ self.w).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Train on at most SAMPLE_ROWS labelled rows, by id hash; their texts are read whole, only features leave the executors."""
    domains = sorted(targets)
    marked = labels.select(F.col(id_col).alias("_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where(F.col("domain").isin(domains)).groupBy("_id").agg(F.min("domain").alias("domain"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in textkit.scan(batch.column(0), textkit.ALNUM, 1 << 18):
                x = features(words).astype(np.float16)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(words.first, len(x)) for c in (1, 2)), pa.array([v.tobytes() for v in x], pa.binary())], names=["domain", "place", "x"])

    each = rows.select("text", "domain", F.xxhash64("_id", "text").alias("place")).mapInArrow(prepare, "domain string, place long, x binary")
    got = each.orderBy("place").limit(SAMPLE_ROWS).toArrow()
    x = np.frombuffer(textkit.joined(got.column("x")), dtype=np.float16).reshape(got.num_rows, BUCKETS + 6).astype(np.float32)
    return Classifier(domains, x, np.array([domains.index(d) for d in got.column("domain").to_pylist()], dtype=np.int64))


def _posterior_rows(batches: Iterator[pa.RecordBatch], model: Classifier) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, rows = [], []
        for words in textkit.scan(batch.column(0), textkit.ALNUM, 1 << 18):
            tokens.append(words.per_row)
            rows.append(model.posteriors(features(words)))
        p = np.concatenate(rows) if rows else np.zeros((0, len(model.domains)))
        n = np.concatenate(tokens).astype(np.int64) if tokens else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], names=[*batch.schema.names[1:], "n_tokens", "p"])


def posteriors(docs: DataFrame, model: Classifier, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, n_tokens and p (posteriors in the order of model.domains) of every row."""
    given = docs.select(F.col(f"`{text_col}`").alias(free_name(docs, "text")), *[F.col(f"`{c}`") for c in keep])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema[1:])
    held = docs.sparkSession.sparkContext.broadcast(model)
    return given.mapInArrow(lambda it: _posterior_rows(it, held.value), f"{schema}n_tokens long, p array<double>")


def _rate(moves: list[tuple[list[float], float]], step: float, start: str = "1D") -> Column:
    """A document's rate after moves (residual r, pull) from start: w <- max(0, w - step * (p . r + pull * (w - 1)))."""
    if not moves:
        return F.expr(start)
    table = "array(" + ", ".join(f"named_struct('r', array({', '.join(f'{x!r}D' for x in r)}), 'pull', {pull!r}D)" for r, pull in moves) + ")"
    return F.expr(f"aggregate({table}, {start}, (w, m) -> greatest(0D, w - {step!r}D * ({_dot('m.r')} + m.pull * (w - 1D))))")


def _dot(other: str) -> str:
    return f"aggregate(zip_with(p, {other}, (a, b) -> a * b), 0D, (s, x) -> s + x)"


def fit_rates(rows: DataFrame, targets: dict[str, float], steps: int = STEPS, pull: float = PULL) -> tuple[Column, list[float], list[float]]:
    """(rate column over n_tokens and p, target shares, shares reached) for materialised rows; one sum a step.

    Ends when all shares are within TOLERANCE, or proven to be as near as any rates come, or after MOST_STEPS; the last
    two warn.
    """
    domains = sorted(targets)
    total_share = sum(targets.values())
    goal = [targets[d] / total_share for d in domains]
    whole = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    d = len(domains)
    moves: list[tuple[list[float], float]] = []
    nearest = False
    with Scratch(rows.sparkSession) as held:
        state, start, folded = rows, "1D", 0
        while True:
            if len(moves) - folded == FOLDED:
                state = held.keep(state.select(_rate(moves[folded:], STEP, start).alias("w"), "n_tokens", "p"), "rates")
                start, folded = "w", len(moves)
            live = F.col("n_tokens") * (F.col("w") > 0).cast("int")
            totals = [F.sum(F.col("w") * F.col("n_tokens") * F.col("p")[i]) for i in range(d)]
            moments = [F.sum(live * F.col("p")[i] * F.col("p")[j]) for i in range(d) for j in range(d)]
            plane = moves[-1][0] if moves else [0.0] * d
            lowest = F.min(F.when(F.col("n_tokens") > 0, F.expr(_dot(f"array({', '.join(f'{x!r}D' for x in plane)})"))))
            sums = state.select(_rate(moves[folded:], STEP, start).alias("w"), "n_tokens", "p").agg(*[F.coalesce(x, F.lit(0.0)) for x in (*totals, *moments, lowest)]).first()
            shares = [(x / whole) if whole else g for x, g in zip(sums, goal)]
            off = np.array(shares) - np.array(goal)
            if np.abs(off).max(initial=0) < TOLERANCE:
                break
            least = -float(np.dot(plane, goal)) + min(0.0, sums[-1])
            nearest = least > 0 and float(np.dot(plane, off)) <= (1 + NEAREST) * least
            if nearest or len(moves) >= MOST_STEPS:
                break
            scale = np.linalg.inv(np.array(sums[d:-1], dtype=np.float64).reshape(d, d) / max(1, whole) + 1e-4 * np.eye(d))
            moves.append(([round(float(x), 9) for x in scale @ off], pull * SHRINK ** max(0, len(moves) + 1 - steps)))
    gap = float(np.abs(off).max(initial=0))
    if nearest:
        warnings.warn(f"mixing targets are out of reach; the nearest rates leave a domain {gap:.4f} of all tokens from its target", stacklevel=2)
    elif gap >= TOLERANCE:
        warnings.warn(f"mixing stopped after {len(moves)} steps with a domain {gap:.4f} of all tokens from its target", stacklevel=2)
    return _rate(moves, STEP), goal, shares


def copies(rate: Column, seed: int, *key: Column) -> Column:
    """Whole copies of a row: floor(rate) and one more with the probability of the rest, by a seeded hash of the key."""
    u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Kept columns with n_tokens, p_<domain>, rate and copies of every row.

    Expected domain tokens are sum(rate * n_tokens * p) and match the targets' shares of all tokens, by rates near 1
    where they can (PULL); targets that no rates meet are met as nearly as possible, with a warning. Defined cases: texts without words have no tokens, an even rate and no weight in the fit; null
    ids take part; labels outside the targets and null labels are not learned from; without labels posteriors are even;
    repeated rows each get a row and the same rate; an empty table gives no rows; of kept columns named like a result
    the result stands, any other name may be kept.
    """
    targets = TARGETS if targets is None else targets
    keep = [id_col] if keep is None else keep
    model = fit(docs, labels, targets, id_col, text_col)
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    results = {"n_tokens", "rate", "copies", *(f"p_{d}".lower() for d in model.domains)}
    kept = [F.col(f"`{c}`") for c in keep if c.lower() not in results]
    filler = free_name(docs, "_end")  # a struct needs a field even where nothing is kept
    boxed = docs.select(F.col(text_col).alias("text"), key.alias("key"), F.struct(*kept, F.lit(None).cast("int").alias(filler)).alias("kept"))
    rows = materialize(posteriors(boxed, model, ["kept", "key"], "text"), "posteriors")
    rate, _, _ = fit_rates(rows, targets)
    out = rows.withColumn("rate", rate).select("kept", "key", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate")
    return out.select("kept.*", "n_tokens", *[f"p_{d}" for d in model.domains], "rate", copies(F.col("rate"), seed, F.col("key")).alias("copies")).drop(filler)
