"""Language-model scores of whole documents: an add-one word base and a gated recurrent model beside it.

Word counts are gathered over every training document by one distributed aggregation. Words with at least
N / HEAD_SHARE of the N training tokens are sent to the tasks: there can be at most HEAD_SHARE of them. All other
words of a document meet their counts in a join. The recurrent model reads the most frequent words; a word
beyond them is an unknown one, spelled out by its add-one share among such words, so the model gives every text
a proper probability. Its vocabulary grows with the cube root of the training tokens. It is trained on all training
documents, each read whole and once: a round takes its share of them, every task runs truncated backpropagation over its
texts from the same weights, and the tasks' weights are averaged, each by its number of tokens, in groups of bounded size.
A task reads at least TOKENS_A_WEIGHT tokens for each weight it sends, so weights sent stay a fraction of the text read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textkit
from tessella.llm.common import Scratch, held_out, materialize
from tessella.llm.gru import END, GRU, UNKNOWN, Adam

HEAD_SHARE = 1_000_000
MODEL_WORDS = 1024  # words of the model at least, if the corpus has them
HIDDEN = 16
ROUNDS = 4  # shares of the training documents, with the weights averaged after each
RATE = 0.01
TASK_TOKENS = 1_000_000  # training tokens of a round for a task of its own, at least
TOKENS_A_WEIGHT = 2
CHUNK = 65_536  # weights averaged together
MERGED = 256  # tasks whose weights meet in one group
MERGE_WORDS = 2_000_000  # distinct words of scans held before they are passed on
_LN10 = math.log(10)

_ROW = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_logs double, model_log double, unknown long, tail array<long>, tail_n array<int>"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, held = [], 0
        for w in textkit.scan(batch.column(0), textkit.SPACED):
            parts.append(np.unique(w.hashes(), return_counts=True))
            held += len(parts[-1][0])
            if held > MERGE_WORDS:
                yield _merged(parts)
                parts, held = [], 0
        if parts:
            yield _merged(parts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    words, n = (np.concatenate(x) for x in zip(*parts))
    words, place = np.unique(words, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(np.bincount(place, n, len(words)).astype(np.int64))], names=["word", "n"])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): each distinct word's 64-bit hash and count over all rows of docs."""
    return docs.select(F.col(text_col)).mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unpack(flat: np.ndarray, p: dict[str, np.ndarray]) -> None:
    """Put flat weights into the arrays of p."""
    at = 0
    for k in sorted(p):
        p[k][...] = flat[at : at + p[k].size].reshape(p[k].shape)
        at += p[k].size


def _learn(batches: Iterator[pa.RecordBatch], model_words: np.ndarray, model_counts: np.ndarray, hidden: int, start: np.ndarray, rate: float) -> Iterator[pa.RecordBatch]:
    """A task's weights, in chunks, after one pass over its whole texts from the given weights, and its tokens."""
    places = np.argsort(model_words)
    ordered = model_words[places]
    model = GRU(model_counts, hidden)
    _unpack(start, model.p)
    adam, tokens = Adam(model.p), 0
    for batch in batches:
        streams = []
        for words in textkit.scan(batch.column(0), textkit.SPACED):
            streams.append(np.insert(_ids(words.hashes(), ordered, places), words.bounds[1:], END))
        if streams:
            stream = np.concatenate(streams)
            tokens += len(stream)
            model.pass_over(stream, adam, rate)
    if tokens:
        flat = _pack(model.p)
        part = TaskContext.get().partitionId()
        for chunk, at in enumerate(range(0, len(flat), CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([part]), pa.array([float(tokens)]), pa.array([flat[at : at + CHUNK].tobytes()], pa.binary())], names=["chunk", "part", "tokens", "weights"])


_WEIGHTS = "chunk long, part long, tokens double, weights binary"


def _mean(key: tuple, group: pa.Table) -> pa.Table:
    """The mean of one chunk's weights by tokens, with the tokens' sum."""
    total, tokens = 0.0, 0.0
    for n, raw in zip(group.column("tokens").to_pylist(), group.column("weights")):
        total = total + n * np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64)
        tokens += n
    return pa.table({"chunk": key[:1], "part": key[1:], "tokens": [tokens], "weights": pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())})


def train(texts: DataFrame, model_words: np.ndarray, model_counts: np.ndarray, hidden: int, rounds: int, tokens: int) -> bytes | None:
    """The model's weights after one pass over all rows of texts (text, deal: a hash), in `rounds` shares; None without rows."""
    spark, model = texts.sparkSession, GRU(model_counts, hidden)
    start, learnt = _pack(model.p), False
    tasks = max(1, tokens // (rounds * max(TASK_TOKENS, TOKENS_A_WEIGHT * len(start))))
    for turn in range(rounds):
        held = spark.sparkContext.broadcast((model_words, model_counts, hidden, start, RATE * (1 - turn / rounds)))
        share = texts.where(F.pmod("deal", F.lit(rounds)) == turn).select("text").coalesce(tasks)
        means, parts = share.mapInArrow(lambda it, h=held: _learn(it, *h.value), _WEIGHTS), tasks
        while True:
            means, parts = means.withColumn("part", F.expr(f"part div {MERGED}")).groupBy("chunk", "part").applyInArrow(_mean, _WEIGHTS), -(-parts // MERGED)
            if parts == 1:
                break
        got = means.select("chunk", "weights").toArrow().sort_by("chunk")
        if got.num_rows:
            start, learnt = np.frombuffer(b"".join(got.column("weights").to_pylist()), np.float32), True
        held.destroy()
    if not learnt:
        return None
    _unpack(start, model.p)
    out = io.BytesIO()
    np.savez(out, **model.p)
    return out.getvalue()


def _ids(hashes: np.ndarray, ordered: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Model ids of word hashes: unknown, or 2 and up."""
    if not len(ordered):
        return np.full(len(hashes), UNKNOWN)
    at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
    return np.where(ordered[at] == hashes, places[at] + 2, UNKNOWN)


class _Scorer:
    """All that a task needs: the head words' counts and ids, and the model."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, model_id: np.ndarray, docs: int, spell: float, size: int, hidden: int, weights: bytes | None):
        self.head, self.logs, self.model_id = head, np.log10(counts + 1.0), model_id
        self.end_log, self.docs, self.spell = math.log10(docs + 1), docs, spell
        self.model = None
        if weights is not None:
            self.model = GRU(np.ones(size), hidden)
            self.model.p = dict(np.load(io.BytesIO(weights)))

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, known, logs, tokens, unknown, tail, tail_n, spelled = [], [], [], [], [], [], [], []
            for w in textkit.scan(batch.column("text"), textkit.SPACED):
                h, n = w.hashes(), len(w.per_row)
                place = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1) if len(self.head) else np.zeros(len(h), np.int64)
                found = self.head[place] == h if len(self.head) else np.zeros(len(h), bool)
                own = np.where(found, self.model_id[place], UNKNOWN) if len(self.head) else np.full(len(h), UNKNOWN)
                row = w.row_of
                known.append(np.bincount(row[found], minlength=n))
                logs.append(np.bincount(row[found], self.logs[place[found]], n))
                odd = found & (own == UNKNOWN)
                spelled.append(np.bincount(row[odd], self.logs[place[odd]], n))
                unknown.append(np.bincount(row[own == UNKNOWN], minlength=n))
                tokens.append(w.per_row + 1)
                ids.append(np.insert(own, w.bounds[1:], END))
                rest = np.flatnonzero(~found)
                edges = np.searchsorted(row[rest], np.arange(n + 1))
                for r in range(n):
                    words, times = np.unique(h[rest[edges[r] : edges[r + 1]]], return_counts=True)
                    tail.append(words.astype(np.int64))
                    tail_n.append(times.astype(np.int32))
            n = batch.num_rows
            if not n:
                continue
            known, logs, tokens, unknown, spelled = (np.concatenate(x) for x in (known, logs, tokens, unknown, spelled))
            total = np.zeros(n)
            if self.model is not None:
                total = self.model.score(np.concatenate(ids), np.concatenate(([0], np.cumsum(tokens)))) / _LN10 + spelled - unknown * self.spell
            yield pa.RecordBatch.from_arrays(
                [pa.array(at + np.arange(n)), batch.column("doc_id"), batch.column("held_out"), pa.array(tokens.astype(np.int64)), pa.array(known + (self.docs > 0)), pa.array(logs + self.end_log), pa.array(total), pa.array(unknown.astype(np.int64)), pa.array(tail, pa.list_(pa.int64())), pa.array(tail_n, pa.list_(pa.int32()))],
                names=["row", "doc_id", "held_out", "n_tokens", "head_known", "head_logs", "model_log", "unknown", "tail", "tail_n"],
            )
            at += n


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, hidden: int = HIDDEN, rounds: int = ROUNDS, sample_docs: int | None = None) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Tokens are the words split at ASCII white space after lower-casing A-Z, then one end. Documents whose
    crc32(id as text) mod modulus is remainder are held out of all learning.

    Defined cases: null text counts as empty and is one end; a null id is not held out; repeated rows count and are
    scored each; with no training rows the base is 0 for every token and score equals base_score; a text of any
    length is scored whole, in windows that pass their state on; an empty table gives no rows; other columns are ignored.
    The recurrent model learns from all training texts, whole and once; with sample_docs, from so many of them by id hash.
    """
    with Scratch(docs.sparkSession) as scratch:
        return materialize(_scored(docs, id_col, text_col, modulus, remainder, hidden, rounds, sample_docs, scratch), "scores")


def _scored(docs: DataFrame, id_col: str, text_col: str, modulus: int, remainder: int, hidden: int, rounds: int, sample_docs: int | None, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(id_col, modulus, remainder).alias("held_out"))
    training = base.where(~F.col("held_out"))
    counts = scratch.keep(word_counts(training), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_docs = training.count()
    n, v = int(sums["n"]) + train_docs, int(sums["v"]) + (train_docs > 0)
    head = counts.where(F.col("n") * HEAD_SHARE >= n).toArrow()
    words, times = head.column("word").to_numpy().view(np.uint64), head.column("n").to_numpy().astype(np.int64)
    top = np.lexsort((words, -times))[: max(MODEL_WORDS, round(20 * n ** (1 / 3))) - 2]
    weights, spell = None, 0.0
    if train_docs:
        in_model = (times[top] + 1).sum() + train_docs + 1
        left = n + v + 1 - in_model
        spell = math.log10(left)
        model_counts = np.concatenate(([max(1, n - int(times[top].sum()) - train_docs), train_docs], times[top]))
        texts = training if sample_docs is None else training.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs)
        weights = train(texts.select("text", F.xxhash64("doc_id", "text").alias("deal")), words[top], model_counts, hidden, rounds, n)
    order = np.argsort(words)
    model_id = np.zeros(len(words), np.int64)
    model_id[top] = np.arange(len(top)) + 2
    held = spark.sparkContext.broadcast((words[order], times[order], model_id[order], train_docs, spell, len(top) + 2, hidden, weights))
    rows = scratch.keep(base.mapInArrow(lambda it: _Scorer(*held.value).rows(it), _ROW), "scored")
    tail = rows.select("row", F.inline(F.arrays_zip(F.col("tail").alias("word"), F.col("tail_n").alias("times")))).toDF("row", "word", "times")
    met = tail.join(counts, "word").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    scale = math.log10(n + v + 1)
    tail_logs = F.coalesce("logs", F.lit(0.0))
    base_score = F.col("head_logs") + tail_logs - F.col("n_tokens") * F.lit(scale)
    return rows.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base_score.alias("base_score"), (F.col("model_log") + tail_logs if weights is not None else base_score).alias("score"),
    )
