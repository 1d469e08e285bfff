"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters are fixed lexicons, one a language, and patterns mined from labelled training rows. A pattern is a word or a word
beginning; counts over all labelled training rows keep those whose toxic rows exceed chance beyond the number of
patterns tried, and a greedy cover of all their toxic texts picks voters that explain toxic rows no earlier voter does.
Where the cover needs more than MOST_VOTERS patterns, it goes on by elections, and those further patterns are pooled
into a few voters by their precision, so that none is lost and the label model stays small;
patterns that are common in clean rows and far rarer in toxic ones vote for clean. The label model is generative: by
expectation-maximisation it estimates how often each voter, and the given label as one more voter, fires on toxic and on
clean rows. Voters that fire together beyond what the classes explain are tied in a forest of the strongest
correlations, and a tied voter's rates depend on its neighbour's vote, so that it adds only what it knows beyond it. A
logistic classifier is then fitted to the posterior labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textkit
from tessella.llm.common import Scratch, free_name, held_out

PREFIXES = (3, 4, 5, 6, 7)  # bytes of a word beginning
MOST_VOTERS = 63  # patterns that vote alone; further ones vote in pools
POOLS = (0.93, 0.96, 0.99)  # precisions between the pools
SIEVE_BITS = 24  # of a pattern hash, looked up in a bit table before a clean row's pattern is counted
SAMPLE_ROWS = 20_000  # distinct vote vectors for the label model and the classifier; of more, a weighted sample
COVERED = 3  # toxic texts that a voter has to explain beyond earlier voters
MERGE_PATTERNS = 2_000_000  # patterns of scans held before they are passed on
PRECISION = 0.9
LABEL_ACCURACY = 0.98
THRESHOLD = 0.7
LABEL_TRUST = 0.05  # share of the rows that stands behind LABEL_ACCURACY before the label's own rates are estimated
TIED = 0.1  # correlation within the classes from which two voters are tied
MOST_CLEAN_VOTERS = 8
CLEAN_SHARE, CLEAN_RATIO = 0.02, 3.0  # of clean rows, and times rarer in toxic ones, for a voter for clean
#: words of plain abuse; one voter a language
LEXICONS = {
    "en": ("idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "loser", "losers", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumb", "vermin"),
    "de": ("idiot", "idioten", "dumm", "dummkopf", "trottel", "abschaum", "versager", "widerlich", "wertlos", "schwachkopf", "ungeziefer"),
    "es": ("idiota", "idiotas", "estúpido", "estúpida", "imbécil", "escoria", "basura", "asqueroso", "patético", "inútil", "payaso"),
    "fr": ("idiot", "idiote", "stupide", "imbécile", "crétin", "ordure", "minable", "pathétique", "dégoûtant", "bouffon", "vermine"),
}

_WHOLE = np.uint64(0x5851F42D4C957F2D)


def _patterns(words: textkit.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pattern hash, row) of whole words and of word beginnings, one kind at a time."""
    row = words.row_of
    yield words.hashes() ^ _WHOLE, row
    size = words.ends - words.starts
    for n in PREFIXES:
        long = size >= n
        starts = words.starts[long]
        yield words.hash_range(starts, starts + n), row[long]


def lexicon_hashes() -> list[np.ndarray]:
    scans = [next(iter(textkit.scan(pa.array([" ".join(words)]), textkit.LETTERS))) for words in LEXICONS.values()]
    return [np.unique(w.hashes() ^ _WHOLE) for w in scans]


class _Finder:
    """Which of a sorted set of patterns occur where; a small bit table turns most words away first."""

    def __init__(self, patterns: np.ndarray):
        self.patterns = np.unique(patterns)
        self.low = np.uint64((1 << max(20, int(len(self.patterns)).bit_length() + 3)) - 1)
        self.maybe = np.zeros(int(self.low) + 1, dtype=bool)
        self.maybe[(self.patterns & self.low).astype(np.int64)] = True

    def find(self, words: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
        """(row, place of the pattern) of every occurrence."""
        rows, places = [], []
        for h, row in _patterns(words):
            some = np.flatnonzero(self.maybe[(h & self.low).astype(np.int64)])
            if len(some) and len(self.patterns):
                at = np.minimum(np.searchsorted(self.patterns, h[some]), len(self.patterns) - 1)
                hit = self.patterns[at] == h[some]
                rows.append(row[some[hit]])
                places.append(at[hit])
        none = np.zeros(0, np.int64)
        return (np.concatenate(rows), np.concatenate(places)) if rows else (none, none)


def _count(batches: Iterator[pa.RecordBatch], sieve: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of a task in which each pattern occurs; all patterns, or those whose low bits the sieve has."""
    parts, held = [], 0
    for batch in batches:
        for words in textkit.scan(batch.column(0), textkit.LETTERS):
            kinds = []
            for h, row in _patterns(words):
                if sieve is not None:
                    low = h & np.uint64((1 << SIEVE_BITS) - 1)
                    some = np.flatnonzero(sieve[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1))
                    h, row = h[some], row[some]
                kinds.append(_once(h, row))
            parts.append(np.unique(np.concatenate(kinds), return_counts=True))
            held += len(parts[-1][0])
            if held > MERGE_PATTERNS:
                yield _merged(parts)
                parts, held = [], 0
    if parts:
        yield _merged(parts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    hashes, n = (np.concatenate(x) for x in zip(*parts))
    hashes, place = np.unique(hashes, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(np.bincount(place, n, len(hashes)).astype(np.int64))], names=["pattern", "n"])


def _once(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The hashes, each once a row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh]


@dataclass
class Mined:
    """Patterns that mark toxic rows far beyond chance, the share of their rows that are toxic, and patterns that mark clean rows."""

    patterns: np.ndarray
    precision: np.ndarray
    telling: np.ndarray


def _sieve(patterns: DataFrame) -> np.ndarray:
    """A bit table of the patterns' low bits, 2**SIEVE_BITS bits however many patterns there are."""
    low = F.col("pattern").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    words = patterns.groupBy(F.shiftright(low, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(pattern & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def mine(labelled: DataFrame, scratch: Scratch) -> Mined:
    """Patterns of labelled (text, toxic), counted over all rows; only the telling ones reach the driver."""
    toxic, clean = labelled.where("toxic = 1"), labelled.where("toxic = 0")
    sizes = labelled.agg(F.sum(F.col("toxic")).alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not sizes["t"] or sizes["t"] == sizes["n"]:
        return Mined(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64))
    n_clean = sizes["n"] - sizes["t"]
    tried = toxic.select("text").mapInArrow(lambda it: _count(it, None), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("t"))
    tried = scratch.keep(tried.where("t >= 3"), "tried")
    least = max(3, int(np.ceil((np.log(max(1, tried.count())) + 4) / np.log(sizes["n"] / sizes["t"]))))
    frequent = tried.where(F.col("t") >= least)
    held = labelled.sparkSession.sparkContext.broadcast(_sieve(frequent))
    found = clean.select("text").mapInArrow(lambda it: _count(it, held.value), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    in_clean, in_toxic = F.col("n") / n_clean, F.col("t") / sizes["t"]
    both = frequent.join(found, "pattern", "left").select("pattern", "t", F.coalesce("n", F.lit(0)).alias("n")).select(
        "pattern", "n", (F.col("t") / (F.col("t") + F.col("n"))).alias("precision"), ((in_clean >= CLEAN_SHARE) & (in_clean >= CLEAN_RATIO * in_toxic)).alias("telling"))
    got = both.where((F.col("precision") >= PRECISION) | F.col("telling")).toArrow()
    hashes, n, precision, telling = (got.column(c).to_numpy() for c in ("pattern", "n", "precision", "telling"))
    hashes = hashes.view(np.uint64)
    marks = np.flatnonzero(precision >= PRECISION)
    marks = marks[np.argsort(hashes[marks])]
    clear = np.flatnonzero(telling)
    clear = clear[np.lexsort((hashes[clear], -n[clear]))][:MOST_CLEAN_VOTERS]
    return Mined(hashes[marks], precision[marks], hashes[clear])


def _occurrences(batches: Iterator[pa.RecordBatch], finder: _Finder) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in textkit.scan(batch.column(0), textkit.LETTERS):
            row, place = finder.find(words)
            pairs = np.unique(row * max(1, len(finder.patterns)) + place)
            row, place = pairs // max(1, len(finder.patterns)), pairs % max(1, len(finder.patterns))
            edges = np.searchsorted(row, np.arange(len(words.per_row) + 1))
            lists = [place[edges[r] : edges[r + 1]].astype(np.int32) for r in range(len(words.per_row))]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(words.first, len(words.per_row)), pa.array(lists, pa.list_(pa.int32()))], names=["digest", "places"])


def _tally(batches: Iterator[pa.RecordBatch], done: np.ndarray, order: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Texts of a task that hold no pattern that is done, by pattern: by each that they hold, or by the first of them in order."""
    total = np.zeros(len(done))
    rank = None if order is None else np.argsort(order)
    for batch in batches:
        if batch.num_rows:
            at = batch.column(0).offsets.to_numpy()
            held, at = batch.column(0).values.to_numpy()[at[0] : at[-1]], at - at[0]
            n = batch.column(1).to_numpy() * ~np.logical_or.reduceat(done[held], at[:-1])
            if rank is None:
                total += np.bincount(held, np.repeat(n, np.diff(at)), len(done))
            else:
                total += np.bincount(order[np.minimum.reduceat(rank[held], at[:-1])], n, len(done))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], names=["p", "n"])


def _cover(lists: DataFrame, size: int) -> tuple[list[int], list[int]]:
    """(patterns to vote alone, patterns to vote in pools) that explain most texts not yet explained; lists has (places, n texts with them).

    One after another up to MOST_VOTERS. Then every text not yet explained elects the best of its patterns, and all
    that COVERED texts elect are taken together, until none is: the best pattern of all is elected by all its texts, so
    each election explains some.
    """

    def tally(done: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
        got = lists.select("places", "n").mapInArrow(lambda it: _tally(it, done, order), "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size, np.int64)
        out[got.column("p").to_numpy()] = got.column("n").to_numpy()
        return out

    done = np.zeros(size, bool)
    support = left = tally(done)
    alone: list[int] = []
    while left.max(initial=0) >= COVERED and len(alone) < MOST_VOTERS:
        alone.append(int(np.lexsort((np.arange(size), -support, -left))[0]))
        done[alone[-1]] = True
        left = tally(done)
    pooled: list[int] = []
    while left.max(initial=0) >= COVERED:
        elected = np.flatnonzero(tally(done, np.lexsort((np.arange(size), -support, -left))) >= COVERED)
        pooled += elected.tolist()
        done[elected] = True
        left = tally(done)
    # voters beside the cover: further patterns by support, so that votes overlap and can be compared
    rest = [int(p) for p in np.lexsort((np.arange(size), -support)) if not done[p]]
    return alone + rest[: max(0, min(MOST_VOTERS - len(alone), len(alone)))], pooled


def _forest(correlation: np.ndarray) -> np.ndarray:
    """Each voter's neighbour in a maximum spanning forest of correlations from TIED on; itself for the first of a tree."""
    k = len(correlation)
    parent, strength = np.arange(k), np.full(k, TIED)
    waiting = set(range(k))
    while waiting:
        v = max(sorted(waiting), key=lambda i: (strength[i] if parent[i] != i else 0, -i))
        waiting.remove(v)
        for i in waiting:
            if abs(correlation[v, i]) > strength[i]:
                parent[i], strength[i] = v, abs(correlation[v, i])
    return parent


@dataclass
class Model:
    """Voters, the label model's estimates and the classifier."""

    voters: list[np.ndarray]
    fires: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))  # P(voter fires | clean), P(. | toxic)
    label_rates: np.ndarray = field(default_factory=lambda: np.array([1 - LABEL_ACCURACY, LABEL_ACCURACY]))  # P(label 1 | clean), P(. | toxic)
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    given: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 0)))  # P(voter fires | class, whether its neighbour fires)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        patterns = np.concatenate(self.voters)
        self.finder = _Finder(patterns)
        self.owner = np.zeros((len(self.finder.patterns), len(self.voters)), bool)
        for v, own in enumerate(self.voters):
            self.owner[np.searchsorted(self.finder.patterns, own), v] = True

    def votes(self, words: textkit.Words) -> np.ndarray:
        row, place = self.finder.find(words)
        fired = np.zeros((len(words.per_row), len(self.voters)), bool)
        for v in range(len(self.voters)):
            fired[row[self.owner[place, v]], v] = True
        return fired

    def posterior(self, votes: np.ndarray, prior: float, label: np.ndarray) -> np.ndarray:
        """P(toxic | votes, label) under the forest."""
        beside = votes[:, self.parent]
        clean, toxic = (np.where(beside, rates[1], rates[0]) for rates in self.given)
        each = np.where(votes, np.log(toxic / clean), np.log((1 - toxic) / (1 - clean)))
        said = np.where(label == 1, np.log(self.label_rates[1] / self.label_rates[0]), np.log((1 - self.label_rates[1]) / (1 - self.label_rates[0])))
        return 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + each.sum(axis=1) + said, -40, 40)))

    def learn(self, votes: np.ndarray, label: np.ndarray, times: np.ndarray, rounds: int = 30) -> None:
        """Expectation-maximisation for voters and label, then the classifier on posterior labels; each row counts `times`."""
        x = votes.astype(np.float64)
        q = np.where(label == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
        trust = LABEL_TRUST * times.sum()
        for _ in range(rounds):
            prior = float(np.clip(np.average(q, weights=times), 1e-4, 1 - 1e-4))
            both = np.stack([1 - q, q])
            mass = (both * times).sum(axis=1)
            self.fires = np.clip(((both * times) @ x + 0.05) / (mass[:, None] + 1), 1e-4, 1 - 1e-4)
            believed = np.array([1 - LABEL_ACCURACY, LABEL_ACCURACY])
            self.label_rates = np.clip(((both * times) @ (label == 1) + trust * believed) / (mass + trust), 1e-4, 1 - 1e-4)
            rest = x - (both.T @ self.fires)
            spread = np.sqrt(times @ rest**2) + 1e-9
            self.correlation = (rest.T @ (rest * times[:, None])) / np.outer(spread, spread)
            np.fill_diagonal(self.correlation, 0)
            self.parent = _forest(self.correlation)
            self.given = np.stack([self._rates(x, w * times, fires) for w, fires in zip(both, self.fires)])
            q = self.posterior(votes, prior, label)
        given = _features(votes)
        w = np.zeros(given.shape[1])
        for _ in range(40):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(given @ w, -30, 30)))
            curve = given.T @ (given * (times * (p * (1 - p) + 1e-6))[:, None]) + 0.05 * np.eye(len(w))
            move = np.linalg.solve(curve, given.T @ (times * (q - p)) - 0.05 * w)
            w += move
            if np.abs(move).max() < 1e-6:
                break
        self.weights = w

    def _rates(self, x: np.ndarray, weight: np.ndarray, fires: np.ndarray) -> np.ndarray:
        """(2, voters): how often each voter fires where its neighbour does not and where it does, drawn towards its own rate."""
        together = np.einsum("ij,ij,i->j", x, x[:, self.parent], weight)
        beside, own = weight @ x[:, self.parent], weight @ x
        rates = np.stack([(own - together + fires) / (weight.sum() - beside + 1), (together + fires) / (beside + 1)])
        alone = self.parent == np.arange(x.shape[1])
        return np.clip(np.where(alone[None, :], fires[None, :], rates), 1e-4, 1 - 1e-4)

    def scores(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(votes) @ self.weights, -30, 30)))


def _features(votes: np.ndarray) -> np.ndarray:
    fired = votes.sum(axis=1)
    return np.column_stack([votes.astype(np.float64), fired > 0, np.log1p(fired), np.ones(len(votes))])


def _vote_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in textkit.scan(batch.column(0), textkit.LETTERS):
            n = len(words.per_row)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(words.first, n), pa.array([v.tobytes() for v in model.votes(words)], pa.binary())], names=["toxic", "votes"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, remainder: int = 1) -> Model:
    """Learn from labels of rows that are not held out; rows without a 0/1 label only get scores."""
    with Scratch(docs.sparkSession) as held:
        return _fitted(docs, labels, id_col, text_col, modulus, remainder, held)


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, modulus: int, remainder: int, scratch: Scratch) -> Model:
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isin(0, 1) & ~held_out(id_col, modulus, remainder)).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col, modulus, remainder)).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labelled = scratch.keep(texts.join(marked.hint("shuffle_hash"), "_id").select("text", "toxic"), "labelled")
    mined = mine(labelled, scratch)
    patterns, telling = mined.patterns, mined.telling
    voters = lexicon_hashes()
    lexicons = len(voters)
    if len(patterns):
        held = spark.sparkContext.broadcast(_Finder(patterns))
        found = labelled.where("toxic = 1").select("text", F.xxhash64("text").alias("digest")).mapInArrow(lambda it: _occurrences(it, held.value), "digest long, places array<int>")
        lists = scratch.keep(found.where(F.size("places") > 0).dropDuplicates(["digest"]).groupBy("places").agg(F.count(F.lit(1)).alias("n")), "places")
        alone, pooled = _cover(lists, len(patterns))
        voters += [patterns[p : p + 1] for p in alone]
        band = np.digitize(mined.precision[pooled], POOLS) if pooled else np.zeros(0, int)
        voters += [patterns[np.array(pooled)[band == b]] for b in np.unique(band)]
    voters += [telling[p : p + 1] for p in range(len(telling))]
    model = Model(voters)
    sent = spark.sparkContext.broadcast(model)
    votes = labelled.mapInArrow(lambda it: _vote_rows(it, sent.value), "toxic int, votes binary")
    got, times = _sampled(votes.groupBy("toxic", "votes").agg(F.count(F.lit(1)).alias("n")))
    if not got.num_rows:  # nothing to learn from: the lexicons alone decide
        model.weights = np.concatenate([np.full(lexicons, 4.0), np.zeros(len(voters) - lexicons), [0.0, 0.0, -3.0]])
        return model
    fired = np.frombuffer(textkit.joined(got.column("votes")), dtype=bool).reshape(got.num_rows, len(voters))
    model.learn(fired, got.column("toxic").to_numpy(), times)
    return model


def _sampled(vectors: DataFrame) -> tuple[pa.Table, np.ndarray]:
    """(distinct vote vectors, rows that each stands for): all of them, or a priority sample of SAMPLE_ROWS.

    A vector of n rows gets priority n / u, u its hash as a number in (0, 1]; those of highest priority stay, each for
    the larger of n and the first priority left out. So sums over the sample are unbiased, and rare vectors have
    their share.
    """
    u = (F.pmod(F.xxhash64("toxic", "votes"), F.lit(1 << 52)) + 1) / float(1 << 52)
    got = vectors.withColumn("priority", F.col("n") / u).orderBy(F.desc("priority"), "toxic", "votes").limit(SAMPLE_ROWS + 1).toArrow()
    beyond = got.column("priority")[SAMPLE_ROWS].as_py() if got.num_rows > SAMPLE_ROWS else 0.0
    got = got.slice(0, SAMPLE_ROWS).sort_by([("n", "descending"), ("toxic", "ascending"), ("votes", "ascending")])
    return got, np.maximum(got.column("n").to_numpy(), beyond).astype(np.float64)


def _score_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [model.scores(model.votes(w)) for w in textkit.scan(batch.column(0), textkit.LETTERS)]
        score = np.concatenate(parts) if parts else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], names=[*batch.schema.names[1:], "score"])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from THRESHOLD on) to the kept columns, in place of kept ones so named; whole texts are read."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    given = docs.select(F.col(f"`{text_col}`").alias(free_name(docs, "text")), *[F.col(f"`{c}`") for c in keep])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema[1:])
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = given.mapInArrow(lambda it: _score_rows(it, held.value), f"{schema}score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Only the text is an input of a score. Defined cases: null and wordless texts have no vote and get the score of
    such a row; a null id is scored and not held out but gives no training row; of several labels of one id the
    largest counts, labels other than 0 and 1 do not; without labels the fixed lexicons decide alone; repeated rows
    each give a row; an empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 3, 1).alias("held_out"), F.col(text_col).alias("text"))
    return score(rows, model, "text", ["doc_id", "held_out"])
