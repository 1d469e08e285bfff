"""Language identification with blended-spectrum presence kernels and Nystroem landmarks.

A text's features are the character n-grams (n = 1..ORDER, over lower-cased letters, every run of other characters
read as one gap) that occur in it; only presence counts. The kernel of two texts is |A and B| / sqrt(|A| |B|).
A bounded sample of labelled texts gives landmarks, and K(x, landmarks) K(landmarks, landmarks)^-1/2 maps a text to
a vector on which one-versus-rest kernel ridge regression is linear. Texts are scored in batches: one matrix product
of the presence matrix with the landmarks' presence, one with the mapped regression weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import textkit
from tessella.llm.common import free_name, held_out

ORDER = 3
BITS = 16  # n-grams are told apart by so many hash bits
SAMPLE_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 40
CHOICE_PARTS = (1024, 16, 1)  # groups of a language, one choice after another
RIDGE = 0.05
SHARPNESS = 8.0
UNDETERMINED = "und"
_GAP = 0


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for block in range(0, 0x110000, 0x1000):
        for c in range(block, block + 0x1000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
    return table


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte offset of each) of valid UTF-8."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.uint32)
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    follow = [(pad[lead + k] & 0x3F).astype(np.uint32) for k in (1, 2, 3)]
    points = np.where(b < 0x80, b, np.where(b < 0xE0, ((b & 0x1F) << 6) | follow[0], np.where(b < 0xF0, ((b & 0x0F) << 12) | (follow[0] << 6) | follow[1], ((b & 0x07) << 18) | (follow[0] << 12) | (follow[1] << 6) | follow[2])))
    return points, lead


def presence(column: pa.Array, rows_at_once: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, presence of each hashed n-gram, whether the text has a letter), some rows at a time."""
    data, offsets = textkit.text_buffer(column)
    alphabet = _alphabet()
    first = 0
    while first < len(offsets) - 1:
        last = min(first + rows_at_once, len(offsets) - 1)
        seen, lettered = np.zeros((last - first) << BITS, dtype=bool), np.zeros(last - first, dtype=bool)
        for lo, hi in textkit.row_slices(offsets[first : last + 1]):
            _mark(data, offsets, first, lo, hi, alphabet, seen, lettered)
        yield first, seen.reshape(last - first, 1 << BITS), lettered
        first = last


def _mark(data, offsets, base, lo, hi, alphabet, seen, lettered) -> None:
    begin, end = offsets[base + lo], offsets[base + hi]
    points, at = _code_points(data[begin:end])
    letters = alphabet[points]
    row = np.searchsorted(offsets[base + lo : base + hi + 1] - begin, at, side="right") - 1 + lo
    kept = np.ones(len(letters), dtype=bool)
    kept[1:] = (letters[1:] != _GAP) | (letters[:-1] != _GAP) | (row[1:] != row[:-1])
    letters, row = letters[kept], row[kept]
    lettered[row[letters != _GAP]] = True
    place = row.astype(np.int64) << BITS
    code = np.zeros(len(letters), dtype=np.uint64)
    for n in range(1, ORDER + 1):
        m = len(letters) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x9E3779B97F4A7C15) + letters[n - 1 :].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)
        inside = row[:m] == row[n - 1 :]
        hashed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
        seen[place[:m][inside] + hashed[inside].astype(np.int64)] = True


class Model:
    """Landmark n-grams and the weights that turn kernel values into one score for each language."""

    def __init__(self, bits: np.ndarray, langs: list[str]):
        """bits: packed presence of n-grams in the sample texts."""
        self.langs = sorted(set(langs))
        target = np.array([self.langs.index(x) for x in langs])
        places = np.concatenate([np.flatnonzero(target == k)[:LANDMARKS_PER_LANGUAGE] for k in range(len(self.langs))])
        marks = np.unpackbits(bits[places], axis=1).astype(bool)
        self.columns = np.flatnonzero(marks.any(axis=0))
        self.marks = marks[:, self.columns].astype(np.float32)
        self.norms = np.sqrt(np.maximum(1, marks.sum(axis=1)))
        values, vectors = np.linalg.eigh(self._kernel(marks).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        mapped = np.concatenate([self._kernel(np.unpackbits(bits[i : i + 64], axis=1).astype(bool)) for i in range(0, len(bits), 64)]) @ root
        goal = np.where(target[:, None] == np.arange(len(self.langs))[None, :], 1.0, -1.0)
        weight = 1.0 / np.bincount(target, minlength=len(self.langs))[target]
        weight *= len(target) / weight.sum()
        given = np.column_stack([mapped, np.ones(len(mapped))])
        gram = given.T @ (given * weight[:, None]) + RIDGE * np.eye(given.shape[1])
        solved = np.linalg.solve(gram, given.T @ (goal * weight[:, None]))
        self.weights, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1]

    def _kernel(self, seen: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(1, np.count_nonzero(seen, axis=1)))
        return (seen[:, self.columns].astype(np.float32) @ self.marks.T) / (own[:, None] * self.norms[None, :])

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """Probabilities of the languages, rows of batch products."""
        raw = (self._kernel(seen) @ self.weights + self.bias) * (SHARPNESS / 2)
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _packed_presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, seen, _ in presence(batch.column(1)):
            bits = pa.array([x.tobytes() for x in np.packbits(seen, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(seen)) for c in (0, 2)), bits], names=["lang", "rank", "bits"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, modulus: int = 4, remainder: int = 2) -> Model | None:
    """Learn from text and lang of at most per_language rows of each language, chosen by id hash among training rows.

    A sample text has a letter and is read whole; only its n-grams' presence (8 KB) leaves the executors. None if there
    is no such row.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col, modulus, remainder)).where(F.col(text_col).rlike(r"\p{L}"))
    named = usable.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # rows equal in id and text are one choice; the choice holds no text; the best of many parts meet in few, then in one
    chosen = named.select("lang", "id", "hash").distinct()
    for parts in CHOICE_PARTS:
        group = W.partitionBy("lang", F.pmod(F.xxhash64("hash", "id"), F.lit(parts)))
        chosen = chosen.withColumn("rank", F.row_number().over(group.orderBy(F.xxhash64("id"), "id", "hash"))).where(F.col("rank") <= per_language)
    chosen = chosen.toDF("_lang", "_id", "_hash", "rank")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")) & (F.col("lang") == F.col("_lang"))
    sample = named.join(F.broadcast(chosen), same).select("lang", "text", "rank").mapInArrow(_packed_presence, "lang string, rank int, bits binary")  # per_language rows a language
    got = sample.dropDuplicates(["lang", "rank"]).toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    if not got.num_rows:
        return None
    return Model(np.frombuffer(textkit.joined(got.column("bits")), np.uint8).reshape(got.num_rows, -1), got.column("lang").to_pylist())


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, best = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
        for first, seen, lettered in presence(batch.column(0)):
            rows = np.flatnonzero(lettered)
            if model is None or not len(rows):
                continue
            p = model.scores(seen[rows])
            top = p.argmax(axis=1)
            for r, k, v in zip(rows + first, top, p.max(axis=1)):
                langs[r], best[r] = model.langs[k], v
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs), pa.array(best)], names=[*batch.schema.names[1:], "lang_pred", "score"])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score (0 to 1) to the kept columns of every row, in place of kept ones so named; the whole text is read.

    Defined cases: lang_pred is `und` with score 0 where the text is null or has no letter, or nothing could be
    learned; repeated rows each give a row; an empty table gives no rows. Only the text is an input.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    given = docs.select(F.col(f"`{text_col}`").alias(free_name(docs, "text")), *[F.col(f"`{c}`") for c in keep])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema[1:])
    held = docs.sparkSession.sparkContext.broadcast(model)
    return given.mapInArrow(lambda it: _predict(it, held.value), f"{schema}lang_pred string, score double")


def detect_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out."""
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 4, 2).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model, "text", ["doc_id", "held_out"])
