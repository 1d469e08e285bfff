"""Offset-mapped token counts: whole texts are encoded once and tokens are attributed to sections by their spans.

A byte-level encoder runs over the whole document, so tokens are those of the document and not of its cut pieces.
Each token's byte span comes from its bytes; the span is joined with the section intervals by position. A token that
crosses a section boundary is allocated by rule: `first` (the section of its first byte), `last`, or `most` (the section
with most of its bytes, the earlier one on ties).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textkit

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("first", "last", "most")
#: the splitting pattern that belongs to the byte-level vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SCHEMA = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"


@lru_cache(maxsize=2)
def _encoder(ranks_bytes: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_bytes.splitlines() if line)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("tessella", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def section_edges(data: np.ndarray) -> np.ndarray:
    """Byte starts of the sections (lines, each with its line end), with the end of the text last."""
    cuts = np.flatnonzero(data == 10) + 1
    edges = np.concatenate(([0], cuts, [len(data)]))
    return np.unique(edges) if len(data) else np.zeros(2, np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary) for token and section byte intervals."""
    last = len(edges) - 2
    a = np.minimum(np.searchsorted(edges, starts, side="right") - 1, last)
    b = np.minimum(np.searchsorted(edges, np.maximum(ends - 1, starts), side="right") - 1, last)
    if rule == "first":
        return a, a != b
    if rule == "last":
        return b, a != b
    home = a.copy()
    for t in np.flatnonzero(a != b):
        parts = [min(ends[t], edges[s + 1]) - max(starts[t], edges[s]) for s in range(a[t], b[t] + 1)]
        home[t] = a[t] + int(np.argmax(parts))
    return home, a != b


def _attribute(batches: Iterator[pa.RecordBatch], ranks: bytes, rule: str) -> Iterator[pa.RecordBatch]:
    encoder, sizes = _encoder(ranks)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        data, offsets = textkit.text_buffer(texts)
        out: list[list] = [[] for _ in range(7)]
        for r in range(batch.num_rows):
            own = data[offsets[r] : offsets[r + 1]]
            edges = section_edges(own)
            tokens = np.asarray(encoder.encode_ordinary(own.tobytes().decode("utf-8")), dtype=np.int64)
            ends = np.cumsum(sizes[tokens])
            home, crossing = allocate(ends - sizes[tokens], ends, edges, rule)
            n = len(edges) - 1
            chars = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))[edges]
            for column, values in zip(out, ([r] * n, np.arange(n), chars[:-1], chars[1:], np.bincount(home, minlength=n), np.bincount(home[crossing], minlength=n), [len(tokens)] * n)):
                column.append(np.asarray(values))
            if sum(map(len, out[0])) > 100_000:
                yield _batch(ids, out)
                out = [[] for _ in range(7)]
        if out[0]:
            yield _batch(ids, out)


def _batch(ids: pa.Array, out: list[list]) -> pa.RecordBatch:
    row, section, *rest = (np.concatenate(c) for c in out)
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(section.astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in rest)], names=names)


def section_tokens(docs: DataFrame, ranks_path: str = DEFAULT_RANKS, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section of each document: character span, n_tokens by the rule, n_crossing of them, doc_tokens.

    Sections are lines with their line ends; n_tokens sums to doc_tokens over a document. Defined cases: null or
    empty text is one empty section without tokens; repeated rows each give their rows; null ids are kept; an empty
    table gives no rows; other columns are ignored; texts of any length are encoded whole.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(lambda it: _attribute(it, held.value, rule), _SCHEMA)
