"""Corpus ingest: path metadata, routing, sections, tables, text chunks, numbering, storage."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.sources import chunkstore

SKIP_WORDS = "answer|appendix|appendices"
LEAST_CHARS = 5000
CHUNK_CHARS = 5000
CONTEXT_CHARS = 500
_SEPARATOR = r"^\s*\|[\s:\-|]+\|?\s*$"


def stem_of(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def path_metadata(rows: DataFrame, path: str = "path") -> DataFrame:
    """class_level, subject, part, chapter_number, chapter_name and pdf_name from a path; the last matching folder wins."""
    parts = F.split(path, "/")
    levels = F.filter(parts, lambda p: p.rlike(r"(?i)^Class\s+[0-9]+"))
    rests = F.transform(F.filter(parts, lambda p: p.rlike(r"(?i)Class\s+[0-9]+\s+")), lambda p: F.trim(F.regexp_extract(p, r"(?i)Class\s+[0-9]+\s+(.*)", 1)))
    numbered = r"(?i)(part\s*[0-9]+|part\s*[ivx]+)"
    rest = F.coalesce(F.try_element_at(rests, F.lit(-1)), F.lit(""))
    with_part = F.filter(rests, lambda p: p.rlike(numbered))
    stem = stem_of(F.col(path))
    number = F.regexp_extract(stem, r"^([0-9]+)[.\-_\s]+(.*)", 1)
    name = F.trim(F.translate(F.regexp_extract(stem, r"^([0-9]+)[.\-_\s]+(.*)", 2), "-_", "  "))
    return rows.withColumns(
        {
            "class_level": F.regexp_extract(F.coalesce(F.try_element_at(levels, F.lit(-1)), F.lit("")), r"(?i)^Class\s+([0-9]+)", 1),
            "subject": F.trim(F.regexp_replace(rest, numbered + ".*$", "")),
            "part": F.trim(F.regexp_extract(F.coalesce(F.try_element_at(with_part, F.lit(-1)), F.lit("")), numbered, 1)),
            "chapter_number": F.when(number == "", 0).otherwise(number.try_cast("int")),
            "chapter_name": F.when(number == "", stem).otherwise(name),
            "pdf_name": stem,
        }
    )


def skip_documents(rows: DataFrame, stem: str = "pdf_name") -> DataFrame:
    """Without answer keys and appendices, told by a substring of the name."""
    return rows.where(~F.lower(stem).rlike(SKIP_WORDS))


def incremental_ingest(sources: DataFrame, store: DataFrame, force: bool = False) -> DataFrame:
    """Sources whose pdf_name is not stored yet; equal names of different folders count as one."""
    return sources if force else sources.join(store.select("pdf_name").distinct(), "pdf_name", "left_anti")


def low_yield_route(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("route", F.when(F.length(F.coalesce(text, F.lit(""))) < LEAST_CHARS, "extract_again").otherwise("chunk"))


def split_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, section_pos, section, body): text cut at level-2 headers; sections without a body are left out."""
    pieces = F.split(F.regexp_replace(F.concat(F.lit("\n"), text), "\n## ", "\u0001"), "\u0001")
    rows = docs.select("doc_id", F.posexplode(pieces).alias("section_pos", "piece"))
    body = F.when(F.col("section_pos") == 0, F.col("piece")).otherwise(F.regexp_replace("piece", r"^[^\n]*\n?", ""))
    section = F.when(F.col("section_pos") == 0, "").otherwise(F.trim(F.regexp_extract("piece", r"^([^\n]*)", 1)))
    return rows.select("doc_id", "section_pos", section.alias("section"), body.alias("body")).where(F.col("body").rlike(r"\S"))


def line_blocks(sections: DataFrame) -> DataFrame:
    """(doc_id, section_pos, section, block_pos, is_table, lines): runs of table lines and of other lines, in order."""
    order = W.partitionBy("doc_id", "section_pos").orderBy("line_pos")
    lines = sections.select("doc_id", "section_pos", "section", F.posexplode(F.split("body", "\n")).alias("line_pos", "line"))
    lines = lines.withColumn("is_table", F.col("line").rlike(r"^\s*\|"))
    turn = F.coalesce((F.col("is_table") != F.lag("is_table").over(order)).cast("int"), F.lit(0))
    lines = lines.withColumn("turn", turn).withColumn("block_pos", F.sum("turn").over(order.rowsBetween(W.unboundedPreceding, 0)))
    grouped = lines.groupBy("doc_id", "section_pos", "section", "block_pos", "is_table").agg(F.array_sort(F.collect_list(F.struct("line_pos", "line"))).alias("l"))
    return grouped.select("doc_id", "section_pos", "section", "block_pos", "is_table", F.transform("l", lambda x: x["line"]).alias("lines"))


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def explode_table_rows(blocks: DataFrame) -> DataFrame:
    """Chunks of table blocks: one for each data row, or the block itself if it has none."""
    rows = F.col("lines")
    second = F.coalesce(F.try_element_at(rows, F.lit(2)).rlike(_SEPARATOR), F.lit(False))
    plain = ~rows[0].rlike(_SEPARATOR) & (F.size(_cells(rows[0])) > 2)
    table = blocks.where("is_table").withColumn("header", F.when(second | plain, _cells(rows[0]))).withColumn("skip", F.when(second, 2).when(plain, 1).otherwise(0))
    data = F.filter(F.slice(rows, F.col("skip") + 1, F.greatest(F.lit(1), F.size(rows))), lambda r: ~r.rlike(_SEPARATOR))
    filled = lambda cells: F.array_join(F.filter(cells, lambda c: c != ""), " | ")

    def content(row: Column) -> Column:
        cells = _cells(row)
        named = F.filter(F.zip_with(F.col("header"), cells, lambda h, v: F.when((h != "") & (v != ""), F.concat(h, F.lit(": "), v))), lambda x: x.isNotNull())
        return F.when(F.col("header").isNotNull() & (F.size("header") == F.size(cells)) & (F.size(named) > 0), F.array_join(named, " | ")).otherwise(filled(cells))

    table = table.withColumn("texts", F.filter(F.transform(data, content), lambda c: F.trim(c) != ""))
    found = table.select("doc_id", "section_pos", "section", "block_pos", F.posexplode("texts").alias("row_pos", "content")).withColumn("chunk_type", F.lit("table_row"))
    whole = table.where("size(texts) = 0").select("doc_id", "section_pos", "section", "block_pos", F.lit(0).alias("row_pos"), F.array_join("lines", "\n").alias("content"), F.lit("table").alias("chunk_type"))
    return found.unionByName(whole)


def pack_text_chunks(blocks: DataFrame) -> DataFrame:
    """Chunks of other lines: each trimmed line ends in a mark and a space; a chunk closes at CHUNK_CHARS."""
    pack = F.expr(
        f"""aggregate(filter(transform(lines, l -> regexp_replace(l, '^\\\\s+|\\\\s+$', '')), l -> l <> ''), named_struct('buf', '', 'out', cast(array() AS array<string>)),
              (a, l) -> CASE WHEN length(a.buf) + length(l) + CASE WHEN right(l, 1) IN ('.', '!', '?', ':', ';', ',') THEN 1 ELSE 2 END >= {CHUNK_CHARS}
                THEN named_struct('buf', '', 'out', array_append(a.out, a.buf || l || CASE WHEN right(l, 1) IN ('.', '!', '?', ':', ';', ',') THEN ' ' ELSE '. ' END))
                ELSE named_struct('buf', a.buf || l || CASE WHEN right(l, 1) IN ('.', '!', '?', ':', ';', ',') THEN ' ' ELSE '. ' END, 'out', a.out) END,
              a -> CASE WHEN a.buf = '' THEN a.out ELSE array_append(a.out, a.buf) END)"""
    )
    rows = blocks.where("NOT is_table").select("doc_id", "section_pos", "section", "block_pos", F.posexplode(pack).alias("row_pos", "content"))
    return rows.withColumn("content", F.concat(F.lit("\n"), "content")).withColumn("chunk_type", F.lit("text"))


def number_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id 1..n over all chunks of a document, in order."""
    return chunks.withColumn("chunk_id", F.row_number().over(W.partitionBy("doc_id").orderBy("section_pos", "block_pos", "row_pos")))


def previous_context(chunks: DataFrame) -> DataFrame:
    """previous_text: the end of the chunk before, within the document."""
    before = F.lag("content").over(W.partitionBy("doc_id").orderBy("chunk_id"))
    return chunks.withColumn("previous_text", F.coalesce(F.right(before, F.lit(CONTEXT_CHARS)), F.lit("")))


def embedding_text(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("embedding_text", F.concat(F.lit("Section: "), "section", F.lit("\n\nContent: "), "content"))


def chunk_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Numbered chunks with their previous context, for whole documents."""
    blocks = line_blocks(split_sections(docs, text))
    return previous_context(number_chunks(pack_text_chunks(blocks).unionByName(explode_table_rows(blocks))))


def hash_encoder(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Feature-hashed token counts of each text: the shipped encoder for embed_batch, where a neural one can stand."""
    out = []
    for text in texts:
        row = [0.0] * dim
        for token, n in Counter(re.findall("[a-z0-9]+", text.lower())).items():
            row[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += n
        out.append(row)
    return out


def embed_batch(chunks: DataFrame, encode, text: str = "embedding_text", batch: int = 64) -> DataFrame:
    """Any encoder (list of texts -> rows of floats) over Arrow batches in slices; vectors come out L2-normalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                v = np.asarray(encode(part.column(text).to_pylist()), dtype=np.float64)
                v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, f"{schema}, embedding array<float>")


def keyed_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that have an embedding, with a stable point id, so that a second ingest replaces and not repeats."""
    return chunks.where("embedding IS NOT NULL").withColumn("point_id", F.sha2(F.concat_ws(":", "pdf_name", F.col("chunk_id").cast("string")), 256))


PARTITIONS = ["subject", "class_level"]


def write_chunks(chunks: DataFrame, path: str) -> str:
    """Store chunks by subject and class, as one batch that replaces all that the store holds of the batch's documents.

    Documents replace their chunks wherever those lie, also if no chunk of theirs has an embedding now. The batch becomes
    visible at once, when its files are complete (see sources.chunkstore); what is there already is neither read nor moved.
    An empty subject or class is read back as null. Chunks are worked out once, for their files and for the list of documents.
    """
    cached = chunks.storageLevel != StorageLevel.NONE
    held = chunks if cached else chunks.persist(StorageLevel.DISK_ONLY)
    try:
        return chunkstore.commit(keyed_chunks(held), held, path, "pdf_name", PARTITIONS)
    finally:
        if not cached:
            held.unpersist()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that a store holds now."""
    return chunkstore.live(spark, path, "pdf_name")


def compact_chunks(spark: SparkSession, path: str) -> None:
    """Rewrite a store as one batch and delete what is replaced."""
    chunkstore.compact(spark, path, "pdf_name", PARTITIONS)


def collection_info(chunks: DataFrame) -> DataFrame:
    """Chunks and documents of each subject, with the total under All."""
    return chunks.rollup("subject").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("pdf_name").alias("documents"), F.grouping("subject").alias("_g")).select(F.when(F.col("_g") == 1, "All").otherwise(F.col("subject")).alias("subject"), "chunks", "documents")


def collection_status(spark: SparkSession, name: str, prefix: str = "") -> DataFrame:
    """(collection, exists, points, all_collections) of one collection; a missing one has no points.

    all_collections: sorted names of the catalog's tables that start with prefix.
    """
    exists = spark.catalog.tableExists(name)
    points = spark.table(name).agg(F.count(F.lit(1)).alias("points")) if exists else spark.range(1).select(F.lit(0).cast("long").alias("points"))
    names = F.array(*[F.lit(n) for n in sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))]).cast("array<string>")
    return points.select(F.lit(name).alias("collection"), F.lit(exists).alias("exists"), "points", names.alias("all_collections"))
