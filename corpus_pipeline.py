"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on the documents its predecessor kept; all but the last return the
columns they were given, whatever extra columns there are and whatever their names. An empty table passes through every
stage. A decision is about an id and a text together: rows that share an id but not the text, null ids among them, are
kept or dropped each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, langid, mixing, neardup, sharding
from tessella.llm.common import materialize, table

LEAST_LANGUAGE_SCORE = 0.3


def _boxed(docs: DataFrame) -> DataFrame:
    """Each row whole in _row, beside the id and the text, so that no added name can clash with a given one."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")


def _same(hashed: Column) -> Column:
    """Whether a boxed row is the one of _id and _hash."""
    return (hashed == F.col("_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id and text hash are in gone (doc_id, text_hash)."""
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return _boxed(docs).join(gone, _same(F.xxhash64("text")), "left_anti").select("_row.*")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; texts that are null, empty, without letters or without any evidence go.

    Repeated rows are judged alike, whole long texts are read; without any language to learn from, only texts without letters go.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = langid.identify(_boxed(docs), model, "text", ["_row"])
    return named.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, null ids last, then the smallest text hash.

    Null, empty and wordless texts are in no group and stay. Of rows repeated with id and text one stays.
    """
    groups = neardup.near_duplicates(docs).where("root IS NOT NULL")
    keys = groups.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "times"))
    best = materialize(keys.groupBy("root").agg(first.alias("b")).select("b.doc_id", "b.text_hash", "b.times"), "best")
    is_best = (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    gone = keys.join(best.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), is_best, "left_anti")
    once = _without(docs, gone)
    again = best.where("times > 1")
    if again.isEmpty():
        return once
    repeated = _boxed(once).join(again.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), _same(F.xxhash64("text")), "left_semi")
    return _without(once, again).unionByName(repeated.groupBy("doc_id", F.xxhash64("text")).agg(F.first("_row").alias("_row")).select("_row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark.

    Null, empty and wordless texts share none and stay, as do all rows where the benchmark is empty; repeated rows are judged alike.
    """
    found = decontam.decontaminate(docs.select(F.xxhash64("text").alias("_hash"), "text"), table(spark, sf_dir, "benchmark"), id_col="_hash", slop=0)
    gone = found.where("contaminated").select(F.col("doc_id").alias("_hash")).distinct()
    return _boxed(docs).join(gone, F.xxhash64("text") == F.col("_hash"), "left_anti").select("_row.*")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whole copies whose expected number is the fitted rate; 0 leaves a document out.

    A rate above 1 repeats rows, so the shards may hold exact copies again, as the mixture wants them. Texts without
    words have an even rate; null ids and repeated rows take part like others; without labels rates are even.
    """
    mixed = mixing.mix(_boxed(docs), table(spark, sf_dir, "labels"), keep=["_row"])
    return mixed.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and slot; null texts, ids and sources and repeated rows are dealt like others (see sharding.interleave)."""
    return sharding.interleave(docs, shards=8)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_to_targets),
    ("sharding", shard),
]
#: the stages learn models, which SQL cannot express; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
