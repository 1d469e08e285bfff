"""One registered query for each training-data operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, langid, lm, mixing, mtree, neardup, pii, runs, sharding, tokencount, toxicity, vectorcodes, warc
from tessella.llm.common import table


def op3_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=8)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op8_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op2_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect_languages(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.section_tokens(table(spark, sf_dir, "documents"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "source"])


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op11_capture_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_history(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to_page").alias("refers_to"), "url_key", F.col("at").alias("captured_at"), "slot", "capture", "intact")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_capture_history": op11_capture_history, "op12_periodic_runs": op12_periodic_runs, "op13_vector_codes": op13_vector_codes, "op9_exact_top_k": op9_exact_top_k, "op1_mixing": op1_mixing, "op5_section_tokens": op5_section_tokens, "op7_personal_data": op7_personal_data, "op6_toxicity": op6_toxicity, "op2_identify_language": op2_identify_language, "op8_gru_scores": op8_gru_scores, "op10_decontaminate": op10_decontaminate, "op3_interleave": op3_interleave, "op4_near_duplicates": op4_near_duplicates}
