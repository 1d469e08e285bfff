"""Proportional stratified interleaving into shards, with DataFrame functions only.

Rows are shuffled by a seeded hash within each source and ranked; the fractional rank
(2 * rank - 1) / (2 * rows of the source) interleaves the sources evenly, and equal cuts of that order
give shards that all hold the mixture of the whole table.

Both ranks are exact and no source is ever gathered in one task: rows are first dealt to buckets of the sort
key, a small table of bucket counts gives each bucket's offset by a running sum, and only the rest of the rank
is counted inside a bucket. Buckets number at most 65,536, so the offset tables are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 256
MOST_BUCKETS = 1 << 16


def bucket_count(rows: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // ROWS_PER_BUCKET)))


def _ranked(df: DataFrame, group: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Add out, the rank from 0 of each row in its group (the whole table if none) by (bucket, order)."""
    keys = [*group, bucket]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(f"{out}_of"))
    inside = df.withColumn("_inside", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    return inside.join(offsets, keys).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def shuffle_key(seed: int, *cols: Column) -> Column:
    """Seeded hash of a row as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))


def interleave(docs: DataFrame, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """Deal rows to shards 0..shards-1 under the law `rows` (counts at most one apart).

    Returns id_col, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (gapless from 0 in each shard),
    grown_shard (null: only the law `key` has it), stratum. One output row per input row, repeated rows too.

    The shuffle hashes id and crc32, so that one id on many rows is spread like any rows. Defined cases: null text has
    size 1 and crc32 0; a null source is a stratum of its own; null ids take part and count as the text "null"; equal keys are ordered by id, crc32 and size, so only rows
    equal in all of these are interchangeable; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("null")).alias("stratum"),
    ).withColumn("_key", shuffle_key(seed, F.col("doc_id"), F.col("text_crc32")))
    n = docs.count()
    buckets = bucket_count(n)
    order = [F.col(c).asc_nulls_first() for c in ("_key", "doc_id", "text_crc32", "size")]
    by_key = base.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int"))
    ranked = _ranked(by_key, ["stratum"], "_bucket", order, "_rank").withColumn("_fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_rank_of")))
    spread = ranked.withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor(F.col("_fraction") * buckets)).cast("int"))
    placed = _ranked(spread, [], "_bucket", [F.col("_fraction"), *order], "_place")
    shard = F.expr(f"(_place * {shards}) div _place_of")
    first = F.expr(f"((_place * {shards}) div _place_of * _place_of + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (F.col("_place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "stratum",
    )
