"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a score from (record key, shard name); the best score wins. A shard's
scores do not depend on the other shards, so a new shard takes rows only into itself and a
removed one gives up only its own. Weights scale the scores (-ln(u) / weight, smallest
wins), so a shard gets rows in proportion to its weight.

Defined cases: a null key counts as one key of its own, so all null keys share a shard; an
empty table gives an empty result; repeated rows go to the same shard and get slots of their
own; columns of the input keep their names, and the added columns replace any of that name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one slot-numbering bucket should hold.
ROWS_PER_BUCKET = 200_000


def _score(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00null")), F.lit(f"shard-{shard}")), 11)
    return -F.log((bits.cast("double") + 0.5) / float(2**53)) / F.lit(float(weight))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The index of the shard, among len(weights), that the key belongs to. Shards of
    weight 0 get nothing; at least one weight must be above 0."""
    ranked = [F.struct(_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    if not ranked:
        raise ValueError("no shard has a weight above 0")
    return (F.least(*ranked) if len(ranked) > 1 else ranked[0])["shard"]


def number_slots(rows: DataFrame, shard: str, shards: int, order: Sequence[str], slot: str = "slot", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Number the rows of each of `shards` shards from 0 without gaps.

    A shard may hold far more rows than a task should sort, so rows are dealt by
    (shard, hash bucket), numbered there, and moved up by the size of the buckets before."""
    buckets = max(1, rows.count() // (shards * rows_per_bucket))
    # rows travel as one column, so that none of theirs clashes with what is added here
    keyed = rows.select(F.struct("*").alias("row"), F.col(shard).alias("shard"), F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int").alias("bucket"))
    sizes = keyed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy(*(F.col("row").getField(c) for c in order))
    numbered = keyed.withColumn("at", F.row_number().over(within) - 1).join(starts, ["shard", "bucket"])
    kept = [F.col("row").getField(c).alias(c) for c in rows.columns if c != slot]
    return numbered.select(*kept, (F.col("start") + F.col("at")).cast("long").alias(slot))


def shard_records(rows: DataFrame, key: str, weights: Sequence[float], grown_weight: float = 1.0, order: Sequence[str] = ()) -> DataFrame:
    """rows with shard, slot (gapless in the shard) and grown_shard, the shard if one more
    shard of weight grown_weight were added."""
    out = rows.withColumn("shard", rendezvous_shard(F.col(key), weights).cast("int"))
    out = out.withColumn("grown_shard", rendezvous_shard(F.col(key), [*weights, grown_weight]).cast("int"))
    return number_slots(out, "shard", len(weights), [key, *order])


def op7_rendezvous_sharding(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents over equally weighted shards, by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = shard_records(rows, "doc_id", [1.0] * shards, order=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
