"""Changes of keyed tables as functions from snapshots to snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.operators.storage import written


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows, as a written table, with the place of each in the given order, from 0, as column `name`:
    sorted by range, so that no task holds more than its share. The order should be total."""
    spots = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    starts = spots.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = spots.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of existing with the same key, in all columns."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of new whose key is not there yet are added, the first of each key."""
    return existing.unionByName(first_wins(new, keys, order).join(existing.select(*keys), keys, "left_anti").select(existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """Known keys take only the updated columns of new; unknown keys are added as they are."""
    e, n = existing.withColumn("_old", F.lit(True)).alias("e"), new.withColumn("_new", F.lit(True)).alias("n")
    both = e.join(n, keys, "full_outer")
    pick = lambda c: F.when(F.col("_new") & (F.col("_old").isNull() | F.lit(c in updated)), F.col(f"n.{c}")).otherwise(F.col(f"e.{c}"))
    return both.select(*keys, *(pick(c).alias(c) for c in existing.columns if c not in keys))


def delete_by_key(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys), keys, "left_anti")


def init_progress(concepts: DataFrame, roots: DataFrame, progress: DataFrame) -> DataFrame:
    """Roots become unlocked whatever they were; other concepts keep their status or are locked."""
    known = progress.select("topic_id", F.col("concept_id").alias("id"), "status")
    is_root = roots.select("topic_id", "id", F.lit(True).alias("root"))
    t = concepts.select("topic_id", "id").join(known, ["topic_id", "id"], "left").join(is_root, ["topic_id", "id"], "left")
    return t.select("topic_id", "id", F.when(F.col("root"), "unlocked").otherwise(F.coalesce("status", F.lit("locked"))).alias("status"))


def cached(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """rows with the cached response of their key and hit, whether there is one."""
    return rows.join(cache.select(key, "response_json"), key, "left").withColumn("hit", F.col("response_json").isNotNull())


def batch_numbers(rows: DataFrame, group: list[str], order: list, size: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
