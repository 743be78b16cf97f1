"""Writes: partition replacement, idempotent appends, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrite just the partitions that occur in ``df``."""
    df.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def merge_changed_files(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of files that did not change, and all new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def new_only(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not stored yet; of repeated keys one row, the greatest."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*")
    return once.join(old.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns)


def upload_counts(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``(uploaded, skipped)`` of an idempotent upload."""
    flagged = new.join(old.select(*keys).distinct().withColumn("there", F.lit(True)), list(keys), "left")
    return flagged.agg(F.count_if(F.col("there").isNull()).alias("uploaded"), F.count_if("there").alias("skipped"))


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New values where given, old ones elsewhere."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in rest if c in new.columns))
    picked = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in rest]
    return old.join(n, list(keys), "full").select(*keys, *picked)


def orphans(stored: DataFrame, tracked: DataFrame, key: str) -> DataFrame:
    """Stored rows that nothing tracks."""
    return stored.join(tracked.select(key).distinct(), key, "left_anti")
