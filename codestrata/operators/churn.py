"""Change history per file, hot spots and their risk."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import scoring


def file_churn(changes: DataFrame, now: datetime, long_days: int = 90, short_days: int = 30) -> DataFrame:
    """One row per file of ``(file_path, author, ts, lines_added, lines_removed)``, both windows in one pass."""
    end = F.lit(now).cast("timestamp")
    age = lambda d: F.col("ts") >= end - F.expr(f"INTERVAL {d} DAYS")
    return (
        changes.where(age(long_days) & (F.col("ts") <= end))
        .groupBy("file_path")
        .agg(
            F.count_if(age(short_days)).alias("changes_short"),
            F.count("*").alias("changes"),
            F.sum("lines_added").alias("lines_added"),
            F.sum("lines_removed").alias("lines_removed"),
            F.countDistinct("author").alias("authors"),
            F.max("ts").alias("last_modified"),
        )
    )


def hot_spots(churn: DataFrame, coverage: DataFrame | None, threshold: int = 10) -> DataFrame:
    """Files changed more than ``threshold`` times, with coverage where known and their risk."""
    hot = churn.where(F.col("changes") > threshold)
    rated = hot.join(coverage.select("file_path", "line_rate"), "file_path", "left") if coverage is not None else hot.withColumn("line_rate", F.lit(None).cast("double"))
    risk = scoring.hot_spot_risk(F.col("changes"), F.col("line_rate"), F.col("file_path"), F.col("authors"))
    return rated.withColumn("risk_score", F.round(risk, 4)).withColumn("risk_factors", scoring.risk_factors(F.col("changes"), F.col("authors"), F.col("lines_added") + F.col("lines_removed"), F.col("line_rate")))
