"""Progress and state events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.ordered import with_previous

# The steps of a tracked job that are allowed.
TRANSITIONS = [("none", "pending"), ("pending", "running"), ("running", "completed"), ("running", "failed"), ("failed", "pending")]


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``(start, kind, events)`` per tumbling window; on a stream late rows wait for the watermark."""
    rows = events.withColumn("t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("t", late)
    return rows.groupBy(F.window("t", width), F.col(kind).alias("kind")).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "kind", "events")


def last_values(events: DataFrame, key: str, ts: str, *cols: str) -> DataFrame:
    """The latest row per key; in a stream use complete or update mode."""
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(ts), *cols)).alias("r"), F.max(ts).alias("at")).select(key, "at", "r.*")


def bounded_progress(events: DataFrame, status: str = "status", progress: str = "progress") -> DataFrame:
    """Events whose progress is a number from 0 to 100 and whose status is known."""
    known = sorted({s for pair in TRANSITIONS for s in pair})
    return events.where(F.col(status).isin(known) & F.col(progress).between(0, 100))


def checked_transitions(events: DataFrame, key: str, ts: str, tie: str, status: str, allowed: list[tuple[str, str]], start: str = "none") -> DataFrame:
    """Adds ``before`` and ``valid``: whether the step from the row before of the key is allowed."""
    before = F.coalesce(f"prev_{status}", F.lit(start))
    steps = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    seen = with_previous(events, key, [ts, tie], [status])
    return seen.withColumn("before", before).drop(f"prev_{status}").withColumn("valid", F.array_contains(steps, F.concat_ws(">", "before", F.col(status))))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """``(key, start, end, events)`` of activity with no pause of ``gap``."""
    rows = events.withColumn("t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("t", late)
    return rows.groupBy(key, F.session_window("t", gap).alias("s")).agg(F.count("*").alias("events")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def heartbeats(events: DataFrame, key: str, ts: str, tie: str, least_seconds: int = 30) -> DataFrame:
    """Events at least so many seconds after the row before of their key."""
    seen = with_previous(events.withColumn("__t", F.col(ts).cast("timestamp").cast("double")), key, [ts, tie], ["__t"])
    return seen.withColumn("gap", F.col("__t") - F.col("prev___t")).drop("__t", "prev___t").where(F.col("gap").isNull() | (F.col("gap") >= least_seconds))
