"""References to commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolved(requests: DataFrame, branches: DataFrame, latest: DataFrame) -> DataFrame:
    """``(repository_id, ref, commit_sha, source)`` of ``(repository_id, ref)``.

    A hash of 40 digits is itself; else a branch of ``branches (repository_id,
    branch, commit_sha)``; else the commit of ``latest (repository_id,
    commit_sha)``; else none. Outer spaces and ``refs/heads/`` do not count,
    an empty reference is none. Repeated requests count once.
    """
    bare = F.regexp_replace(F.trim("ref"), r"^refs/heads/", "")
    asked = requests.select("repository_id", "ref").distinct().withColumn("branch", F.when(bare != "", bare))
    known = branches.where("commit_sha IS NOT NULL").groupBy("repository_id", "branch").agg(F.max("commit_sha").alias("at_branch"))
    newest = latest.where("commit_sha IS NOT NULL").groupBy("repository_id").agg(F.max("commit_sha").alias("at_latest"))
    rows = asked.join(known, ["repository_id", "branch"], "left").join(newest, "repository_id", "left")
    own = F.when(F.lower("branch").rlike("^[0-9a-f]{40}$"), F.col("branch"))
    source = F.when(own.isNotNull(), "hash").when(F.col("at_branch").isNotNull(), "branch").when(F.col("at_latest").isNotNull(), "latest").otherwise("none")
    return rows.select("repository_id", "ref", F.coalesce(own, "at_branch", "at_latest").alias("commit_sha"), source.alias("source"))
