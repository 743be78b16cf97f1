"""Session construction, table access and code shipping."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "codestrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, base: str, table: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{base}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers, once per context.

    The archive travels through Spark's own file server, so executors need no
    shared code folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_codestrata_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="codestrata-"), "codestrata_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*")):
            if f.is_file() and f.suffix != ".pyc" and "__pycache__" not in f.parts:
                z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
    sc.addPyFile(target)
    sc._codestrata_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Split a scan over at least as many tasks as there are cores.

    Only scans of few row groups are redistributed; a large table already has
    enough splits and passes through without a shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want // 2 else df
