"""Intermediate tables in the shared folder, to cut lineage between rounds.

The folder is the session's ``spark.checkpoint.dir``. Only a session whose
master is local may leave it unset and gets a folder of this machine; on a
cluster that is an error, for executors would each write to a disk of their
own. Tables written here outlive the loss of any executor. They are deleted by
``clear`` once a query's result has been used, at the latest when the process
ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_ROOTS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session that names none gets one of this machine."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        base = getattr(spark.sparkContext, "_codestrata_tmp", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="codestrata-scratch-")
            spark.sparkContext._codestrata_tmp = base
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # at the end of the process the context may be gone already
        pass


@atexit.register
def clear() -> None:
    """Delete every table written so far; results that read them must have been used."""
    while _ROOTS:
        _remove(*_ROOTS.pop())


class Scratch:
    """Tables of one run of one operator, under one folder of their own."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _ROOTS.append((spark, self.root))

    def save(self, df: DataFrame, *drop: DataFrame) -> DataFrame:
        """Write ``df``, read it back, and delete the earlier tables in ``drop``."""
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        for old in drop:
            self.drop(old)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _remove(self.spark, path)
