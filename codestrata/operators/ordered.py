"""Values of the row before, without gathering a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.scratch import Scratch


def with_previous(df: DataFrame, key: str, order: list[str], cols: list[str], filled: bool = False) -> DataFrame:
    """Adds ``prev_<col>``: the value in the row before, by ``order`` within ``key``; null in the first row.

    With ``filled`` it is the last value before that is not null. ``order``
    must tell rows of a key apart. Rows are range-sorted by key and order, so a
    key that holds a third of all rows lies in many partitions; each partition's
    slice of a key is looked at by itself, and the last values of the slices,
    few rows, are carried over.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ordered")
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = scratch.save(df.repartitionByRange(n, key, *order).withColumn("__part", F.spark_partition_id()))
    at = F.struct(*order)
    w = W.partitionBy(key, "__part").orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("__first", F.row_number().over(w) == 1)
    for c in cols:
        local = local.withColumn(f"__l_{c}", F.last(c, True).over(before) if filled else F.lag(c).over(w))
    ends = rows.groupBy(key, "__part").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at) if filled else at).alias(f"__e_{c}") for c in cols))
    v = W.partitionBy(key).orderBy("__part")
    carried = ends.select(
        F.col(key).alias("__key"),
        F.col("__part").alias("__p"),
        *((F.last(f"__e_{c}", True).over(v.rowsBetween(W.unboundedPreceding, -1)) if filled else F.lag(f"__e_{c}").over(v)).alias(f"__c_{c}") for c in cols),
    )
    joined = local.join(carried, local[key].eqNullSafe(carried["__key"]) & (local["__part"] == carried["__p"]), "left")
    for c in cols:
        value = F.coalesce(f"__l_{c}", f"__c_{c}") if filled else F.when(F.col("__first"), F.col(f"__c_{c}")).otherwise(F.col(f"__l_{c}"))
        joined = joined.withColumn(f"prev_{c}", value)
    return joined.select(*df.columns, *(f"prev_{c}" for c in cols))
