"""Health of a set of clusters, hot files across clusters, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths, scoring


def spread_files(labelled: DataFrame, least: int = 2, top: int = 10) -> DataFrame:
    """``(file_path, clusters, labels)`` of files in several clusters, the widest first; rows are (file_path, label), -1 is noise."""
    per = labelled.where("label >= 0").groupBy("file_path").agg(F.countDistinct("label").alias("clusters"), F.sort_array(F.collect_set("label")).alias("labels"))
    return per.where(F.col("clusters") >= least).orderBy(F.desc("clusters"), "file_path").limit(top)


def weighted_cohesion(clusters: DataFrame) -> Column:
    return F.sum(F.col("cohesion") * F.col("chunk_count")) / F.sum("chunk_count")


def cluster_health(clusters: DataFrame, outliers: int | Column, chunks: int | Column, hot_files: int | Column, files: int | Column) -> DataFrame:
    """One row ``(score)``: cohesion 35, outliers 30, balance 25, hot files 10. ``clusters`` has (cohesion, chunk_count); counts may be scalar subqueries."""
    from pyspark.sql import Window as W

    ranked = clusters.withColumn("i", F.row_number().over(W.orderBy("chunk_count")))  # clusters are few: one row each
    agg = ranked.agg(F.count("*").alias("n"), weighted_cohesion(clusters).alias("coh"), F.sum(F.col("i") * F.col("chunk_count")).alias("ix"), F.sum("chunk_count").alias("sx"))
    gini = scoring.clamp(2.0 * F.col("ix") / (F.col("n") * F.col("sx")) - (F.col("n") + 1) / F.col("n"), 0.0, 1.0)
    n_out, n_chunks, n_hot, n_files = (x if isinstance(x, Column) else F.lit(x) for x in (outliers, chunks, hot_files, files))
    score = (
        F.coalesce(35.0 * F.col("coh"), F.lit(17.5))
        + F.when(n_chunks > 0, F.greatest(F.lit(0.0), 30 * (1 - 2 * n_out / n_chunks))).otherwise(0.0)
        + F.when(F.col("n") < 2, 12.5).otherwise(25.0 * (1 - gini))
        + F.when((n_files > 0) & (n_hot > 0), F.greatest(F.lit(0.0), 10 * (1 - 5 * n_hot / n_files))).otherwise(10.0)
    )
    return agg.select(scoring.clamp(score).cast("int").alias("score"))


def suggestions(hot: DataFrame, outliers: DataFrame, clusters: DataFrame, duplicates: DataFrame, limit: int = 20) -> DataFrame:
    """``(kind, impact, target, place)`` of four rules, by impact.

    Files over several clusters should be split, outliers near another file
    moved to its folder, scattered clusters of more than three files made a
    module, groups of three or more similar chunks extracted.
    """
    a = hot.select(F.lit("split_file").alias("kind"), F.lit(1).alias("impact"), F.col("file_path").alias("target"), F.lit(None).cast("string").alias("place"))
    b = outliers.where("nearest_similarity > 0.5 AND nearest_file IS NOT NULL").select(F.lit("move_file"), F.lit(2), "file_path", paths.directory(F.col("nearest_file"), "root"))
    c = clusters.where("status = 'scattered' AND file_count > 3").select(F.lit("create_module"), F.lit(2), "name", F.lit(None).cast("string"))
    d = duplicates.where("chunks >= 3").select(F.lit("extract_utility"), F.lit(3), F.col("seed").cast("string"), F.lit(None).cast("string"))
    return a.union(b).union(c).union(d).orderBy("impact", "kind", "target").limit(limit)


def placement(files: DataFrame, similar: DataFrame) -> DataFrame:
    """``(file_path, best_folder, similarity, advice)``: the folder whose files are on average most similar.

    ``similar`` has (file_path, other_path, similarity).
    """
    per = similar.groupBy("file_path", paths.directory(F.col("other_path"), "root").alias("folder")).agg(F.avg("similarity").alias("s"))
    best = per.groupBy("file_path").agg(F.max_by("folder", F.struct(F.round("s", 6), F.col("folder"))).alias("best_folder"), F.round(F.max("s"), 6).alias("similarity"))
    here = paths.directory(F.col("file_path"), "root") == F.col("best_folder")
    advice = F.when(here, "well placed").when(F.col("similarity") > 0.7, "consider moving").otherwise("might fit better")
    return files.select("file_path").distinct().join(best, "file_path").withColumn("advice", advice)
