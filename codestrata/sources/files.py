"""Source trees and stored file contents as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import paths, text

MAX_BYTES = 100 * 1024
LEAST = 50


def decode(content: Column) -> Column:
    """Bytes as UTF-8, else as Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size_bytes, content)`` of every file below a local or object-store root."""
    base = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), "^.*?" + base.replace(".", r"\.") + "/", "")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select(rel.alias("path"), F.col("length").alias("size_bytes"), "content")


def is_embeddable(path: Column) -> Column:
    return paths.ending(path).isin(paths.CODE_ENDINGS) & ~paths.is_skipped(path)


def files_for_embedding(tree: DataFrame) -> DataFrame:
    """Source files of at most 100 KB and at least 50 characters, decoded."""
    fit = tree.where(is_embeddable(F.col("path")) & (F.col("size_bytes") <= MAX_BYTES))
    return fit.select("path", decode(F.col("content")).alias("content")).where(F.length("content") >= LEAST)


def files_for_cache(tree: DataFrame) -> DataFrame:
    """Source files of 50 bytes to 100 KB with their SHA-256."""
    fit = tree.where(is_embeddable(F.col("path")) & F.col("size_bytes").between(LEAST, MAX_BYTES))
    return fit.select("path", "size_bytes", F.sha2("content", 256).alias("content_hash"), decode(F.col("content")).alias("content"))


def line_statistics(files: DataFrame) -> DataFrame:
    """``(path, language, lines)`` of ``(path, content)``."""
    return files.select("path", paths.language(F.col("path")).alias("language"), text.line_count(F.col("content")).alias("lines"))


def full_tree(files: DataFrame) -> DataFrame:
    """``(path, name, type, size_bytes)`` of files and all their folders, folders without a size."""
    parts = paths.segments(F.col("path"))
    own = files.where(~F.exists(parts, lambda p: p.isin(".git", "__pycache__", ".DS_Store")))
    dirs = (
        own.where(F.col("path").contains("/"))
        .select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))).alias("path"))
        .distinct()
        .select("path", paths.file_name(F.col("path")).alias("name"), F.lit("directory").alias("type"), F.lit(None).cast("long").alias("size_bytes"))
    )
    return own.select("path", paths.file_name(F.col("path")).alias("name"), F.lit("file").alias("type"), F.col("size_bytes").cast("long").alias("size_bytes")).unionByName(dirs)


def verified_contents(objects: DataFrame, blobs: DataFrame) -> DataFrame:
    """Contents of ready objects whose hash still holds; others are left out."""
    got = objects.where("status = 'ready'").join(blobs.select("object_key", "content"), "object_key")
    return got.where(F.sha2("content", 256) == F.col("content_hash")).withColumn("content", decode(F.col("content")))


def children(tree: DataFrame, folder: str) -> DataFrame:
    """The direct children of a folder ('' for the root), folders first."""
    return tree.where(paths.directory(F.col("path")) == folder).orderBy(F.col("type") != "directory", F.lower("name"))
