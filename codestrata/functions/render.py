"""Text made of rows: trees, prompts, commit lines, relative times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths


def tree_lines(tree: DataFrame, depth: int = 6, most: int = 2_000) -> DataFrame:
    """``(path, line)``: an indented line per entry down to a depth, the first so many in path order."""
    level = F.size(paths.segments(F.col("path")))
    line = F.concat(F.repeat(F.lit("  "), level - 1), F.col("name"), F.when(F.col("type") == "directory", "/").otherwise(""))
    return tree.where(level <= depth).orderBy("path").limit(most).select("path", line.alias("line"))


def numbered_context(hits: DataFrame, chars: int = 1_500) -> DataFrame:
    """One row ``(prompt)``: the hits of a search as numbered blocks, in their order; ``hits`` is a top-k."""
    block = F.format_string("[%d] %s:%d\n%s", F.col("rank"), F.col("file_path"), F.col("line_start"), F.substring("content", 1, chars))
    return hits.agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("x")).select(F.array_join(F.col("x.b"), "\n\n").alias("prompt"))


def commit_line(message: Column, sha: Column) -> Column:
    return F.concat(F.substring(sha, 1, 7), F.lit(" "), F.substring(F.substring_index(message, "\n", 1), 1, 80))


def relative_time(at: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    whole = lambda n: F.floor(s / n).cast("string")
    return F.when(s < 60, "just now").when(s < 3600, F.concat(whole(60), F.lit("m ago"))).when(s < 86400, F.concat(whole(3600), F.lit("h ago"))).otherwise(F.concat(whole(86400), F.lit("d ago")))
