"""Findings: sampling, numbering, merging, budgets."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.functions import paths
from codestrata.session import ship


def diverse_sample(findings: DataFrame, limit: int, id_col: str = "id", score_col: str = "score", path_col: str = "file_path") -> DataFrame:
    """``(id, pick)``: the best half of the limit by score, then the best of each folder not yet seen, then the best of the rest.

    Every step is a top-k of the limit's size, so nothing is sorted whole.
    """
    rows = findings.select(F.col(id_col).alias("id"), F.col(score_col).alias("score"), paths.directory(F.col(path_col), "root").alias("folder"))
    if limit <= 0:
        return rows.limit(0).select("id", F.lit(0).alias("pick"))
    order = [F.desc("score"), F.asc("id")]
    top = rows.orderBy(*order).limit(limit // 2)
    rest = rows.join(F.broadcast(top.select("id")), "id", "left_anti")
    first = F.row_number().over(W.partitionBy("folder").orderBy(*order))
    fresh = rest.join(F.broadcast(top.select("folder").distinct()), "folder", "left_anti").withColumn("k", first).where("k = 1").drop("k")
    spread = fresh.orderBy(*order).limit(limit - limit // 2)
    fill = rest.join(F.broadcast(spread.select("id")), "id", "left_anti").orderBy(*order).limit(limit)
    ranked = top.withColumn("step", F.lit(1)).unionByName(spread.withColumn("step", F.lit(2))).unionByName(fill.withColumn("step", F.lit(3)))
    pick = F.row_number().over(W.orderBy("step", *order))  # at most 2.5 times the limit of rows
    return ranked.withColumn("pick", pick).where(F.col("pick") <= limit).select("id", "pick")


def numbered(issues: DataFrame, prefix: dict[str, str], kind: str, order: list[str]) -> DataFrame:
    """Adds ``label``: a prefix for the kind and a number within it, of three digits at least."""
    p = F.coalesce(paths.lookup(prefix, F.col(kind)), F.lit("oth"))
    n = F.row_number().over(W.partitionBy(p).orderBy(*order))
    return issues.withColumn("label", F.concat(p, F.lit("-"), F.when(n > 999, n.cast("string")).otherwise(F.lpad(n.cast("string"), 3, "0"))))


def merge_issues(issues: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(id, seed)``: issues joined to the first one that shares a file and reads alike.

    Greedy in the order of ``ord`` and against group seeds only, inside each
    group of issues that share files; ``issues`` has (id, ord, files, text).
    """
    ship(issues.sparkSession)
    from codestrata.operators.graph import components

    pairs = issues.select("id", F.explode(F.array_distinct("files")).alias("file"))
    first = pairs.groupBy("file").agg(F.min("id").alias("other"))
    comp = components(pairs.join(first, "file").select(F.col("id").alias("a"), F.col("other").alias("b")))
    grouped = issues.join(comp, "id", "left").withColumn("grp", F.coalesce("group_id", "id"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "id"])
        seeds: list[tuple] = []
        out = []
        for i, files, text in zip(pdf["id"], pdf["files"], pdf["text"]):
            own, hit = set(files if files is not None else ()), None
            for s, f, t in seeds:
                if own & f and SequenceMatcher(None, (text or "").lower(), t).ratio() > threshold:
                    hit = s
                    break
            if hit is None:
                seeds.append((i, own, (text or "").lower()))
            out.append((i, i if hit is None else hit))
        return pd.DataFrame(out, columns=["id", "seed"])

    return grouped.select("grp", "id", "ord", "files", "text").groupBy("grp").applyInPandas(greedy, "id long, seed long")


def merged_fields(issues: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row a seed of ``merge_issues`` with what its group says together.

    ``issues`` has (id, ord, title, summary, files, evidence, source, confidence),
    files and evidence being arrays; ``seeds`` (id, seed). Files, evidence and
    sources are ordered unions by (ord, id); two or more sources make the
    confidence "high"; the title is the seed's first 200 characters. Nulls and
    empty texts add nothing.
    """
    rows = issues.join(seeds, "id")
    first = lambda c, name: (
        rows.select("seed", "ord", "id", F.posexplode(c).alias("at", "x"))
        .where("x IS NOT NULL AND x <> ''")
        .groupBy("seed", "x")
        .agg(F.min(F.struct("ord", "id", "at")).alias("o"))
        .groupBy("seed")
        .agg(F.sort_array(F.collect_list(F.struct("o", "x"))).alias("s"))
        .select("seed", F.col("s.x").alias(name))
    )
    base = issues.select(F.col("id").alias("seed"), F.substring("title", 1, 200).alias("title"), "summary", "confidence")
    out = seeds.groupBy("seed").agg(F.count("*").alias("merged")).join(base, "seed")
    for c, name in ((F.col("files"), "files"), (F.col("evidence"), "evidence"), (F.array("source"), "sources")):
        out = out.join(first(c, name), "seed", "left")
    none = F.array().cast("array<string>")
    out = out.select("seed", "merged", "title", "summary", "confidence", *(F.coalesce(c, none).alias(c) for c in ("files", "evidence", "sources")))
    return out.withColumn("confidence", F.when(F.size("sources") >= 2, "high").otherwise(F.col("confidence")))


def within_budget(files: DataFrame, budget: int, group: str = "repository_id", excerpt: int = 1_000) -> DataFrame:
    """``(group, path, tokens, used, truncated)``: files taken by priority until the budget less a reserve is reached.

    The reserve is a hundredth of the budget, 10 at least. A file that does not
    fit is tried once more as an excerpt of ``excerpt`` tokens, if it is longer
    than that; if that does not fit it is skipped, and smaller ones may follow.
    """
    ship(files.sparkSession)
    stop = budget - max(10, budget // 100)
    schema = files.select(group).schema[0].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = object(), 0
        for pdf in batches:
            rows = []
            for g, p, t in zip(pdf[group], pdf["path"], pdf["tokens"]):
                if g != now:
                    now, used = g, 0
                cut = used + t > stop and t > excerpt
                size = excerpt if cut else t
                if used < stop and used + size <= stop:
                    used += size
                    rows.append((g, p, size, used, cut))
            yield pd.DataFrame(rows, columns=[group, "path", "tokens", "used", "truncated"])

    rows = files.select(group, "path", "tokens", paths.priority(F.col("path")).alias("priority"))
    # the order decides what fits, so a group's rows stream, sorted, one at a time
    return rows.where("tokens IS NOT NULL").repartition(group).sortWithinPartitions(group, "priority", "path").mapInPandas(fold, f"{group} {schema}, path string, tokens long, used long, truncated boolean")
