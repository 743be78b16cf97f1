"""Column expressions of scores, grades and tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions import paths


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """``x`` within bounds; null stays null, which least and greatest alone would skip."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def _rounded(x: Column, digits: int) -> Column:
    """Rounded half up as a decimal, so that the last bits of a sum do not decide."""
    return F.round(x.cast("decimal(18,8)"), digits).cast("double")


def dead_code_impact(lines: Column, path: Column, days_since: Column, complexity: Column) -> Column:
    """40 % size, 30 % location, 20 % recency, 10 % complexity; unknown recency or complexity is 50."""
    recency = F.coalesce(clamp(F.lit(100.0) - days_since), F.lit(50.0))
    return clamp(0.40 * clamp(2.0 * lines) + 0.30 * paths.location_score(path) + 0.20 * recency + 0.10 * F.coalesce(clamp(complexity.cast("double")), F.lit(50.0)))


def hot_spot_risk(changes: Column, coverage: Column, path: Column, authors: Column) -> Column:
    """30 % churn, 30 % missing coverage, 20 % location, 20 % authors; unknown coverage is 50."""
    untested = F.coalesce(clamp(F.lit(100.0) - 100.0 * coverage), F.lit(50.0))
    return clamp(0.30 * clamp(3.0 * changes) + 0.30 * untested + 0.20 * paths.location_score(path) + 0.20 * clamp(15.0 * authors))


def health_score(dead: Column, functions: Column, hot: Column, files: Column, outliers: Column, chunks: Column) -> Column:
    """100 less capped penalties for dead code, hot spots and outliers."""
    part = lambda n, d, weight, cap: F.least(F.lit(float(cap)), F.when(d > 0, weight * n / d).otherwise(0.0))
    return clamp(F.lit(100.0) - part(dead, functions, 80.0, 40) - part(hot, files, 60.0, 30) - part(outliers, chunks, 40.0, 20)).cast("int")


def complexity_score(avg: Column, long_files: Column, most: float = 20.0) -> Column:
    curve = (
        F.when(avg <= 5, 100 - 2 * avg).when(avg <= 10, 90 - 4 * (avg - 5)).when(avg <= 20, 70 - 3 * (avg - 10)).otherwise(F.greatest(F.lit(0.0), 40 - (avg - 20)))
    )
    return F.greatest(F.lit(0.0), curve - F.least(F.lit(most), 2.0 * long_files))


def basic_index(avg: Column, files: Column, lines: Column, long_files: Column) -> Column:
    """A quarter complexity, a quarter duplication (85), 30 % lines a file, a fifth architecture (75)."""
    per = lines / files
    size = F.when(files > 0, F.when(per <= 100, 100.0).when(per <= 200, 90.0).when(per <= 300, 75.0).otherwise(F.greatest(F.lit(40.0), 100 - per / 10))).otherwise(50.0)
    return F.round(0.25 * complexity_score(avg, long_files, 30.0) + 0.25 * F.lit(85.0) + 0.30 * size + 0.20 * F.lit(75.0), 2)


def heuristics_score(files: Column, lines: Column, generic: Column, magic: Column, nodoc: Column, notypes: Column, todo: Column, long_files: Column) -> Column:
    f, k = F.greatest(F.lit(1), files), F.greatest(F.lit(1.0), lines / 1000)
    cut = lambda x, cap: F.least(F.lit(float(cap)), x)
    lost = cut(generic / f * 20, 15) + cut(magic / k * 0.5, 15) + cut(nodoc / f * 15, 10) + cut(notypes / k * 0.05, 10) + cut(todo / k * 0.5, 10) + cut(long_files / f * 30, 10)
    return F.greatest(F.lit(0.0), _rounded(100 - lost, 1))


def quality_index(complexity: Column, files: Column, magic: Column, heuristics: Column, architecture: Column) -> Column:
    duplication = F.greatest(F.lit(50.0), F.lit(80.0) - F.when(files > 50, 5).otherwise(0) - F.when(magic > 50, 10).otherwise(0))
    return _rounded(0.25 * complexity + 0.25 * duplication + 0.30 * heuristics + 0.20 * architecture, 2)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").when(score.isNotNull(), "F")


def debt_level(score: Column) -> Column:
    return F.when(score >= 75, "low").when(score >= 55, "medium").otherwise("high")


def complexity_rank(cc: Column) -> Column:
    return F.when(cc <= 5, "A").when(cc <= 10, "B").when(cc <= 20, "C").when(cc <= 30, "D").when(cc <= 40, "E").when(cc.isNotNull(), "F")


def cohesion_status(cohesion: Column) -> Column:
    return F.when(cohesion >= 0.7, "healthy").when(cohesion >= 0.5, "moderate").otherwise("scattered")


def risk_colour(score: Column) -> Column:
    return F.when(score < 40, "green").when(score < 70, "amber").otherwise("red")


def health_colour(score: Column) -> Column:
    s = clamp(score)
    return F.when(s >= 80, "green").when(s >= 60, "amber").when(s >= 40, "orange").otherwise("red")


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "critical").when(confidence >= 0.5, "recommended").otherwise("informational")


def risk_factors(changes: Column, authors: Column, lines: Column, coverage: Column) -> Column:
    """The reasons a file is risky, as an array."""
    rules = F.array(
        F.when(changes > 30, "very high churn").when(changes > 10, "high churn"),
        F.when(authors > 5, "many authors").when(authors > 2, "several authors"),
        F.when(lines > 500, "large changes"),
        F.when(coverage.isNull(), "coverage unknown").when(coverage < 0.2, "very low coverage").when(coverage < 0.5, "low coverage"),
    )
    return F.filter(rules, lambda x: x.isNotNull())


def suggested_action(changes: Column, authors: Column, coverage: Column) -> Column:
    """What to do about a hot spot: tests first, then one thing more; a sentence of its own where nothing applies."""
    tests = F.when(coverage < 0.5, "Add tests before next modification").when(coverage.isNull(), "Consider adding test coverage")
    more = F.when(changes > 30, "Review for potential refactoring opportunities").when(authors > 3, "Ensure code review coverage for changes")
    said = F.concat_ws(". ", tests, more)
    return F.when(said == "", "Monitor for continued high change frequency.").otherwise(F.concat(said, F.lit(".")))


# Names of methods that a framework or pattern asks for.
FRAMEWORK_NAMES = [
    "constructor", "render", "componentdidmount", "componentdidupdate", "componentwillunmount", "equals", "hashcode", "initialize", "tostring", "valueof", "setup", "teardown",
    "dispose", "destroy", "init", "configure", "getstate", "setstate", "shouldcomponentupdate", "getderivedstatefromprops", "getsnapshotbeforeupdate", "componentdidcatch",
    "clone", "copy", "compareto", "finalize",
]
UTILITY_NAMES = ["get", "set", "run", "add", "put", "pop", "map", "log"]
UTILITY_FOLDERS = ["/utils/", "/helpers/", "/lib/", "/common/"]
PATTERN_SUFFIXES = ["Factory", "Adapter", "Middleware", "Provider", "Interceptor"]


def is_boilerplate(name: Column, path: Column) -> Column:
    low = F.lower(path)
    util = low.contains(UTILITY_FOLDERS[0])
    for f in UTILITY_FOLDERS[1:]:
        util = util | low.contains(f)
    suffix = name.endswith(PATTERN_SUFFIXES[0])
    for s in PATTERN_SUFFIXES[1:]:
        suffix = suffix | name.endswith(s)
    dunder = name.startswith("__") & name.endswith("__") & (F.length(name) > 4)
    return F.coalesce((name != "") & (dunder | F.lower(name).isin(FRAMEWORK_NAMES + UTILITY_NAMES) | ((F.length(name) <= 3) & util) | suffix), F.lit(False))


def outlier_confidence(name: Column, path: Column, near_path: Column, similarity: Column, imports: Column, imported: Column, shared: Column) -> Column:
    """How actionable an outlier is, from 0.1 to 0.9."""
    both = (path != "") & F.coalesce(near_path != "", F.lit(False))
    same = paths.same_layer(path, F.coalesce(near_path, F.lit("")))
    near_base = F.when(paths.is_test(near_path), paths.test_base(near_path)).otherwise(F.regexp_replace(paths.file_name(near_path), r"\.(?:tsx|jsx|ts|js|py|mjs|cjs)$", ""))
    base = paths.test_base(path)
    colocated = (base != "") & F.coalesce((near_base != "") & (F.lower(base) == F.lower(near_base)), F.lit(False))
    test = F.when(paths.is_test(path), F.when(colocated, -0.4).when(similarity < 0.4, 0.2).when(similarity > 0.7, 0.1).otherwise(0.0)).otherwise(0.0)
    one = lambda cond, x: F.when(cond, x).otherwise(0.0)
    raw = (
        F.lit(0.5)
        + one(is_boilerplate(name, path), -0.35)
        + one(imports, -0.30)
        + one(both & ~same, -0.15)
        + test
        + one(similarity < 0.25, 0.30)
        + one((similarity > 0.8) & ~imports & both & same, 0.25)
        + one(imports & imported, 0.20)
        + one(shared >= 3, 0.10)
    )
    return F.round(clamp(raw, 0.1, 0.9), 4)
