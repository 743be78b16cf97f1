"""The engine's queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.functions import paths, render, scoring, text, vectors
from codestrata.operators import churn, chunker, duplicates, findings, graph, hdbscan, health, ordered, quality, refs, search
from codestrata.plans import twins
from codestrata.scratch import Scratch
from codestrata.session import load
from codestrata.sources import files as files_source
from codestrata.sources import sinks
from codestrata.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
NOW = datetime(2001, 11, 4)


def _chunks(spark: SparkSession, base: str, *cols: str) -> DataFrame:
    """Chunks, each once although rows are written twice; only the named columns are read and shuffled."""
    return load(spark, base, "code_chunks").select("chunk_id", *cols).distinct()


def _contents(spark: SparkSession, base: str) -> DataFrame:
    """Rows with content. Results are made distinct after it is reduced, so that content is not shuffled."""
    return load(spark, base, "code_chunks").where("content IS NOT NULL")


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "chunk_vectors")


def _changes(spark: SparkSession, base: str) -> DataFrame:
    """lineitem as a change log: parts are files, suppliers authors."""
    return load(spark, base, "lineitem").select(
        F.concat(F.lit("services/part_"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("file_path"),
        F.col("l_suppkey").alias("author"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_quantity").cast("long").alias("lines_added"),
        F.lit(0).cast("long").alias("lines_removed"),
    )


# ------------------------------------------------------------ sources and files


def s6_languages(spark, base):
    c = _chunks(spark, base, "file_path")
    return c.groupBy(paths.language(F.col("file_path")).alias("detected")).agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"))


def s4_full_tree(spark, base):
    objects = load(spark, base, "repo_content_objects").select(paths.tidy(F.col("path")).alias("path"), "size_bytes").groupBy("path").agg(F.max("size_bytes").alias("size_bytes"))
    return files_source.full_tree(objects)


def s3_embeddable(spark, base):
    o = load(spark, base, "repo_content_objects").select("object_id", "path", "size_bytes").distinct()
    return o.where(files_source.is_embeddable(F.col("path")) & F.col("size_bytes").between(files_source.LEAST, files_source.MAX_BYTES)).select("object_id", "path", "size_bytes")


def s5_line_counts(spark, base):
    c = _contents(spark, base)
    return c.select("chunk_id", text.line_count(F.col("content")).alias("lines"), text.todo_lines(F.col("content")).alias("todos"), text.comment_lines(F.col("content")).alias("comments")).distinct()


def f13_f16_embedding_text(spark, base):
    c = _contents(spark, base).where(F.length("content") >= 10)
    t = text.embedding_text(F.col("file_path"), F.col("name"), F.col("chunk_type"), F.col("docstring"), F.col("content"))
    return c.select("chunk_id", F.length(t).alias("chars"), F.substring(t, 1, 200).alias("head")).distinct()


def f14_children(spark, base):
    tree = s4_full_tree(spark, base)
    return tree.where(paths.directory(F.col("path")) == "").select("name", "type")


def f17_grades(spark, base):
    score = F.round(F.pmod(F.col("o_totalprice"), F.lit(100.0)), 2)
    o = load(spark, base, "orders").select(score.alias("s"))
    return o.groupBy(scoring.grade(F.col("s")).alias("grade"), scoring.debt_level(F.col("s")).alias("debt"), scoring.health_colour(F.col("s")).alias("colour")).agg(F.count("*").alias("n"))


def f21_priorities(spark, base):
    p = load(spark, base, "repo_content_objects").select("path").distinct()
    return p.select("path", paths.priority(F.col("path")).alias("priority"), paths.layer(F.col("path")).alias("layer"), paths.is_test(F.col("path")).alias("is_test"))


# ------------------------------------------------------------ joins


def j3_latest_upload(spark, base):
    """Each indexed file with its latest ready upload, if any."""
    o = load(spark, base, "repo_content_objects").where("status = 'ready'").withColumn("p", paths.tidy(F.col("path")))
    last = o.groupBy("p").agg(F.max_by("object_id", F.struct("created_at", "object_id")).alias("object_id"))
    f = load(spark, base, "code_chunks").select(F.col("file_path").alias("p")).distinct()
    return f.join(last, "p", "left").select(F.col("p").alias("file_path"), "object_id")


def j10_nearest(spark, base):
    """The three nearest vectors, among all, of each vector whose id is divisible by 100."""
    e = load(spark, base, "embeddings").select("vec_id", "embedding")
    return search.nearest(e.where("vec_id % 100 = 0"), e, 3, 64)


def j11_top_k(spark, base):
    query = [1.0 if i % 3 == 0 else -0.5 for i in range(128)]
    return search.top_k(_vectors(spark, base), query, 20, language="python").select("vec_id", "score")


def j14_imports(spark, base):
    c = _contents(spark, base)
    got = c.select("chunk_id", F.explode(text.imports(F.col("content"), F.col("language"))).alias("module"))
    return got.distinct()


def j15_orphans(spark, base):
    tracked = load(spark, base, "code_chunks").select(F.col("file_path").alias("p"))
    stored = load(spark, base, "repo_content_objects").select(paths.tidy(F.col("path")).alias("p")).distinct()
    return sinks.orphans(stored, tracked, "p").withColumnRenamed("p", "path")


def u3_shared_imports(spark, base):
    """Modules that two or more files import."""
    got = j14_imports(spark, base).join(_chunks(spark, base, "file_path"), "chunk_id").select("file_path", "module").distinct()
    return got.groupBy("module").agg(F.count("*").alias("files"), F.min("file_path").alias("first_file"), F.max("file_path").alias("last_file")).where("files >= 2")


# ------------------------------------------------------------ aggregations


def a1_totals(spark, base):
    per = load(spark, base, "code_chunks").groupBy("repository_id", "file_path").agg(F.max("line_end").alias("lines"), F.lower(F.max("language")).alias("language"))
    return per.groupBy("repository_id").agg(
        F.count("*").alias("files"),
        F.sum("lines").alias("lines"),
        F.count_if(F.col("lines") > 300).alias("long_files"),
        F.count_if(F.col("language") == "python").alias("python_files"),
        F.count_if(F.col("language").isin("javascript", "typescript")).alias("js_ts_files"),
    )


def a3_complexity(spark, base):
    c = _chunks(spark, base, "language", "cyclomatic_complexity").where("cyclomatic_complexity IS NOT NULL")
    rank = scoring.complexity_rank(F.col("cyclomatic_complexity"))
    return c.groupBy(F.lower("language").alias("language")).agg(
        F.round(F.avg(F.col("cyclomatic_complexity").cast("decimal(12,4)")).cast("double"), 4).alias("avg_cc"),
        F.max("cyclomatic_complexity").alias("max_cc"),
        F.count_if(F.col("cyclomatic_complexity") > 10).alias("high"),
        *(F.count_if(rank == r).alias(f"rank_{r.lower()}") for r in "ABCDEF"),
    )


def a10_cluster_stats(spark, base):
    e = load(spark, base, "embeddings")
    c = search.cohesion(e, "label", dim=64)
    return c.select("label", "n", F.round("cohesion", 4).alias("cohesion"), scoring.cohesion_status(F.round("cohesion", 4)).alias("status"))


def a12_gini(spark, base):
    sizes = _vectors(spark, base).groupBy("repository_id").agg(F.count("*").alias("x"))
    ranked = sizes.withColumn("i", F.row_number().over(W.orderBy("x", "repository_id")))  # one row a repository
    agg = ranked.agg(F.count("*").alias("n"), F.sum(F.col("i") * F.col("x")).alias("ix"), F.sum("x").alias("sx"))
    return agg.select("n", F.round(scoring.clamp(2.0 * F.col("ix") / (F.col("n") * F.col("sx")) - (F.col("n") + 1) / F.col("n"), 0.0, 1.0), 6).alias("gini"))


def a14_spread_files(spark, base):
    """Files whose matches fall into two or more groups of chunk types."""
    m = load(spark, base, "chunk_matches").distinct()
    return m.groupBy("file_path").agg(F.countDistinct("chunk_type").alias("kinds"), F.sort_array(F.collect_set("chunk_type")).cast("string").alias("names")).where("kinds >= 2").select("file_path", "kinds")


def a15_mean_vectors(spark, base):
    c = _vectors(spark, base).withColumn("folder", paths.directory(F.col("file_path"), "root"))
    m = search.mean_vectors(c, "folder")
    return m.select("folder", "n", F.round(vectors.norm(F.col("mean")), 4).alias("norm"))


def v6_style_consistency(spark, base):
    return search.style_consistency(_vectors(spark, base)).select("file_path", F.round("similarity", 2).alias("similarity"), F.round("best_similarity", 2).alias("best_similarity"), "off_style")


def a17_a32_severities(spark, base):
    o = load(spark, base, "orders")
    sev = F.regexp_extract("o_orderpriority", r"^(\d)", 1).cast("int")
    return o.groupBy(F.when(sev <= 1, "critical").when(sev == 2, "high").when(sev == 3, "medium").otherwise("low").alias("severity")).agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("still_open")
    )


def a19_cache_sizes(spark, base):
    o = load(spark, base, "repo_content_objects").distinct()
    return o.groupBy("cache_id").agg(F.count_if(F.col("status") == "ready").alias("ready"), F.coalesce(F.sum(F.when(F.col("status") == "ready", F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes"))


def a24_duplicates(spark, base):
    """Chunks of equal content: copies and lines that could go."""
    c = _contents(spark, base).select("chunk_id", F.sha2("content", 256).alias("h"), (F.col("line_end") - F.col("line_start")).alias("span")).groupBy("chunk_id", "h").agg(F.max("span").alias("span"))
    g = c.groupBy("h").agg(F.count("*").alias("copies"), F.min("chunk_id").alias("first_id"), (F.sum("span") - F.max_by("span", -F.col("chunk_id"))).alias("lines"))
    return g.where("copies > 1").select("first_id", "copies", F.col("lines").cast("long").alias("lines"))


def a25_common_folder(spark, base):
    """The longest common folder of each repository's files."""
    c = load(spark, base, "code_chunks").groupBy("repository_id").agg(F.min("file_path").alias("a"), F.max("file_path").alias("b"))
    x, y = paths.segments(F.col("a")), paths.segments(F.col("b"))
    same = F.filter(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda i: F.slice(x, 1, i) == F.slice(y, 1, i))
    return c.select("repository_id", F.concat_ws("/", F.slice(x, 1, F.size(same))).alias("prefix"))


def a30_dashboard(spark, base):
    o = load(spark, base, "orders").select(F.round(F.pmod(F.col("o_totalprice"), F.lit(100.0)), 2).alias("s"), "o_orderstatus")
    return o.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("s") >= 80).alias("healthy"),
        F.count_if((F.col("s") < 60) & (F.col("s") != 0)).alias("attention"),
        F.round(F.avg(F.coalesce(F.col("s"), F.lit(0.0)).cast("decimal(12,2)")).cast("double"), 4).alias("average"),
    )


# ------------------------------------------------------------ churn, scores, metrics


def hot_spots(spark, base):
    c = churn.file_churn(_changes(spark, base), NOW, 730, 90)
    cover = load(spark, base, "part").select(F.concat(F.lit("services/part_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path"), (F.when(F.col("p_size") > 5, F.col("p_size") / 50.0)).alias("line_rate"))
    h = churn.hot_spots(c, cover, 5)
    return h.select("file_path", "changes", "changes_short", "authors", "lines_added", F.round("risk_score", 3).alias("risk_score"), F.size("risk_factors").alias("factors"))


def c5_actions(spark, base):
    """What to do about each hot spot."""
    c = churn.file_churn(_changes(spark, base), NOW, 730, 90)
    cover = load(spark, base, "part").select(F.concat(F.lit("services/part_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path"), (F.when(F.col("p_size") > 5, F.col("p_size") / 50.0)).alias("line_rate"))
    return churn.hot_spots(c, cover, 5).select("file_path", scoring.suggested_action(F.col("changes"), F.col("authors"), F.col("line_rate")).alias("action"))


def c3_health(spark, base):
    """Architecture health of each repository: undocumented functions stand for dead ones, long files for hot ones, far vectors for outliers."""
    c = _chunks(spark, base, "repository_id", "file_path", "chunk_type", "docstring", "line_end")
    fn = F.col("chunk_type").isin("function", "method")
    per = c.groupBy("repository_id").agg(
        F.count_if(fn & F.col("docstring").isNull()).alias("dead"), F.count_if(fn).alias("functions"), F.count("*").alias("chunks"),
        F.countDistinct("file_path").alias("files"), F.countDistinct(F.when(F.col("line_end") > 300, F.col("file_path"))).alias("hot"),
    )
    o = load(spark, base, "outlier_info").select("file_path").distinct().join(c.select("repository_id", "file_path").distinct(), "file_path").groupBy("repository_id").agg(F.count("*").alias("outliers"))
    m = per.join(o, "repository_id", "left").withColumn("outliers", F.coalesce("outliers", F.lit(0)))
    return m.select("repository_id", scoring.health_score(*(F.col(x) for x in ("dead", "functions", "hot", "files", "outliers", "chunks"))).alias("health"))


def v8_resolved_refs(spark, base):
    """Commits that branches, hashes and empty references of each repository stand for; branches are named after languages here."""
    c = load(spark, base, "code_chunks")
    branches = c.where("language IS NOT NULL").groupBy("repository_id", F.lower("language").alias("branch")).agg(F.max("commit_sha").alias("commit_sha"))
    asked = c.select("repository_id", F.explode(F.array(F.col("commit_sha"), F.lit(" refs/heads/python "), F.lit("rust"), F.lit(""), F.lit(None))).alias("ref"))
    return refs.resolved(asked, branches, c.groupBy("repository_id").agg(F.min("commit_sha").alias("commit_sha")))


def a9_churn(spark, base):
    return churn.file_churn(_changes(spark, base), NOW, 365, 30).select("file_path", "changes", "changes_short", "authors", "lines_added")


def c1_dead_code_impact(spark, base):
    c = load(spark, base, "code_chunks").where("chunk_type IN ('function', 'method')").groupBy("chunk_id").agg(F.max("file_path").alias("file_path"), F.max("line_count").alias("lines"), F.max("cyclomatic_complexity").alias("cc"))
    score = scoring.dead_code_impact(F.col("lines"), F.col("file_path"), F.lit(None).cast("double"), F.col("cc"))
    return c.select("chunk_id", F.round(score, 3).alias("impact"))


def _known_language() -> F.Column:
    """The language of a chunk; where it is null, the path tells it."""
    return F.coalesce(F.lower("language"), paths.language(F.col("file_path")))


def m7_heuristics(spark, base):
    """Lines, notes, comments, missing documentation and hints of every chunk with content."""
    c = _contents(spark, base)
    return c.select("chunk_id", *quality.heuristics(F.col("content"), _known_language()), text.magic_numbers(F.col("content")).alias("magic")).distinct()


def m8_code_findings(spark, base):
    """Names and numbers that say nothing, by syntax in Python and scripts, by pattern in other languages."""
    return quality.code_findings(_contents(spark, base), language=_known_language()).distinct()


def a8_counts(spark, base):
    """Names and numbers that count, per repository."""
    per = quality.counted(m8_code_findings(spark, base)).withColumnRenamed("id", "chunk_id")
    return _chunks(spark, base, "repository_id").join(per, "chunk_id").groupBy("repository_id").agg(F.sum("generic").alias("generic"), F.sum("magic").alias("magic"))


def _files(spark, base):
    """Files of chunks with their lines."""
    return load(spark, base, "code_chunks").groupBy("repository_id", F.col("file_path").alias("path")).agg(F.max("line_end").alias("lines"))


def m3_architecture(spark, base):
    return quality.architecture_scores(_files(spark, base))


def _metrics(spark, base, found: DataFrame | None):
    """What the index and the issue rules are made of, per repository; ``found`` has counts of names and numbers by syntax."""
    c = _contents(spark, base)
    own = c.select("chunk_id", "repository_id", "file_path", "line_count", "cyclomatic_complexity", *quality.heuristics(F.col("content"), _known_language()), text.magic_numbers(F.col("content")).alias("shape")).distinct()
    if found is None:
        own = own.withColumn("generic", F.lit(0)).withColumn("magic", F.col("shape"))
    else:
        parsed = F.coalesce(F.col("read"), F.lit(False))
        own = own.join(found, "chunk_id", "left").withColumn("generic", F.coalesce("generic", F.lit(0))).withColumn("magic", F.when(parsed, F.coalesce("magic", F.lit(0))).otherwise(F.col("shape")))
    return own.groupBy("repository_id").agg(
        F.countDistinct("file_path").alias("files"),
        *(F.sum(x).cast("long").alias(x) for x in ("lines", "generic", "magic", "todo", "comments", "nodoc", "notypes")),
        F.avg(F.col("cyclomatic_complexity").cast("decimal(12,4)")).cast("double").alias("cc"),
        F.count_if(F.col("cyclomatic_complexity") > 10).alias("complex"),
        F.count_if(F.col("line_count") > 300).alias("long_files"),
    )


def m1_quality_index(spark, base):
    """The index of each repository from counts that patterns give; ``m1_full_index`` has those of syntax, too."""
    return _index(_metrics(spark, base, None), m3_architecture(spark, base))


def m1_full_index(spark, base):
    """The index of each repository, names and numbers counted by syntax where there is a parser."""
    found = quality.counted(m8_code_findings(spark, base)).withColumnRenamed("id", "chunk_id")
    read = _contents(spark, base).where(_known_language().isin("python", "javascript", "typescript")).select("chunk_id", F.lit(True).alias("read")).distinct()
    return _index(_metrics(spark, base, read.join(found, "chunk_id", "left")), m3_architecture(spark, base))


def _index(per: DataFrame, architecture: DataFrame) -> DataFrame:
    per = per.join(architecture, "repository_id")
    h = scoring.heuristics_score(*(F.col(c) for c in ("files", "lines", "generic", "magic", "nodoc", "notypes", "todo", "long_files")))
    v = scoring.quality_index(scoring.complexity_score(F.coalesce("cc", F.lit(5.0)), F.col("long_files")), F.col("files"), F.col("magic"), h, F.col("architecture"))
    return per.select("repository_id", "files", "lines", "magic", "todo", "nodoc", "notypes", "architecture", v.alias("vci"))


def m2_basic_index(spark, base):
    """The index from complexity and lines a file alone."""
    files = _files(spark, base).groupBy("repository_id").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.count_if(F.col("lines") > 300).alias("long_files"))
    cc = _chunks(spark, base, "repository_id", "cyclomatic_complexity").groupBy("repository_id").agg(F.avg(F.col("cyclomatic_complexity").cast("decimal(12,4)")).cast("double").alias("cc"))
    return files.join(cc, "repository_id").select("repository_id", F.round(scoring.basic_index(F.coalesce("cc", F.lit(5.0)), F.col("files"), F.col("lines"), F.col("long_files")), 1).alias("vci"))


def m5_f22_issue_rules(spark, base):
    return quality.issues_of(_metrics(spark, base, None))


def m9_chunk_complexity(spark, base):
    """Complexity of every chunk with content, whatever its language."""
    return _contents(spark, base).select("chunk_id", text.cyclomatic_complexity(F.col("content"), _known_language()).alias("cc")).distinct()


def a7_merged_complexity(spark, base):
    """Totals of two tools merged: Python chunks as the one, all other languages as the other."""
    c = _chunks(spark, base, "repository_id", "language", "line_count", "cyclomatic_complexity").where("cyclomatic_complexity IS NOT NULL")
    cc = F.col("cyclomatic_complexity").cast("int")
    source = F.when(F.lower("language") == "python", "syntax").otherwise("tokens")
    f = c.select("repository_id", source.alias("source"), cc.alias("complexity"), scoring.complexity_rank(cc).alias("rank"), F.col("line_count").alias("nloc"))
    m = quality.merged_complexity(quality.complexity_partials(f, "repository_id"), "repository_id")
    return m.withColumn("avg", F.round("avg", 4))


def a3_most_complex(spark, base):
    """The ten most complex chunks of each language."""
    c = load(spark, base, "code_chunks").groupBy("chunk_id").agg(F.lower(F.max("language")).alias("language"), F.max("cyclomatic_complexity").alias("cc")).where("cc IS NOT NULL AND language IS NOT NULL")
    k = F.row_number().over(W.partitionBy("language").orderBy(F.desc("cc"), "chunk_id"))
    return c.withColumn("k", k).where("k <= 10").select("language", "chunk_id", "cc", "k")


def a2_u7_languages(spark, base):
    """The languages of each repository, and those besides Python."""
    all_of = F.sort_array(F.collect_set(F.lower("language")))
    return load(spark, base, "code_chunks").groupBy("repository_id").agg(all_of.alias("l")).select("repository_id", F.concat_ws(",", "l").alias("languages"), F.concat_ws(",", F.array_except("l", F.array(F.lit("python")))).alias("others"))


def a10_repository_stats(spark, base):
    """Vectors, files, most frequent language (ties by name) and cohesion of each repository."""
    v = _vectors(spark, base)
    lang = v.where("language IS NOT NULL").groupBy("repository_id", F.lower("language").alias("l")).agg(F.count("*").alias("n")).groupBy("repository_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "l")).alias("x"))
    stats = v.groupBy("repository_id").agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"))
    return stats.join(lang, "repository_id", "left").select("repository_id", "chunks", "files", F.col("x.l").alias("dominant"))


def a13_outlier_share(spark, base):
    """Outliers, and their percent of all vectors."""
    n, v = load(spark, base, "outlier_info").distinct().agg(F.count("*").alias("outliers")), _vectors(spark, base).agg(F.countDistinct("vec_id").alias("chunks"))
    return n.join(v).select("outliers", "chunks", F.when(F.col("chunks") > 0, F.round(100.0 * F.col("outliers") / F.col("chunks"), 1)).otherwise(0.0).alias("percent"))


def a22_hot_concerns(spark, base):
    """Hot spots in one row: how many, the one of most changes, how many with less than half covered."""
    c = churn.file_churn(_changes(spark, base), NOW, 730, 90).where("changes > 5")
    cover = load(spark, base, "part").select(F.concat(F.lit("services/part_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path"), (F.when(F.col("p_size") > 5, F.col("p_size") / 50.0)).alias("line_rate"))
    j = c.join(cover, "file_path", "left")
    return j.agg(F.count("*").alias("n"), F.max_by("file_path", F.struct("changes", "file_path")).alias("most_changed"), F.count_if(F.col("line_rate") < 0.5).alias("untested"))


def a23_scan_totals(spark, base):
    """Per thread: tokens, models' cost at a rate, and the first answer with text."""
    m = load(spark, base, "chat_messages").groupBy("message_id").agg(F.max(F.struct("updated_at", "thread_id", "tokens_used", "created_at", "content")).alias("r")).select("message_id", "r.*")
    said = F.when(F.trim("content") != "", F.struct("created_at", "message_id", F.length("content").alias("chars")))
    return m.where("thread_id IS NOT NULL").groupBy("thread_id").agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("tokens_used"), F.lit(0)) / 1000 * 0.003, 6).alias("cost"), F.min(said)["message_id"].alias("first_message"))


def a31_counters(spark, base):
    """Counts of clusters, outliers, places that want work, in one row."""
    clusters = load(spark, base, "cluster_info").agg(F.countDistinct("id").alias("clusters"))
    o = load(spark, base, "outlier_info").distinct()
    low = F.least(F.count_if(F.col("nearest_similarity") < 0.4), F.lit(10))
    spots = load(spark, base, "chunk_matches").groupBy("file_path").agg(F.countDistinct("chunk_type").alias("kinds")).agg(F.count_if(F.col("kinds") >= 2).alias("spots"))
    return clusters.join(o.agg(F.count("*").alias("outliers"), low.alias("low"))).join(spots).select("clusters", "outliers", (F.col("spots") + F.col("low")).alias("debt"))


def a33_axis(spark, base):
    """The axis of each customer's score chart."""
    o = load(spark, base, "orders").select("o_custkey", F.round(F.pmod(F.col("o_totalprice"), F.lit(100.0)), 2).alias("s"))
    return o.groupBy("o_custkey").agg(F.round(F.greatest(F.lit(0.0), F.min("s") - 10), 2).alias("low"), F.round(F.least(F.lit(100.0), F.max("s") + 10), 2).alias("high"))


def u9_debt_spots(spark, base):
    """Files of several kinds of hits (critical from four kinds), and the ten first outliers far from everything."""
    hot = load(spark, base, "chunk_matches").where("file_path IS NOT NULL").groupBy("file_path").agg(F.countDistinct("chunk_type").alias("kinds")).where("kinds >= 2")
    far = load(spark, base, "outlier_info").where("nearest_similarity < 0.4").groupBy("file_path").agg(F.min("nearest_similarity").alias("s")).orderBy("s", "file_path").limit(10)
    return hot.select("file_path", F.lit("coupling").alias("why"), F.when(F.col("kinds") >= 4, "critical").otherwise("high").alias("severity")).unionByName(far.select("file_path", F.lit("outlier").alias("why"), F.lit("medium").alias("severity")))


def f10_worst_first(spark, base):
    """The first ten orders of the two highest priorities."""
    o = load(spark, base, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return o.orderBy("o_orderkey").limit(10).select("o_orderkey", "o_orderpriority")


def f9_open_findings(spark, base):
    """Clusters that are not dismissed."""
    return load(spark, base, "cluster_info").where("status IS NULL OR lower(trim(status)) <> 'dismissed'").select("id", "name").distinct()


def t3_t4_pages(spark, base):
    """Pages of a customer's orders: how many, and whether a page of ten has one after it."""
    per = load(spark, base, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"))
    return per.select("o_custkey", "total", F.ceil(F.col("total") / 10).alias("pages"), (F.col("total") > 10).alias("has_more"))


def t9_dead_by_impact(spark, base):
    """The twenty functions of the highest impact, were they dead."""
    return c1_dead_code_impact(spark, base).orderBy(F.desc("impact"), "chunk_id").limit(20)


def s8_t12_view_files(spark, base):
    """Files that belong into a view of their repository, numbered by priority and path."""
    p = load(spark, base, "repo_content_objects").where("path IS NOT NULL").select("cache_id", "path").distinct().where(paths.is_included(F.col("path")))
    rank = paths.priority(F.col("path"))
    return p.select("cache_id", "path", rank.alias("priority"), F.row_number().over(W.partitionBy("cache_id").orderBy(rank, "path")).alias("nth"))


def d2_excerpts(spark, base):
    """Texts of more than 1,000 characters as their beginning and end."""
    return _contents(spark, base).select("chunk_id", F.length(text.excerpt(F.col("content"), 1_000, 400)).alias("chars"), F.md5(text.excerpt(F.col("content"), 1_000, 400)).alias("digest")).distinct()


def d4_line_ranges(spark, base):
    """Lines 3 to 5 of every chunk."""
    return _contents(spark, base).select("chunk_id", F.array_join(F.slice(F.split("content", "\n"), 3, 3), "\n").alias("lines")).distinct()


def j7_dead_with_recency(spark, base):
    """As c1_dead_code_impact, with the days since the file was last stored."""
    c = load(spark, base, "code_chunks").where("chunk_type IN ('function', 'method')").groupBy("chunk_id").agg(F.max("file_path").alias("path"), F.max("line_count").alias("lines"), F.max("cyclomatic_complexity").alias("cc"))
    o = load(spark, base, "repo_content_objects").groupBy(paths.tidy(F.col("path")).alias("path")).agg(F.max("created_at").alias("at"))
    days = F.datediff(F.lit("2026-01-01").cast("date"), F.col("at").cast("date")).cast("double")
    return c.join(o, "path", "left").select("chunk_id", F.round(scoring.dead_code_impact(F.col("lines"), F.col("path"), days, F.col("cc")), 3).alias("impact"))


def i1_u11_merged(spark, base):
    """Outliers merged where they share a file and read alike, with what a group says together."""
    o = load(spark, base, "outlier_info").distinct()
    i = o.select(
        F.abs(F.xxhash64(*o.columns)).alias("id"), F.unix_micros("computed_at").alias("ord"), F.concat_ws(" ", "chunk_name", "suggestion").alias("title"), F.col("suggestion").alias("summary"),
        F.array("file_path").alias("files"), F.coalesce("confidence_factors", F.array().cast("array<string>")).alias("evidence"), F.col("tier").alias("source"), F.col("tier").alias("confidence"),
    ).groupBy("id").agg(*(F.min(c).alias(c) for c in ("ord", "title", "summary", "files", "evidence", "source", "confidence")))
    seeds = Scratch(spark, "merged").save(findings.merge_issues(i.select("id", "ord", "files", F.col("title").alias("text"))))
    return findings.merged_fields(i, seeds).withColumnRenamed("seed", "id")


def v3_outlier_confidence(spark, base):
    o = load(spark, base, "outlier_info").where("nearest_similarity IS NOT NULL").distinct()
    none = F.lit(False)
    conf = scoring.outlier_confidence(F.coalesce("chunk_name", F.lit("")), F.col("file_path"), F.col("nearest_file"), F.col("nearest_similarity"), none, none, F.lit(0))
    return o.select("file_path", "chunk_name", "nearest_similarity", conf.alias("confidence_now"), scoring.tier(conf).alias("tier_now")).distinct()


# ------------------------------------------------------------ windows and top-k


def w2_newest_uploads(spark, base):
    o = load(spark, base, "repo_content_objects").distinct()
    k = F.row_number().over(W.partitionBy("cache_id").orderBy(F.desc("created_at"), "object_id"))
    return o.withColumn("k", k).where("k <= 5").select("cache_id", "object_id", "k")


def w4_history(spark, base):
    """Scores per customer in order, with the one before and the trend over three."""
    o = load(spark, base, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.round(F.pmod(F.col("o_totalprice"), F.lit(100.0)), 2).alias("s"))
    one = ordered.with_previous(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["s"]).withColumnRenamed("prev_s", "prev")
    two = ordered.with_previous(one, "o_custkey", ["o_orderdate", "o_orderkey"], ["prev"])
    t = two.withColumn("d", F.round(F.col("s") - F.coalesce("prev_prev", "prev", "s"), 2))
    return t.select("o_custkey", "o_orderkey", "s", "prev", F.when(F.col("d") > 5, "improving").when(F.col("d") < -5, "declining").otherwise("stable").alias("trend"))


def w5_numbered(spark, base):
    o = load(spark, base, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"))
    pre = {"1-URGENT": "sec", "2-HIGH": "db", "3-MEDIUM": "api"}
    return findings.numbered(o, pre, "kind", ["o_orderkey"]).select("o_orderkey", "label")


def w8_context_switches(spark, base):
    m = load(spark, base, "chat_messages").groupBy("message_id").agg(F.min(F.struct("thread_id", "created_at", "context_ref")).alias("r")).select("message_id", "r.*")
    seen = ordered.with_previous(m, "thread_id", ["created_at", "message_id"], ["context_ref"], filled=True).withColumnRenamed("prev_context_ref", "was")
    return seen.where("was IS NOT NULL AND context_ref IS NOT NULL AND was <> context_ref").select("message_id", "was", "context_ref")


def w14_last_messages(spark, base):
    m = load(spark, base, "chat_messages").groupBy("message_id").agg(F.min(F.struct("thread_id", "created_at")).alias("r")).select("message_id", "r.*")
    k = F.row_number().over(W.partitionBy("thread_id").orderBy(F.desc("created_at"), F.desc("message_id")))
    return m.withColumn("k", k).where("k <= 10").select("thread_id", "message_id", "k")


def t5_most_complex(spark, base):
    c = load(spark, base, "code_chunks").groupBy("chunk_id").agg(F.max("cyclomatic_complexity").alias("cc"), F.max("name").alias("name")).where("cc IS NOT NULL")
    return c.orderBy(F.desc("cc"), "chunk_id").limit(10)


def t13_recent_threads(spark, base):
    t = load(spark, base, "chat_threads").distinct()
    return t.orderBy(F.desc("updated_at"), "thread_id").limit(20).select("thread_id", "model")


def t1_page(spark, base):
    o = load(spark, base, "orders")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_custkey")


# ------------------------------------------------------------ sets


def u1_context_first(spark, base):
    query = [0.5 if i % 2 else -0.25 for i in range(128)]
    v = _vectors(spark, base)
    file = v.agg(F.min("file_path")).scalar()
    return search.context_first(v, query, file).select("vec_id", "branch", "score")


def u8_findings(spark, base):
    a = load(spark, base, "outlier_info").distinct().select(F.lit("outlier").alias("kind"), "file_path", F.round(100 * F.col("confidence"), 2).alias("score"))
    b = load(spark, base, "cluster_info").distinct().where("cohesion < 0.5").select(F.lit("scattered").alias("kind"), F.col("name").alias("file_path"), F.round(100 * (1 - F.col("cohesion")), 2).alias("score"))
    return a.unionByName(b)


def g3_unreachable(spark, base):
    """Customers, suppliers and orders that region 0 does not lead to over keys."""
    t = {n: load(spark, base, n) for n in ("region", "nation", "customer", "supplier", "orders")}
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda n, p, c, q, d: t[n].select(tag(p, c).alias("caller_id"), tag(q, d).alias("callee_id"))
    edges = edge("nation", "r", "n_regionkey", "n", "n_nationkey").union(edge("customer", "n", "c_nationkey", "c", "c_custkey")).union(edge("supplier", "n", "s_nationkey", "s", "s_suppkey")).union(edge("orders", "c", "o_custkey", "o", "o_orderkey"))
    nodes = edges.select(F.col("callee_id").alias("id")).distinct()
    entries = t["region"].where("r_regionkey = 0").select(tag("r", "r_regionkey").alias("id"))
    return graph.unreachable(nodes, entries, edges)


# ------------------------------------------------------------ writes


def k6_new_uploads(spark, base):
    o = load(spark, base, "repo_content_objects").select("cache_id", "path", "status", "size_bytes").distinct()
    old = o.where("status = 'ready'")
    return sinks.new_only(old, o.where("status <> 'ready'").select("cache_id", "path", "size_bytes"), "cache_id", "path")


def k7_upsert(spark, base):
    c = load(spark, base, "cluster_info").groupBy("id").agg(F.max("name").alias("name"), F.max("file_count").alias("file_count"))
    new = c.where("file_count > 3").select("id", (F.col("file_count") + 1).alias("file_count"))
    return sinks.upsert(c, new, "id").select("id", "name", "file_count")


# ------------------------------------------------------------ events


def r_windows(spark, base):
    w = state.windowed_counts(load(spark, base, "events"), "ts", "event_type")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "events")


def r2_last_values(spark, base):
    return state.last_values(load(spark, base, "events"), "user_id", "ts", "event_id", "event_type").select("user_id", "event_id", "event_type")


def r4_transitions(spark, base):
    allowed = [("none", "signup"), ("none", "view"), ("signup", "view"), ("view", "view"), ("view", "click"), ("click", "view"), ("click", "purchase"), ("purchase", "view")]
    e = state.checked_transitions(load(spark, base, "events"), "user_id", "ts", "event_id", "event_type", allowed)
    return e.groupBy("before", F.col("event_type").alias("after"), "valid").agg(F.count("*").alias("n"))


def r_sessions(spark, base):
    return state.sessions(load(spark, base, "events"), "user_id", "ts", "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


def w12_heartbeats(spark, base):
    return state.heartbeats(load(spark, base, "events"), "user_id", "ts", "event_id", 3600).groupBy("user_id").agg(F.count("*").alias("beats"))


def i2_json_fields(spark, base):
    e = load(spark, base, "events")
    return e.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


def d4_grep(spark, base):
    """Lines of contents that raise an error."""
    c = _contents(spark, base).select("chunk_id", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    return c.where(F.col("line").rlike(r"\braise \w+|\bthrow new \w+")).select("chunk_id", (F.col("i") + 1).alias("line_no"), F.trim("line").alias("line")).distinct()


# ------------------------------------------------------------ lists, counts and look-ups


def f1_filtered_chunks(spark, base):
    c = load(spark, base, "code_chunks")
    one = c.where((F.lower("language") == "go") & (F.col("chunk_type") == "method") & ~F.col("file_path").startswith("tests/"))
    return one.select("chunk_id", "file_path", F.substring("commit_sha", 1, 7).alias("short_sha"), F.substring("content", 1, 100).alias("head")).distinct()


def f11_sensitive_paths(spark, base):
    """Paths that name secrets or environments."""
    marks = [".env", "secret", "credential", "private", "token", "password", ".pem", "id_rsa"]
    low = F.lower("path")
    return load(spark, base, "repo_content_objects").where(F.exists(F.array(*map(F.lit, marks)), lambda m: low.contains(m))).select("path").distinct()


def a22_concerns(spark, base):
    """Per repository: functions without documentation, their lines, and the longest one."""
    c = load(spark, base, "code_chunks").where("chunk_type = 'function' AND docstring IS NULL").select("chunk_id", "repository_id", "line_count").distinct()
    return c.groupBy("repository_id").agg(F.count("*").alias("n"), F.sum("line_count").alias("lines"), F.max_by("chunk_id", F.struct("line_count", "chunk_id")).alias("longest"))


def a23_token_totals(spark, base):
    m = load(spark, base, "chat_messages").groupBy("message_id").agg(F.max(F.struct("updated_at", "thread_id", "tokens_used")).alias("r")).select("r.thread_id", "r.tokens_used")
    t = load(spark, base, "chat_threads").select("thread_id", "model").distinct()
    return m.join(t, "thread_id").groupBy("model").agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"), F.count("*").alias("messages"), F.countDistinct("thread_id").alias("threads"))


def a26_hit_scores(spark, base):
    m = load(spark, base, "chunk_matches").distinct().where("similarity IS NOT NULL AND NOT isnan(similarity) AND query_chunk_id IS NOT NULL")
    return m.groupBy("query_chunk_id").agg(F.count("*").alias("hits"), F.round(F.avg(F.col("similarity").cast("decimal(10,6)")).cast("double"), 4).alias("mean_score"))


def j2_thread_counts(spark, base):
    """Threads with the messages they really have."""
    m = load(spark, base, "chat_messages").select("thread_id", "message_id").distinct().groupBy("thread_id").agg(F.count("*").alias("found"))
    t = load(spark, base, "chat_threads").select("thread_id", "message_count").distinct()
    return t.join(m, "thread_id", "left").select("thread_id", "message_count", F.coalesce("found", F.lit(0)).alias("found"))


def j4_indexed_files(spark, base):
    """Stored paths, each with whether any chunk was indexed from it."""
    o = load(spark, base, "repo_content_objects").select(paths.tidy(F.col("path")).alias("path")).distinct()
    c = load(spark, base, "code_chunks").select(F.col("file_path").alias("path")).distinct().withColumn("there", F.lit(True))
    return o.join(c, "path", "left").select("path", F.coalesce("there", F.lit(False)).alias("indexed"))


def j18_outlier_clusters(spark, base):
    """Outliers with the smallest cluster that has their nearest file among its top files."""
    c = load(spark, base, "cluster_info").select("id", F.explode("top_files").alias("nearest_file")).distinct()
    o = load(spark, base, "outlier_info").select("file_path", "chunk_name", "nearest_file").distinct()
    return o.join(c, "nearest_file", "left").groupBy("file_path", "chunk_name", "nearest_file").agg(F.min("id").alias("cluster_id"))


def t2_by_severity(spark, base):
    o = load(spark, base, "orders")
    return o.orderBy("o_orderpriority", F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


def t6_top_outliers(spark, base):
    o = load(spark, base, "outlier_info").distinct().where("confidence >= 0.4")
    return o.orderBy(F.desc("confidence"), "file_path", "chunk_name").limit(15).select("file_path", "chunk_name", "confidence")


def w1_retention(spark, base):
    """Orders to prune: not among a customer's newest three and older than a year before the last day."""
    o = load(spark, base, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    newest = o.withColumn("k", k).where("k <= 3").select("o_orderkey")
    return o.where(F.col("o_orderdate") < F.lit("2000-11-04").cast("timestamp_ntz")).join(newest, "o_orderkey", "left_anti").select("o_custkey", "o_orderkey")


def w15_tree_lines(spark, base):
    return render.tree_lines(s4_full_tree(spark, base), 3)


# ------------------------------------------------------------ without a SQL twin


def w7_similar_groups(spark, base):
    """Greedy groups of chunks of cosine 0.9 or more inside a repository."""
    return duplicates.greedy_groups(duplicates.similar_pairs(_vectors(spark, base), 0.9, 128))


def j12_similar_pairs(spark, base):
    """Pairs of distinct vectors of cosine 0.95 or more inside a repository; copies link to their first."""
    return duplicates.similar_pairs(_vectors(spark, base), 0.95, 128).drop("copy")


def v4_cluster_health(spark, base):
    c = load(spark, base, "cluster_info").groupBy("id").agg(F.max("cohesion").alias("cohesion"), F.max("chunk_count").alias("chunk_count")).where("cohesion IS NOT NULL")
    return health.cluster_health(c, load(spark, base, "outlier_info").distinct().agg(F.count("*")).scalar(), _vectors(spark, base).agg(F.count("*")).scalar(), 0, 0)


def u10_suggestions(spark, base):
    hot = load(spark, base, "chunk_matches").groupBy("file_path").agg(F.countDistinct("chunk_type").alias("kinds")).where("kinds >= 2")
    groups = w7_similar_groups(spark, base).groupBy("seed").agg(F.count("*").alias("chunks"))
    return health.suggestions(hot, load(spark, base, "outlier_info").distinct(), load(spark, base, "cluster_info").distinct(), groups)


def v1_density_clusters(spark, base):
    return hdbscan.clusters(_vectors(spark, base))


def m10_chunks(spark, base):
    return chunker.chunk_files(_contents(spark, base).select(F.concat_ws("/", F.col("chunk_id").cast("string"), "file_path").alias("file_path"), "content").groupBy("file_path").agg(F.min("content").alias("content")))


def w6_diverse_sample(spark, base):
    c = load(spark, base, "code_chunks").groupBy("chunk_id").agg(F.max("line_count").cast("double").alias("score"), F.max("file_path").alias("file_path"))
    return findings.diverse_sample(c.where("score IS NOT NULL"), 20, "chunk_id")


def w10_budget(spark, base):
    f = _chunks(spark, base, "repository_id", "file_path", "token_estimate").groupBy("repository_id", F.col("file_path").alias("path")).agg(F.sum("token_estimate").cast("long").alias("tokens"))
    return findings.within_budget(f, 4000)


def g1_python_symbols(spark, base):
    """Functions and calls of Python chunks, at lines of their files; where the language is null, the path tells it."""
    known = F.coalesce(F.lower("language"), paths.language(F.col("file_path")))
    return graph.extract_python(_contents(spark, base).where(known == "python").select("file_path", "content", "line_start")).distinct()


def g1_symbols(spark, base):
    """Functions, calls and marks of entry points of Python and script chunks."""
    return graph.extract_symbols(_contents(spark, base).select("file_path", "content", "line_start", "language"), _known_language()).distinct()


def _call_graph(spark, base) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions, entry points, calls); functions of one name in a file are one, the last counts."""
    s = Scratch(spark, "symbols").save(g1_symbols(spark, base))
    named = s.where("kind = 'function'").groupBy("file_path", "name")
    f = named.agg(F.max("line_start").alias("line_start"), F.max_by("line_end", F.struct("line_start", "line_end")).alias("line_end"), F.max("is_entry").alias("is_entry"))
    f = Scratch(spark, "functions").save(f.select(F.concat_ws(":", "file_path", "name").alias("id"), "*"))
    entries = f.where("is_entry").select("id").unionByName(graph.mark_entries(s.where("kind = 'mark'"), f))
    return f, entries, graph.call_links(s.where("kind = 'call'").select("file_path", F.col("line_start").alias("line"), "name"), f)


def g4_dead_functions(spark, base):
    """Functions that no entry point reaches, with size and impact."""
    return graph.dead_functions(*_call_graph(spark, base))


def g6_entry_points(spark, base):
    return _call_graph(spark, base)[1].distinct()


def j13_i1_merged_issues(spark, base):
    o = load(spark, base, "outlier_info").distinct()
    i = o.select(F.abs(F.xxhash64(*o.columns)).alias("id"), F.unix_micros("computed_at").alias("ord"), F.array("file_path").alias("files"), F.concat_ws(" ", "chunk_name", "suggestion").alias("text"))
    return findings.merge_issues(i.groupBy("id").agg(F.min("ord").alias("ord"), F.min("files").alias("files"), F.min("text").alias("text")))


def flagship(spark: SparkSession, base: str) -> DataFrame:
    """Hot spots: change log, coverage, risk."""
    return hot_spots(spark, base)


_ALL: list[Query] = [
    s6_languages, s4_full_tree, s3_embeddable, s5_line_counts, f13_f16_embedding_text, f14_children, f17_grades, f21_priorities, j3_latest_upload, j10_nearest, j11_top_k, j14_imports, j15_orphans,
    u3_shared_imports, a1_totals, a3_complexity, a10_cluster_stats, a12_gini, a14_spread_files, a15_mean_vectors, a17_a32_severities, a19_cache_sizes, a24_duplicates, a25_common_folder, a30_dashboard,
    hot_spots, a9_churn, c1_dead_code_impact, m1_quality_index, m9_chunk_complexity, v3_outlier_confidence, w2_newest_uploads, w4_history, w5_numbered, w8_context_switches, w14_last_messages,
    t5_most_complex, t13_recent_threads, t1_page, u1_context_first, u8_findings, g3_unreachable, k6_new_uploads, k7_upsert, r_windows, r2_last_values, r4_transitions, r_sessions, w12_heartbeats,
    f1_filtered_chunks, f11_sensitive_paths, a22_concerns, a23_token_totals, a26_hit_scores, j2_thread_counts, j4_indexed_files, j18_outlier_clusters, t2_by_severity, t6_top_outliers,
    w1_retention, w15_tree_lines, i2_json_fields, d4_grep, w7_similar_groups, j12_similar_pairs, v4_cluster_health, u10_suggestions, v1_density_clusters, m10_chunks, w6_diverse_sample, w10_budget, v6_style_consistency, c3_health, c5_actions, v8_resolved_refs, g1_python_symbols, g1_symbols, g4_dead_functions, g6_entry_points, j13_i1_merged_issues,
    m7_heuristics, m8_code_findings, a8_counts, m3_architecture, m1_full_index, m2_basic_index, m5_f22_issue_rules, a7_merged_complexity, a3_most_complex, a2_u7_languages, a10_repository_stats, a13_outlier_share,
    a22_hot_concerns, a23_scan_totals, a31_counters, a33_axis, u9_debt_spots, f9_open_findings, f10_worst_first, t3_t4_pages, t9_dead_by_impact, s8_t12_view_files, d2_excerpts, d4_line_ranges, j7_dead_with_recency, i1_u11_merged,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(twins.SQL)
