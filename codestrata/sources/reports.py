"""Logs and reports of other tools as tables: git, coverage, complexity, model answers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.session import ship

_COMMIT = re.compile(r"^[0-9a-f]{7,40}$")
_STAT = re.compile(r"^(\d+|-)\t(\d+|-)\t(.+)$")
GIT_LOG = "commit_sha string, author string, author_ts timestamp, file_path string, lines_added int, lines_removed int"


def parse_git_log(log: str) -> Iterator[tuple]:
    """Rows of ``git log --numstat --format=%H%n%an%n%aI``; binary files are left out."""
    sha = author = when = None
    stage = 0
    for line in log.split("\n"):
        line = line.rstrip("\r")
        m = _STAT.match(line)
        if m and stage == 3:
            if m[1] != "-" and m[2] != "-":
                yield sha, author, when, m[3], int(m[1]), int(m[2])
        elif _COMMIT.match(line) and stage in (0, 3):
            sha, stage = line, 1
        elif stage == 1 and line:
            author, stage = line, 2
        elif stage == 2 and line:
            try:
                when, stage = pd.Timestamp(line).tz_convert("UTC").tz_localize(None), 3
            except (ValueError, TypeError):
                stage = 0


def read_git_logs(spark: SparkSession, path: str) -> DataFrame:
    """Change rows of git logs, one file a repository."""
    ship(spark)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [r for log in pdf["value"] for r in parse_git_log(log)]
            yield pd.DataFrame(got, columns=["commit_sha", "author", "author_ts", "file_path", "lines_added", "lines_removed"]).astype({"author_ts": "datetime64[us]"})

    return spark.read.text(path, wholetext=True).mapInPandas(rows, GIT_LOG)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, line_rate)`` of Cobertura reports: bad rates left out, rates clamped to 0..1, the last class of a file wins."""
    schema = T.StructType([T.StructField("_filename", T.StringType()), T.StructField("_line-rate", T.StringType())])
    raw = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    rate = F.expr("try_cast(`_line-rate` AS DOUBLE)")
    rows = raw.select(F.col("_filename").alias("file_path"), rate.alias("r"), F.monotonically_increasing_id().alias("ord")).where("file_path IS NOT NULL AND r IS NOT NULL AND NOT isnan(r)")
    return rows.groupBy("file_path").agg(F.max_by(F.least(F.greatest("r", F.lit(0.0)), F.lit(1.0)), "ord").alias("line_rate"))


def read_lizard(spark: SparkSession, path: str) -> DataFrame:
    """Functions of a complexity tool's CSV; rows that are short or not numbers are left out."""
    names = ["nloc", "ccn", "tokens", "params", "length", "location", "file_path", "function_name", "signature", "line_start", "line_end"]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("mode", "PERMISSIVE").csv(path)
    num = lambda c: F.expr(f"try_cast({c} AS INT)")
    out = raw.select("file_path", "function_name", num("nloc").alias("nloc"), num("ccn").alias("ccn"), num("params").alias("params"), num("line_start").alias("line_start"))
    return out.dropna(subset=["file_path", "nloc", "ccn", "params", "line_start"])


def read_metrics_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a Python metrics tool's JSON, one document a file: kind ``cc``, ``hal``, ``mi`` or ``raw``.

    Entries that are no objects (the tool puts errors there) and documents that
    are no JSON are left out; ``mi`` may be a bare number.
    """
    docs = spark.read.text(path, wholetext=True)
    if kind == "cc":
        entry = "struct<name:string,type:string,complexity:int,rank:string,lineno:int,endline:int>"
        rows = docs.select(F.explode(F.from_json("value", "map<string,string>")).alias("file_path", "x")).select("file_path", F.explode(F.from_json("x", f"array<{entry}>")).alias("f"))
        return rows.where("f.complexity IS NOT NULL").select("file_path", F.col("f.name").alias("function_name"), F.col("f.type").alias("kind"), F.col("f.complexity").alias("complexity"), F.col("f.rank").alias("rank"), F.col("f.lineno").alias("line_start"), F.col("f.endline").alias("line_end"))
    per = docs.select(F.explode(F.from_json("value", "map<string,string>")).alias("file_path", "x"))
    if kind == "hal":
        got = per.select("file_path", F.from_json("x", "struct<total:struct<volume:double,difficulty:double,effort:double,bugs:double>>").alias("t"))
        return got.where("t.total IS NOT NULL").select("file_path", "t.total.*")
    if kind == "mi":
        got = per.select("file_path", F.expr("try_cast(x AS DOUBLE)").alias("n"), F.from_json("x", "struct<mi:double,rank:string>").alias("t"), F.col("x").startswith("{").alias("obj"))
        return got.where("n IS NOT NULL OR obj").select("file_path", F.coalesce("n", "t.mi").alias("mi"), F.col("t.rank").alias("rank"))
    if kind == "raw":
        got = per.select("file_path", F.from_json("x", "struct<loc:int,lloc:int,sloc:int,comments:int,multi:int,blank:int>").alias("t"))
        return got.where("t.loc IS NOT NULL").select("file_path", "t.*")
    raise ValueError(f"kind {kind!r} is none of cc, hal, mi, raw")


def repair_json(raw: str | None) -> str | None:
    """The JSON value in a model's answer: fences and preamble cut off, trailing commas and missing ends mended."""
    if not raw:
        return None
    body = re.sub(r"^.*?```(?:json)?\s*|\s*```.*$", "", raw, flags=re.S) if "```" in raw else raw
    at = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    body = re.sub(r",\s*([}\]])", r"\1", body[at:])
    try:
        value, _ = json.JSONDecoder().raw_decode(body)
        return json.dumps(value)
    except ValueError:
        pass
    closes: list[str] = []
    quoted = escaped = False
    last = 0
    for i, c in enumerate(body):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            closes.append("}" if c == "{" else "]")
        elif c in "}]" and closes:
            closes.pop()
            last = i + 1
        if not quoted and c == "," and closes:
            last = last if last > i else i
    for cut in (len(body), last):
        text = body[:cut].rstrip().rstrip(",")
        try:
            return json.dumps(json.loads(text + ('"' if quoted and cut == len(body) else "") + "".join(reversed(closes))))
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def repaired_json(s: pd.Series) -> pd.Series:
    return s.map(repair_json)


def parse_model_answers(answers: DataFrame, column: str = "content") -> DataFrame:
    """Adds ``parsed`` (VARIANT): direct JSON stays on the JVM, only the rest is repaired in Python."""
    ship(answers.sparkSession)
    direct = F.try_parse_json(F.col(column))
    fenced = F.try_parse_json(F.regexp_extract(F.col(column), r"(?s)```(?:json)?\s*(.*?)\s*```", 1))
    return answers.withColumn("parsed", F.coalesce(direct, F.when(F.col(column).contains("```"), fenced), F.try_parse_json(repaired_json(F.col(column)))))
