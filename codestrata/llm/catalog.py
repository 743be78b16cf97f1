"""The pN_ queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import clusters, conversations, credentials, documented, link_groups, mixing, neighbors, packing, sentences, shared_spans
from codestrata.session import load


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Lines on which a credential begins."""
    return credentials.credential_lines(load(spark, base, "code_chunks")).withColumnRenamed("id", "chunk_id")


def p1_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Chunk contents with their credentials blanked."""
    return credentials.redacted(load(spark, base, "code_chunks")).withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Functions with documentation that is not trivial."""
    found = documented.documented_functions(load(spark, base, "code_chunks"), bodies=False)
    return found.select(F.col("id").alias("chunk_id"), "function_name")


def p2_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of function code and documentation."""
    return documented.documented_functions(load(spark, base, "code_chunks")).withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """The five most similar vectors of each vector, of cosine 0.85 or more."""
    return neighbors.most_similar(load(spark, base, "chunk_vectors")).select(F.col("id").alias("vec_id"), "neighbor_id")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Group of every chunk with a match of similarity 0.85 or more."""
    s = F.col("similarity")
    hits = load(spark, base, "chunk_matches").where(s.isNotNull() & ~F.isnan(s) & (s >= 0.85))
    return link_groups.link_groups(hits, "query_chunk_id", "chunk_id").select(F.col("id").alias("chunk_id"), "group_id")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Runs of characters that stand in other chunks too, in stretches of 200 or more."""
    return shared_spans.shared_spans(load(spark, base, "code_chunks")).withColumnRenamed("id", "chunk_id")


def p5_shares(spark: SparkSession, base: str) -> DataFrame:
    """How much of each chunk stands elsewhere too."""
    return shared_spans.shared_shares(load(spark, base, "code_chunks")).withColumnRenamed("id", "chunk_id")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Groups of four or more vectors, any two of cosine 0.70 or more."""
    return clusters.bounded_groups(load(spark, base, "chunk_vectors")).select(F.col("id").alias("vec_id"), "first_id")


def p6_communities(spark: SparkSession, base: str) -> DataFrame:
    """Communities of the similarity graph with their leading files."""
    return clusters.described_communities(load(spark, base, "chunk_vectors"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Messages of the kept threads in order."""
    return conversations.kept_messages(load(spark, base, "chat_messages"), load(spark, base, "chat_threads"))


def p8_packed(spark: SparkSession, base: str) -> DataFrame:
    """Container and place of every text for each container size."""
    packed = packing.packed_documents(load(spark, base, "documents"), load(spark, base, "pack_profiles"))
    return packed.withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, base: str) -> DataFrame:
    """How full the containers of each size are."""
    profiles = load(spark, base, "pack_profiles")
    return packing.fill_report(packing.packed_documents(load(spark, base, "documents"), profiles), profiles)


def p9_mixed(spark: SparkSession, base: str) -> DataFrame:
    """Every use of every text, in training order."""
    return mixing.mixed_documents(load(spark, base, "documents"), load(spark, base, "mix_targets")).withColumnRenamed("id", "doc_id")


def p9_uses(spark: SparkSession, base: str) -> DataFrame:
    """How often each text is used."""
    used = p9_mixed(spark, base).groupBy("doc_id").agg(F.count("*").alias("times"))
    docs = load(spark, base, "documents").select("doc_id", "source").distinct()
    return docs.join(used, "doc_id", "left").select("doc_id", "source", F.coalesce("times", F.lit(0)).alias("times"))


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    """The share each source reaches."""
    return mixing.shares_reached(p9_mixed(spark, base), load(spark, base, "mix_targets"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """Sentences of every document."""
    return sentences.sentence_spans(load(spark, base, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_shares": p5_shares,
    "p6_communities": p6_communities,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_mixed": p9_mixed,
    "p9_uses": p9_uses,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}

_SPANS = """
WITH c AS (SELECT DISTINCT chunk_id, content FROM code_chunks WHERE length(content) >= 200),
w AS (SELECT chunk_id, content, unnest(range(0, length(content) - 199)) AS s FROM c),
h AS (SELECT chunk_id, s, substr(content, CAST(s + 1 AS BIGINT), 200) AS t FROM w),
b AS (SELECT t FROM h GROUP BY t HAVING min(chunk_id) <> max(chunk_id)),
p AS (SELECT DISTINCT chunk_id, s FROM h WHERE t IN (SELECT t FROM b)),
g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY chunk_id ORDER BY s) <= 200 THEN 0 ELSE 1 END AS cut FROM p),
r AS (SELECT *, sum(cut) OVER (PARTITION BY chunk_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM g),
spans AS (SELECT chunk_id, CAST(min(s) AS INTEGER) AS span_start, CAST(max(s) + 200 AS INTEGER) AS span_end FROM r GROUP BY chunk_id, run)
"""

ORACLE: dict[str, str] = {
    "p3_found": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM (SELECT DISTINCT vec_id, embedding FROM chunk_vectors)
  WHERE len(embedding) = 128 AND list_max(embedding) IS NOT NULL AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)),
p AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbor_id) AS k FROM p WHERE c >= 0.85)
SELECT vec_id, neighbor_id FROM r WHERE k <= 5
""",
    "p4_found": """
WITH RECURSIVE m AS (
  SELECT DISTINCT query_chunk_id AS a, chunk_id AS b FROM chunk_matches
  WHERE query_chunk_id <> chunk_id AND similarity IS NOT NULL AND NOT isnan(similarity) AND similarity >= 0.85),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
r AS (SELECT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
SELECT v AS chunk_id, min(u) AS group_id FROM r GROUP BY v
""",
    "p5_found": _SPANS + "SELECT chunk_id, span_start, span_end FROM spans",
    "p5_shares": _SPANS
    + """
SELECT s.chunk_id, count(*) AS spans, sum(span_end - span_start) AS shared_chars, round(CAST(sum(span_end - span_start) AS DOUBLE) / max(n), 6) AS shared_share
FROM spans s JOIN (SELECT chunk_id, max(length(content)) AS n FROM code_chunks GROUP BY 1) z ON s.chunk_id = z.chunk_id GROUP BY s.chunk_id
""",
    "p6_found": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM (SELECT DISTINCT vec_id, embedding FROM chunk_vectors)
  WHERE len(embedding) = 128 AND list_max(embedding) IS NOT NULL AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)),
n AS (
  SELECT a.vec_id, list_sort(list(b.vec_id)) AS near FROM v a JOIN v b ON a.vec_id = b.vec_id OR round(list_cosine_similarity(a.e, b.e), 6) >= 0.70 GROUP BY a.vec_id),
g AS (SELECT near FROM n GROUP BY near HAVING count(*) = len(near) AND len(near) >= 4)
SELECT vec_id, near[1] AS first_id FROM n WHERE near IN (SELECT near FROM g)
""",
    "p7_found": """
WITH d AS (
  SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY updated_at DESC, created_at DESC) AS k FROM chat_messages),
m AS (
  SELECT message_id, thread_id, created_at, nullif(regexp_extract(lower(role), '^\\s*(?:[a-z_]\\w*\\.)?(system|user|assistant)\\s*$', 1), '') AS r,
         coalesce(trim(content, ' ' || chr(9) || chr(10) || chr(13)), '') <> '' AS filled FROM d WHERE k = 1),
o AS (
  SELECT *, CASE r WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS rr FROM m),
n AS (
  SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at, rr, message_id) AS turn_no,
         sum(CASE WHEN r = 'system' THEN 0 ELSE 1 END) OVER (PARTITION BY thread_id ORDER BY created_at, rr, message_id ROWS UNBOUNDED PRECEDING) AS nth FROM o),
k AS (
  SELECT thread_id FROM n GROUP BY thread_id
  HAVING bool_and(r IS NOT NULL) AND bool_and(coalesce(r = 'system', false) OR filled)
     AND bool_and(coalesce(r = 'system', false) OR ((nth % 2 = 1) = (r = 'user')))
     AND sum(CASE WHEN r = 'user' THEN 1 ELSE 0 END) = sum(CASE WHEN r = 'assistant' THEN 1 ELSE 0 END)
     AND sum(CASE WHEN r = 'user' THEN 1 ELSE 0 END) > 0)
SELECT thread_id, CAST(turn_no AS INTEGER) AS turn_no, message_id FROM n
WHERE thread_id IN (SELECT thread_id FROM k) AND thread_id IN (SELECT thread_id FROM chat_threads)
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
