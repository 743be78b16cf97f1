"""The SQL twins of the catalog's queries."""

from __future__ import annotations

from codestrata.functions import paths, text

_C = "(SELECT DISTINCT * FROM code_chunks)"


def _q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _case(table: dict, key: str, other: str) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in table.items()) + f" ELSE {other} END"


def _name(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def _ending(p: str) -> str:
    return f"lower(regexp_extract({_name(p)}, '\\.([A-Za-z0-9]+)$', 1))"


def _dir(p: str, root: str = "") -> str:
    return f"CASE WHEN contains({p}, '/') THEN regexp_extract({p}, '^(.*)/[^/]*$', 1) ELSE '{root}' END"


def _first(table: dict, p: str, other: str) -> str:
    """The value of the first path segment that the table knows."""
    keys = "|".join(table)
    seg = f"regexp_extract(lower({p}), '(?:^|/)({keys})(?:/|$)', 1)"
    return _case(table, seg, other)


# Fixed values, kept apart from the engine's: what a view of a repository ranks first.
_ENTRIES = "'main.py','app.py','index.py','__main__.py','manage.py','wsgi.py','asgi.py','index.js','index.ts','main.js','main.ts','app.js','app.ts','server.js','server.ts','index.jsx','index.tsx','App.jsx','App.tsx','main.go','Main.java','Program.cs','main.rs','lib.rs'"
_CONFIGS = "'pyproject.toml','setup.py','setup.cfg','requirements.txt','Pipfile','package.json','tsconfig.json','webpack.config.js','vite.config.ts','next.config.js','next.config.ts','tailwind.config.js','tailwind.config.ts','Cargo.toml','go.mod','pom.xml','build.gradle','Gemfile','composer.json','Dockerfile','docker-compose.yml','docker-compose.yaml','.env.example','alembic.ini'"
_SUFFIX = "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]+)$', 1))"
_BASENAME = "regexp_extract(path, '([^/]*)$', 1)"
_PRIORITY = f"""CASE WHEN {_BASENAME} IN ({_ENTRIES}) THEN 1 WHEN {_BASENAME} IN ({_CONFIGS}) THEN 2
  WHEN {_SUFFIX} IN ('json','yaml','yml','toml','ini','cfg','conf') THEN CASE WHEN contains(path, '/') THEN 3 ELSE 2 END
  WHEN regexp_matches(lower(path), '(^|/)(src|lib|core|services|domain|models|entities|utils|helpers|common|alembic|migrations)(/|$)') THEN 3
  WHEN regexp_matches(lower(path), '(^|/)(api|routes|controllers|handlers|endpoints|views|resources)(/|$)') THEN 4 ELSE 5 END"""


def _tidy(p: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(trim({p}), '\\\\', '/', 'g'), '/(?:\\./)*/*', '/', 'g'), '^(?:\\./|/)+', '')"


def _skipped(p: str) -> str:
    return f"regexp_matches({p}, '(?:^|/)(?:{'|'.join(x.replace('.', chr(92) + '.') for x in paths.SKIPPED_FOLDERS)}|\\.[^/]*)/')"


def _count(pattern: str, c: str, flags: str = "(?i)") -> str:
    return f"len(regexp_extract_all({c}, '{flags}{pattern}'))"


def _decisions(lang: str, c: str) -> str:
    return "1 + " + " + ".join(_count(p, c) for p in text.DECISIONS[lang])


_LINES = "CASE WHEN length(content) = 0 THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN right(content, 1) = chr(10) THEN 0 ELSE 1 END END"
_TODO = "len(list_filter(string_split(upper(content), chr(10)), lambda x: contains(x, 'TODO') OR contains(x, 'FIXME')))"
_NOTES = "len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(trim(x), '^(?:#|//|/\\*|\\*)')))"
_LANG = f"coalesce(lower(language), {_case(paths.LANGUAGES, _ending('file_path'), chr(39) + 'text' + chr(39))})"
_SCORE = "round(o_totalprice % 100.0, 2)"
_CHURN = """
SELECT 'services/part_' || l_partkey || '.py' AS file_path, count(*) AS changes,
       count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '2001-11-04' - INTERVAL {short} DAY) AS changes_short,
       count(DISTINCT l_suppkey) AS authors, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines_added
FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-11-04' - INTERVAL {long} DAY AND l_shipdate <= TIMESTAMP '2001-11-04' GROUP BY 1"""
_OBJ = f"(SELECT {_tidy('path')} AS path, max(size_bytes) AS size_bytes FROM repo_content_objects GROUP BY 1)"
_TREE = f"""
WITH o AS (SELECT * FROM {_OBJ} WHERE NOT regexp_matches(path, '(?:^|/)(?:\\.git|__pycache__|\\.DS_Store)(?:/|$)')),
s AS (SELECT string_split(path, '/') AS p FROM o WHERE contains(path, '/')),
d AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS path FROM (SELECT p, unnest(range(1, len(p))) AS n FROM s)),
t AS (
  SELECT path, {_name('path')} AS name, 'file' AS type, CAST(size_bytes AS BIGINT) AS size_bytes FROM o
  UNION ALL SELECT path, {_name('path')}, 'directory', NULL FROM d)
"""
_MSG = "(SELECT message_id, min(struct_pack(t := thread_id, c := created_at, r := context_ref)) AS r FROM chat_messages GROUP BY 1)"
_VEC = "chunk_vectors"
_USABLE = "len(embedding) = {n} AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)"


def _topk(expr: str) -> str:
    return f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {expr}), 6)"


_Q11 = "list_transform(range(0, 128), lambda i: CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END)"
_Q1 = "list_transform(range(0, 128), lambda i: CASE WHEN i % 2 = 1 THEN 0.5 ELSE -0.25 END)"
_EV = "events"

_LANG = f"coalesce(lower(language), {_case(paths.LANGUAGES, _ending('file_path'), chr(39) + 'text' + chr(39))})"
SQL: dict[str, str] = {
    "s6_languages": f"SELECT {_case(paths.LANGUAGES, _ending('file_path'), chr(39) + 'text' + chr(39))} AS detected, count(DISTINCT file_path) AS files, count(*) AS chunks FROM {_C} GROUP BY 1",
    "s4_full_tree": _TREE + "SELECT * FROM t",
    "f14_children": _TREE + "SELECT name, type FROM t WHERE NOT contains(path, '/')",
    "s3_embeddable": f"SELECT DISTINCT object_id, path, size_bytes FROM repo_content_objects WHERE {_ending('path')} IN ({_q(paths.CODE_ENDINGS)}) AND NOT {_skipped('path')} AND size_bytes BETWEEN 50 AND 102400",
    "s5_line_counts": f"SELECT chunk_id, CAST({_LINES} AS INTEGER) AS lines, CAST({_TODO} AS INTEGER) AS todos, CAST({_NOTES} AS INTEGER) AS comments FROM {_C} WHERE content IS NOT NULL",
    "f13_f16_embedding_text": f"""
SELECT chunk_id, CAST(length(t) AS INTEGER) AS chars, substr(t, 1, 200) AS head FROM (
  SELECT chunk_id, concat_ws(chr(10), CASE WHEN file_path <> '' THEN 'File: ' || file_path END, CASE WHEN name <> '' THEN 'Name: ' || name END,
    CASE WHEN chunk_type <> '' THEN 'Type: ' || chunk_type END, CASE WHEN docstring <> '' THEN 'Description: ' || docstring END, content) AS t
  FROM {_C} WHERE length(content) >= 10)""",
    "f17_grades": f"""
SELECT CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' WHEN s IS NOT NULL THEN 'F' END AS grade,
       CASE WHEN s >= 75 THEN 'low' WHEN s >= 55 THEN 'medium' ELSE 'high' END AS debt,
       CASE WHEN s >= 80 THEN 'green' WHEN s >= 60 THEN 'amber' WHEN s >= 40 THEN 'orange' ELSE 'red' END AS colour, count(*) AS n
FROM (SELECT {_SCORE} AS s FROM orders) GROUP BY ALL""",
    "f21_priorities": f"""
SELECT path, CAST({_PRIORITY} AS INTEGER) AS priority,
  {_first(paths.LAYERS, 'path', chr(39) + 'unknown' + chr(39))} AS layer, ({' OR '.join(f"contains(lower(path), '{m}')" for m in paths.TEST_MARKS)}) AS is_test
FROM (SELECT DISTINCT path FROM repo_content_objects)""",
    "j3_latest_upload": f"""
WITH o AS (SELECT {_tidy('path')} AS p, object_id, row_number() OVER (PARTITION BY {_tidy('path')} ORDER BY created_at DESC, object_id DESC) AS k FROM repo_content_objects WHERE status = 'ready')
SELECT f.file_path, o.object_id FROM (SELECT DISTINCT file_path FROM code_chunks) f LEFT JOIN o ON o.p = f.file_path AND o.k = 1""",
    "j10_nearest": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS near, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, near) AS INTEGER) AS nth FROM p)
SELECT * FROM r WHERE nth <= 3""",
    "j11_top_k": f"SELECT vec_id, {_topk(_Q11)} AS score FROM {_VEC} WHERE language = 'python' AND {_USABLE.format(n=128)} ORDER BY score DESC, vec_id LIMIT 20",
    "j14_imports": f"""
SELECT DISTINCT chunk_id, unnest(CASE WHEN lower(language) = 'python' THEN list_concat(regexp_extract_all(content, '(?m)^\\s*from\\s+([\\w.]+)\\s+import', 1), regexp_extract_all(content, '(?m)^\\s*import\\s+([\\w.]+)', 1))
  WHEN lower(language) IN ('javascript', 'typescript', 'js', 'ts') THEN list_concat(regexp_extract_all(content, 'import\\s+.*?\\s+from\\s+[''"]([^''"]+)[''"]', 1), regexp_extract_all(content, 'require\\s*\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1))
  ELSE [] END) AS module FROM {_C} WHERE content IS NOT NULL""",
    "j15_orphans": f"SELECT DISTINCT {_tidy('path')} AS path FROM repo_content_objects WHERE {_tidy('path')} NOT IN (SELECT file_path FROM code_chunks WHERE file_path IS NOT NULL)",
    "a1_totals": f"""
SELECT repository_id, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, count(*) FILTER (WHERE lines > 300) AS long_files, count(*) FILTER (WHERE language = 'python') AS python_files,
       count(*) FILTER (WHERE language IN ('javascript', 'typescript')) AS js_ts_files
FROM (SELECT repository_id, file_path, max(line_end) AS lines, lower(max(language)) AS language FROM {_C} GROUP BY 1, 2) GROUP BY 1""",
    "a3_complexity": f"""
SELECT lower(language) AS language, round(CAST(avg(CAST(cyclomatic_complexity AS DECIMAL(12,4))) AS DOUBLE), 4) AS avg_cc, max(cyclomatic_complexity) AS max_cc, count(*) FILTER (WHERE cyclomatic_complexity > 10) AS high,
       count(*) FILTER (WHERE cyclomatic_complexity <= 5) AS rank_a, count(*) FILTER (WHERE cyclomatic_complexity > 5 AND cyclomatic_complexity <= 10) AS rank_b,
       count(*) FILTER (WHERE cyclomatic_complexity > 10 AND cyclomatic_complexity <= 20) AS rank_c, count(*) FILTER (WHERE cyclomatic_complexity > 20 AND cyclomatic_complexity <= 30) AS rank_d,
       count(*) FILTER (WHERE cyclomatic_complexity > 30 AND cyclomatic_complexity <= 40) AS rank_e, count(*) FILTER (WHERE cyclomatic_complexity > 40) AS rank_f
FROM {_C} WHERE cyclomatic_complexity IS NOT NULL GROUP BY 1""",
    "a10_cluster_stats": """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.label, avg(list_cosine_similarity(a.e, b.e)) AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1),
n AS (SELECT label, count(*) AS n FROM v GROUP BY 1)
SELECT n.label, n, round(coalesce(c, 1.0), 4) AS cohesion, CASE WHEN round(coalesce(c, 1.0), 4) >= 0.7 THEN 'healthy' WHEN round(coalesce(c, 1.0), 4) >= 0.5 THEN 'moderate' ELSE 'scattered' END AS status
FROM n LEFT JOIN p ON n.label = p.label""",
    "a12_gini": f"""
WITH s AS (SELECT repository_id, count(*) AS x FROM {_VEC} GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x, repository_id) AS i FROM s)
SELECT count(*) AS n, round(greatest(0.0, least(1.0, 2.0 * CAST(sum(i * x) AS DOUBLE) / (count(*) * CAST(sum(x) AS DOUBLE)) - (count(*) + 1) / CAST(count(*) AS DOUBLE))), 6) AS gini FROM r""",
    "a14_spread_files": "SELECT file_path, count(DISTINCT chunk_type) AS kinds FROM (SELECT DISTINCT * FROM chunk_matches) GROUP BY 1 HAVING count(DISTINCT chunk_type) >= 2",
    "a15_mean_vectors": f"""
WITH v AS (SELECT {_dir('file_path', 'root')} AS folder, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, 128)) AS i FROM {_VEC} WHERE {_USABLE.format(n=128)}),
m AS (SELECT folder, i, avg(x) AS a, count(*) AS n FROM v GROUP BY 1, 2)
SELECT folder, max(n) AS n, round(sqrt(sum(a * a)), 4) AS norm FROM m GROUP BY 1""",
    "a17_a32_severities": """
SELECT CASE WHEN s <= 1 THEN 'critical' WHEN s = 2 THEN 'high' WHEN s = 3 THEN 'medium' ELSE 'low' END AS severity, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS still_open
FROM (SELECT o_orderstatus, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS s FROM orders) GROUP BY 1""",
    "a19_cache_sizes": "SELECT cache_id, count(*) FILTER (WHERE status = 'ready') AS ready, CAST(coalesce(sum(size_bytes) FILTER (WHERE status = 'ready'), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT * FROM repo_content_objects) GROUP BY 1",
    "a24_duplicates": f"""
WITH c AS (SELECT chunk_id, max(content) AS content, max(line_end - line_start) AS span FROM {_C} WHERE content IS NOT NULL GROUP BY 1)
SELECT min(chunk_id) AS first_id, count(*) AS copies, CAST(sum(span) - arg_min(span, chunk_id) AS BIGINT) AS lines FROM c GROUP BY content HAVING count(*) > 1""",
    "a25_common_folder": f"""
WITH c AS (SELECT repository_id, string_split(min(file_path), '/') AS x, string_split(max(file_path), '/') AS y FROM {_C} GROUP BY 1)
SELECT repository_id, array_to_string(x[1:len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i]))], '/') AS prefix FROM c""",
    "a30_dashboard": f"""
SELECT count(*) AS total, count(*) FILTER (WHERE s >= 80) AS healthy, count(*) FILTER (WHERE s < 60 AND s <> 0) AS attention, round(CAST(avg(CAST(coalesce(s, 0) AS DECIMAL(12,2))) AS DOUBLE), 4) AS average
FROM (SELECT {_SCORE} AS s FROM orders)""",
    "a9_churn": _CHURN.format(long=365, short=30),
    "hot_spots": f"""
WITH c AS ({_CHURN.format(long=730, short=90)}),
r AS (SELECT c.*, CASE WHEN p_size > 5 THEN p_size / 50.0 END AS cov FROM c JOIN part ON c.file_path = 'services/part_' || p_partkey || '.py' WHERE changes > 5)
SELECT file_path, changes, changes_short, authors, lines_added,
       round(0.30 * least(100.0, 3.0 * changes) + 0.30 * CASE WHEN cov IS NULL THEN 50.0 ELSE greatest(0.0, least(100.0, 100.0 - 100.0 * CAST(cov AS DOUBLE))) END + 0.20 * 100 + 0.20 * least(100.0, 15.0 * authors), 3) AS risk_score,
       CAST((CASE WHEN changes > 10 THEN 1 ELSE 0 END) + (CASE WHEN authors > 2 THEN 1 ELSE 0 END) + (CASE WHEN lines_added > 500 THEN 1 ELSE 0 END) + (CASE WHEN cov IS NULL OR cov < 0.5 THEN 1 ELSE 0 END) AS INTEGER) AS factors
FROM r""",
    "c1_dead_code_impact": f"""
SELECT chunk_id, round(least(100.0, greatest(0.0, 0.40 * least(100.0, greatest(0.0, 2.0 * lines)) + 0.30 * {_first(paths.LOCATION_SCORES, 'file_path', '50')} + 10.0 + 0.10 * CASE WHEN cc IS NULL THEN 50.0 ELSE least(100.0, greatest(0.0, cc)) END)), 3) AS impact
FROM (SELECT chunk_id, max(file_path) AS file_path, max(line_count) AS lines, max(cyclomatic_complexity) AS cc FROM {_C} WHERE chunk_type IN ('function', 'method') GROUP BY 1)""",
    "m9_chunk_complexity": f"""
SELECT DISTINCT chunk_id, CAST(CASE WHEN l = 'python' THEN {_decisions('python', 'content')} WHEN l IN ('javascript', 'typescript') THEN {_decisions('javascript', 'content')} WHEN l = 'go' THEN {_decisions('go', 'content')}
  WHEN l = 'java' THEN {_decisions('java', 'content')} ELSE {_decisions('', 'content')} END AS INTEGER) AS cc
FROM (SELECT chunk_id, content, {_LANG} AS l FROM code_chunks WHERE content IS NOT NULL)""",
    "w2_newest_uploads": "SELECT cache_id, object_id, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY cache_id ORDER BY created_at DESC, object_id) AS k FROM (SELECT DISTINCT * FROM repo_content_objects)) WHERE k <= 5",
    "w4_history": f"""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, {_SCORE} AS s FROM orders),
t AS (SELECT *, lag(s) OVER w AS prev, round(s - first_value(s) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS d FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey, s, prev, CASE WHEN d > 5 THEN 'improving' WHEN d < -5 THEN 'declining' ELSE 'stable' END AS trend FROM t""",
    "w5_numbered": """
WITH p AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'sec' WHEN '2-HIGH' THEN 'db' WHEN '3-MEDIUM' THEN 'api' ELSE 'oth' END AS p FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY o_orderkey) AS n FROM p)
SELECT o_orderkey, p || '-' || CASE WHEN n > 999 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 3, '0') END AS label FROM n""",
    "w14_last_messages": """
WITH m AS (SELECT message_id, min(thread_id) AS thread_id, min(created_at) AS created_at FROM chat_messages GROUP BY 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, message_id DESC) AS INTEGER) AS k FROM m)
SELECT thread_id, message_id, k FROM r WHERE k <= 10""",
    "t5_most_complex": f"SELECT chunk_id, max(cyclomatic_complexity) AS cc, max(name) AS name FROM {_C} GROUP BY 1 HAVING max(cyclomatic_complexity) IS NOT NULL ORDER BY cc DESC, chunk_id LIMIT 10",
    "t13_recent_threads": "SELECT thread_id, model FROM (SELECT DISTINCT * FROM chat_threads) ORDER BY updated_at DESC, thread_id LIMIT 20",
    "t1_page": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    "u1_context_first": f"""
WITH v AS (SELECT vec_id, file_path, {_topk(_Q1)} AS score FROM {_VEC} WHERE {_USABLE.format(n=128)}), f AS (SELECT min(file_path) AS f FROM chunk_vectors),
a AS (SELECT vec_id, 0 AS branch, score FROM v, f WHERE file_path = f ORDER BY score DESC, vec_id LIMIT 2), b AS (SELECT vec_id, 1 AS branch, score FROM v, f WHERE file_path <> f ORDER BY score DESC, vec_id LIMIT 5)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY branch, score DESC, vec_id LIMIT 5""",
    "u8_findings": """
SELECT 'outlier' AS kind, file_path, round(100 * confidence, 2) AS score FROM (SELECT DISTINCT * FROM outlier_info)
UNION ALL SELECT 'scattered', name, round(100 * (1 - cohesion), 2) FROM (SELECT DISTINCT * FROM cluster_info) WHERE cohesion < 0.5""",
    "g3_unreachable": """
WITH RECURSIVE e AS (
  SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
r AS (SELECT 'r0' AS id UNION SELECT e.b FROM r JOIN e ON e.a = r.id)
SELECT DISTINCT b AS id FROM e WHERE b NOT IN (SELECT id FROM r)""",
    "k6_new_uploads": """
WITH o AS (SELECT DISTINCT cache_id, path, status, size_bytes FROM repo_content_objects)
SELECT n.cache_id, n.path, max(n.size_bytes) AS size_bytes FROM o n WHERE n.status <> 'ready' AND NOT EXISTS (SELECT 1 FROM o x WHERE x.status = 'ready' AND x.cache_id = n.cache_id AND x.path = n.path) GROUP BY 1, 2""",
    "k7_upsert": "SELECT id, max(name) AS name, CAST(CASE WHEN max(file_count) > 3 THEN max(file_count) + 1 ELSE max(file_count) END AS INTEGER) AS file_count FROM cluster_info GROUP BY id",
    "r_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS kind, count(*) AS events FROM events GROUP BY 1, 2",
    "r2_last_values": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "r4_transitions": """
WITH e AS (SELECT coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'none') AS before, event_type AS after FROM events)
SELECT before, after, (before || '>' || after) IN ('none>signup', 'none>view', 'signup>view', 'view>view', 'view>click', 'click>view', 'click>purchase', 'purchase>view') AS valid, count(*) AS n FROM e GROUP BY 1, 2, 3""",
    "r_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT user_id, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1""",
    "w12_heartbeats": """
WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT user_id, count(*) AS beats FROM g WHERE gap IS NULL OR gap >= 3600000000 GROUP BY 1""",
    "i2_json_fields": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "d4_grep": f"""
SELECT DISTINCT chunk_id, CAST(i AS INTEGER) AS line_no, trim(line) AS line FROM (SELECT chunk_id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM {_C} WHERE content IS NOT NULL)
WHERE regexp_matches(line, '\\braise \\w+|\\bthrow new \\w+')""",
}
SQL["u3_shared_imports"] = f"""
WITH m AS ({SQL['j14_imports']}), f AS (SELECT DISTINCT c.file_path, m.module FROM m JOIN code_chunks c ON c.chunk_id = m.chunk_id)
SELECT module, count(*) AS files, min(file_path) AS first_file, max(file_path) AS last_file FROM f GROUP BY 1 HAVING count(*) >= 2"""
SQL["w8_context_switches"] = """
WITH m AS (SELECT message_id, arg_min(thread_id, (thread_id, created_at)) AS thread_id, min(created_at) AS created_at, min(context_ref) AS context_ref FROM chat_messages GROUP BY 1),
p AS (SELECT *, last_value(context_ref IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY created_at, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM m)
SELECT message_id, was, context_ref FROM p WHERE was IS NOT NULL AND context_ref IS NOT NULL AND was <> context_ref"""
SQL["j12_similar_pairs"] = f"""
WITH v AS (SELECT repository_id AS grp, vec_id, embedding FROM chunk_vectors WHERE {_USABLE.format(n=128)}),
f AS (SELECT grp, embedding, min(vec_id) AS id FROM v GROUP BY 1, 2),
p AS (SELECT x.grp, x.id AS a, y.id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS similarity FROM f x JOIN f y ON x.grp = y.grp AND x.id < y.id)
SELECT * FROM p WHERE similarity >= 0.95 UNION ALL SELECT v.grp, f.id, v.vec_id, 1.0 FROM v JOIN f ON v.grp = f.grp AND v.embedding = f.embedding AND v.vec_id <> f.id"""
SQL["m7_heuristics"] = f"""
SELECT DISTINCT chunk_id, {_LINES} AS lines, CAST({_TODO} AS INTEGER) AS todo, CAST({_NOTES} AS INTEGER) AS comments,
  CASE WHEN {_LANG} = 'python' AND (contains(content, 'def ') OR contains(content, 'class ')) AND NOT contains(content, repeat(chr(34), 3)) AND NOT contains(content, chr(39) || chr(39) || chr(39)) THEN 1 ELSE 0 END AS nodoc,
  CASE WHEN {_LANG} = 'python' THEN CAST(len(regexp_extract_all(content, 'def \\w+\\([^)]*\\):')) - len(regexp_extract_all(content, 'def \\w+\\([^)]*\\)\\s*->')) AS INTEGER) ELSE 0 END AS notypes,
  CAST(len(regexp_extract_all(content, '\\b[3-9]\\d+\\b')) AS INTEGER) AS magic
FROM code_chunks WHERE content IS NOT NULL"""
_FILES = "(SELECT repository_id, file_path AS path, max(line_end) AS lines FROM code_chunks GROUP BY 1, 2)"
SQL["m3_architecture"] = f"""
WITH f AS (SELECT *, NOT contains(path, '/') AS root, {_BASENAME} AS name, {_case(paths.LANGUAGES, _ending('path'), "'text'")} AS lang FROM {_FILES}),
s AS (SELECT repository_id, count(*) AS n, count(*) FILTER (WHERE lang = 'python') AS py, count(*) FILTER (WHERE lang IN ('javascript', 'typescript')) AS js,
  bool_or(contains(lower(name), 'test') OR contains(lower(path), '__tests__')) AS tests, bool_or(root AND starts_with(lower(name), 'readme')) AS readme,
  bool_or(NOT root AND split_part(path, '/', 1) IN ('src', 'lib', 'app', 'pkg', 'internal')) AS folders,
  count(*) FILTER (WHERE root AND NOT starts_with(name, '.') AND name NOT IN ('README.md', 'LICENSE', 'package.json', 'pyproject.toml', 'Makefile', 'Dockerfile')) AS roots,
  count(*) FILTER (WHERE lines > 300) AS long FROM f GROUP BY 1)
SELECT repository_id, CAST(least(100.0, greatest(40.0, 70.0 + CASE WHEN greatest(py, js) / CAST(n AS DOUBLE) > 0.7 THEN 10 ELSE 0 END + CASE WHEN tests THEN 5 ELSE 0 END + CASE WHEN readme THEN 5 ELSE 0 END
  + CASE WHEN folders THEN 5 ELSE 0 END - CASE WHEN roots > 10 THEN 5 ELSE 0 END - CASE WHEN long > 0.3 * n THEN 5 ELSE 0 END)) AS DOUBLE) AS architecture FROM s"""
_AVG = "coalesce(cc, 5.0)"
_CURVE = f"CASE WHEN {_AVG} <= 5 THEN 100 - 2 * {_AVG} WHEN {_AVG} <= 10 THEN 90 - 4 * ({_AVG} - 5) WHEN {_AVG} <= 20 THEN 70 - 3 * ({_AVG} - 10) ELSE greatest(0.0, 40 - ({_AVG} - 20)) END"
_METRICS = f"""
h AS ({SQL['m7_heuristics']}),
c AS (SELECT DISTINCT c.chunk_id, repository_id, file_path, line_count, cyclomatic_complexity, {_LINES} AS lines, {_TODO} AS todo, {_NOTES} AS comments, len(regexp_extract_all(content, '\\b[3-9]\\d+\\b')) AS magic, h.nodoc, h.notypes
  FROM code_chunks c JOIN h ON h.chunk_id = c.chunk_id AND h.lines = {_LINES} AND h.todo = {_TODO} AND h.magic = len(regexp_extract_all(content, '\\b[3-9]\\d+\\b')) WHERE content IS NOT NULL),
r AS (SELECT repository_id, count(DISTINCT file_path) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(magic) AS BIGINT) AS magic, CAST(sum(todo) AS BIGINT) AS todo, CAST(sum(comments) AS BIGINT) AS comments,
  CAST(sum(nodoc) AS BIGINT) AS nodoc, CAST(sum(notypes) AS BIGINT) AS notypes, CAST(avg(CAST(cyclomatic_complexity AS DECIMAL(12,4))) AS DOUBLE) AS cc, count(*) FILTER (WHERE cyclomatic_complexity > 10) AS complex,
  count(*) FILTER (WHERE line_count > 300) AS long_files FROM c GROUP BY 1)"""
SQL["m1_quality_index"] = f"""
WITH {_METRICS}, a AS ({SQL['m3_architecture']}),
s AS (SELECT *, greatest(0.0, {_CURVE} - least(20.0, 2.0 * long_files)) AS cx,
  greatest(0.0, round(CAST(100 - (least(15.0, magic / greatest(1.0, lines / 1000.0) * 0.5) + least(10.0, CAST(nodoc AS DOUBLE) / greatest(1, files) * 15) + least(10.0, notypes / greatest(1.0, lines / 1000.0) * 0.05)
    + least(10.0, todo / greatest(1.0, lines / 1000.0) * 0.5) + least(10.0, CAST(long_files AS DOUBLE) / greatest(1, files) * 30)) AS DECIMAL(18, 8)), 1)) AS h,
  greatest(50.0, 80.0 - CASE WHEN files > 50 THEN 5 ELSE 0 END - CASE WHEN magic > 50 THEN 10 ELSE 0 END) AS dup FROM r JOIN a USING (repository_id))
SELECT repository_id, files, lines, magic, todo, nodoc, notypes, architecture, CAST(round(CAST(0.25 * cx + 0.25 * dup + 0.30 * h + 0.20 * architecture AS DECIMAL(18, 8)), 2) AS DOUBLE) AS vci FROM s"""
SQL["m5_f22_issue_rules"] = f"""
WITH {_METRICS}
SELECT repository_id, 'complexity' AS kind, CASE WHEN complex < 3 THEN 'low' WHEN complex < 10 THEN 'medium' ELSE 'high' END AS severity, complex AS n, CAST(0.9 AS DOUBLE) AS confidence FROM r WHERE complex > 0
UNION ALL SELECT repository_id, 'long files', CASE WHEN long_files < 3 THEN 'low' ELSE 'medium' END, long_files, 0.95 FROM r WHERE long_files > 0
UNION ALL SELECT repository_id, 'magic numbers', 'low', magic, 0.6 FROM r WHERE magic > 20
UNION ALL SELECT repository_id, 'documentation', 'low', nodoc, 0.75 FROM r WHERE nodoc > 5
UNION ALL SELECT repository_id, 'debt', CASE WHEN todo > 30 THEN 'medium' ELSE 'low' END, todo, 0.95 FROM r WHERE todo > 10
UNION ALL SELECT repository_id, 'comments', 'low', comments, 0.6 FROM r WHERE lines > 100 AND comments / CAST(lines AS DOUBLE) < 0.05"""
SQL["m2_basic_index"] = f"""
WITH f AS (SELECT repository_id, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, count(*) FILTER (WHERE lines > 300) AS long_files FROM {_FILES} GROUP BY 1),
c AS (SELECT repository_id, CAST(avg(CAST(cyclomatic_complexity AS DECIMAL(12,4))) AS DOUBLE) AS cc FROM (SELECT DISTINCT chunk_id, repository_id, cyclomatic_complexity FROM code_chunks) GROUP BY 1),
s AS (SELECT *, lines / CAST(files AS DOUBLE) AS per, greatest(0.0, {_CURVE} - least(30.0, 2.0 * long_files)) AS cx FROM f JOIN c USING (repository_id))
SELECT repository_id, round(round(0.25 * cx + 0.25 * 85.0 + 0.30 * CASE WHEN per <= 100 THEN 100.0 WHEN per <= 200 THEN 90.0 WHEN per <= 300 THEN 75.0 ELSE greatest(40.0, 100 - per / 10) END + 0.20 * 75.0, 2), 1) AS vci FROM s"""
_CC = "(SELECT DISTINCT chunk_id, repository_id, lower(language) AS language, line_count, cyclomatic_complexity FROM code_chunks WHERE cyclomatic_complexity IS NOT NULL)"
SQL |= {
    "a7_merged_complexity": f"""
WITH c AS (SELECT repository_id, CASE WHEN language = 'python' THEN 'syntax' ELSE 'tokens' END AS source, CAST(trunc(cyclomatic_complexity) AS INTEGER) AS x, line_count FROM (SELECT DISTINCT chunk_id, repository_id, language AS raw, lower(language) AS language, line_count, cyclomatic_complexity FROM code_chunks WHERE cyclomatic_complexity IS NOT NULL))
SELECT repository_id, count(*) AS functions, round(avg(x), 4) AS avg, max(x) AS most, count(*) FILTER (WHERE x > 10) AS high, CAST(sum(line_count) AS BIGINT) AS nloc, count(*) FILTER (WHERE x <= 5) AS rank_a, count(*) FILTER (WHERE x > 5 AND x <= 10) AS rank_b,
  count(*) FILTER (WHERE x > 10 AND x <= 20) AS rank_c, count(*) FILTER (WHERE x > 20 AND x <= 30) AS rank_d, count(*) FILTER (WHERE x > 30 AND x <= 40) AS rank_e, count(*) FILTER (WHERE x > 40) AS rank_f, string_agg(DISTINCT source, '+' ORDER BY source) AS complexity_source FROM c GROUP BY 1""",
    "a3_most_complex": """
WITH c AS (SELECT chunk_id, lower(max(language)) AS language, max(cyclomatic_complexity) AS cc FROM code_chunks GROUP BY 1 HAVING max(cyclomatic_complexity) IS NOT NULL AND max(language) IS NOT NULL)
SELECT language, chunk_id, cc, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY cc DESC, chunk_id) AS k FROM c) WHERE k <= 10""",
    "a2_u7_languages": """
SELECT repository_id, coalesce(string_agg(DISTINCT lower(language), ',' ORDER BY lower(language)), '') AS languages, coalesce(string_agg(DISTINCT lower(language), ',' ORDER BY lower(language)) FILTER (WHERE lower(language) <> 'python'), '') AS others FROM code_chunks GROUP BY 1""",
    "a10_repository_stats": """
WITH l AS (SELECT repository_id, lower(language) AS l, count(*) AS n FROM chunk_vectors WHERE language IS NOT NULL GROUP BY 1, 2),
d AS (SELECT repository_id, l FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY n DESC, l) AS k FROM l) WHERE k = 1)
SELECT v.repository_id, count(*) AS chunks, count(DISTINCT file_path) AS files, max(d.l) AS dominant FROM chunk_vectors v LEFT JOIN d ON d.repository_id = v.repository_id GROUP BY 1""",
    "a13_outlier_share": "SELECT o AS outliers, v AS chunks, CASE WHEN v > 0 THEN round(100.0 * o / v, 1) ELSE 0.0 END AS percent FROM (SELECT count(*) AS o FROM (SELECT DISTINCT * FROM outlier_info)), (SELECT count(DISTINCT vec_id) AS v FROM chunk_vectors)",
    "a22_hot_concerns": f"""
WITH c AS ({_CHURN.format(long=730, short=90)}), j AS (SELECT c.*, CASE WHEN p_size > 5 THEN p_size / 50.0 END AS cov FROM c LEFT JOIN part ON c.file_path = 'services/part_' || p_partkey || '.py' WHERE changes > 5)
SELECT count(*) AS n, arg_max(file_path, (changes, file_path)) AS most_changed, count(*) FILTER (WHERE cov < 0.5) AS untested FROM j""",
    "a23_scan_totals": """
WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY updated_at DESC NULLS LAST, thread_id DESC NULLS LAST, tokens_used DESC NULLS LAST, created_at DESC NULLS LAST, content DESC NULLS LAST) AS k FROM chat_messages) WHERE k = 1 AND thread_id IS NOT NULL)
SELECT thread_id, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS tokens, round(coalesce(sum(tokens_used), 0) / 1000.0 * 0.003, 6) AS cost, arg_min(message_id, (created_at, message_id)) FILTER (WHERE trim(content, ' ') <> '') AS first_message FROM m GROUP BY 1""",
    "a31_counters": """
SELECT (SELECT count(DISTINCT id) FROM cluster_info) AS clusters, (SELECT count(*) FROM (SELECT DISTINCT * FROM outlier_info)) AS outliers,
  (SELECT count(*) FROM (SELECT file_path FROM chunk_matches GROUP BY 1 HAVING count(DISTINCT chunk_type) >= 2)) + least(10, (SELECT count(*) FROM (SELECT DISTINCT * FROM outlier_info) WHERE nearest_similarity < 0.4)) AS debt""",
    "a33_axis": f"SELECT o_custkey, round(greatest(0.0, min(s) - 10), 2) AS low, round(least(100.0, max(s) + 10), 2) AS high FROM (SELECT o_custkey, {_SCORE} AS s FROM orders) GROUP BY 1",
    "u9_debt_spots": """
SELECT file_path, 'coupling' AS why, CASE WHEN count(DISTINCT chunk_type) >= 4 THEN 'critical' ELSE 'high' END AS severity FROM chunk_matches WHERE file_path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT chunk_type) >= 2
UNION ALL SELECT file_path, 'outlier', 'medium' FROM (SELECT file_path, min(nearest_similarity) AS s FROM outlier_info WHERE nearest_similarity < 0.4 GROUP BY 1 ORDER BY s, file_path NULLS FIRST LIMIT 10)""",
    "f9_open_findings": "SELECT DISTINCT id, name FROM cluster_info WHERE status IS NULL OR lower(trim(status)) <> 'dismissed'",
    "f10_worst_first": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderkey LIMIT 10",
    "t3_t4_pages": "SELECT o_custkey, count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages, count(*) > 10 AS has_more FROM orders GROUP BY 1",
    "t9_dead_by_impact": f"SELECT * FROM ({SQL['c1_dead_code_impact']}) ORDER BY impact DESC, chunk_id LIMIT 20",
    "s8_t12_view_files": f"""
WITH p AS (SELECT DISTINCT cache_id, path, CAST({_PRIORITY} AS INTEGER) AS priority FROM repo_content_objects WHERE path IS NOT NULL AND (
  {_SUFFIX} IN ('py','js','jsx','ts','tsx','java','go','rs','rb','php','c','cpp','h','hpp','cs','swift','kt','scala','vue','svelte','json','yaml','yml','toml','ini','cfg','conf','md','rst','txt') OR {_BASENAME} IN ({_CONFIGS}) OR starts_with({_BASENAME}, 'Dockerfile')))
SELECT cache_id, path, priority, CAST(row_number() OVER (PARTITION BY cache_id ORDER BY priority, path) AS INTEGER) AS nth FROM p""",
    "d2_excerpts": """
WITH c AS (SELECT DISTINCT chunk_id, content, substr(content, 1, 200) AS h, right(content, 200) AS t FROM code_chunks WHERE content IS NOT NULL),
p AS (SELECT *, CASE WHEN contains(h, chr(10)) THEN length(h) - instr(reverse(h), chr(10)) ELSE -1 END AS lb, instr(t, chr(10)) - 1 AS fb FROM c),
x AS (SELECT chunk_id, CASE WHEN length(content) > 1000 THEN (CASE WHEN lb > 100 THEN substr(h, 1, lb) ELSE h END) || chr(10) || chr(10) || '... [TRUNCATED: ' || (length(content) - 400) || ' characters omitted] ...' || chr(10) || chr(10) || (CASE WHEN fb > 0 AND fb < 100 THEN substr(t, fb + 2) ELSE t END) ELSE content END AS e FROM p)
SELECT DISTINCT chunk_id, CAST(length(e) AS INTEGER) AS chars, md5(e) AS digest FROM x""",
    "d4_line_ranges": "SELECT DISTINCT chunk_id, array_to_string(list_slice(string_split(content, chr(10)), 3, 5), chr(10)) AS lines FROM code_chunks WHERE content IS NOT NULL",
    "j7_dead_with_recency": f"""
WITH c AS (SELECT chunk_id, max(file_path) AS file_path, max(line_count) AS lines, max(cyclomatic_complexity) AS cc FROM code_chunks WHERE chunk_type IN ('function', 'method') GROUP BY 1),
o AS (SELECT {_tidy('path')} AS p, max(created_at) AS stored FROM repo_content_objects GROUP BY 1)
SELECT chunk_id, round(least(100.0, greatest(0.0, 0.40 * least(100.0, greatest(0.0, 2.0 * lines)) + 0.30 * {_first(paths.LOCATION_SCORES, 'file_path', '50')} + 0.20 * CASE WHEN stored IS NULL THEN 50.0 ELSE least(100.0, greatest(0.0, 100.0 - date_diff('day', CAST(stored AS DATE), DATE '2026-01-01'))) END
  + 0.10 * CASE WHEN cc IS NULL THEN 50.0 ELSE least(100.0, greatest(0.0, cc)) END)), 3) AS impact FROM c LEFT JOIN o ON o.p = c.file_path""",
    "w10_budget": f"""
WITH RECURSIVE f AS (SELECT repository_id, file_path AS path, CAST(sum(token_estimate) AS BIGINT) AS t FROM (SELECT DISTINCT chunk_id, repository_id, file_path, token_estimate FROM code_chunks) GROUP BY 1, 2 HAVING sum(token_estimate) IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY {_PRIORITY}, path) AS k FROM f),
z AS (SELECT repository_id AS g, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS p, CAST(0 AS BIGINT) AS size, false AS cut FROM n WHERE k = 1
  UNION ALL SELECT g, s.k, CASE WHEN ok THEN s.used + want ELSE s.used END, CASE WHEN ok THEN s.path END, want, s.cut FROM (
    SELECT z.g, n.k, z.used, n.path, z.used + t > 3960 AND t > 1000 AS cut, CASE WHEN z.used + t > 3960 AND t > 1000 THEN 1000 ELSE t END AS want,
      z.used < 3960 AND z.used + (CASE WHEN z.used + t > 3960 AND t > 1000 THEN 1000 ELSE t END) <= 3960 AS ok FROM z JOIN n ON n.repository_id = z.g AND n.k = z.k + 1) s)
SELECT g AS repository_id, p AS path, size AS tokens, used, cut AS truncated FROM z WHERE p IS NOT NULL""",
}
_TEST = "(" + " OR ".join(f"contains(lower({{p}}), '{m}')" for m in paths.TEST_MARKS) + ")"
_STRIP = "regexp_replace({p}, '\\.(?:tsx|jsx|ts|js|py|mjs|cjs)$', '')"
_BASE = "regexp_replace(regexp_replace({p}, '^(?:test_|Test)', ''), '(?:_test|\\.test|_spec|\\.spec|Test|Spec)$', '')"


def _test_base(p: str) -> str:
    return _BASE.replace("{p}", _STRIP.replace("{p}", _name(p)))


def _v3() -> str:
    from codestrata.functions import scoring

    f, g = "file_path", "coalesce(nearest_file, '')"
    names = _q(scoring.FRAMEWORK_NAMES + scoring.UTILITY_NAMES)
    folders = " OR ".join(f"contains(lower({f}), '{x}')" for x in scoring.UTILITY_FOLDERS)
    suffix = " OR ".join(f"ends_with(n, '{x}')" for x in scoring.PATTERN_SUFFIXES)
    boiler = f"(n <> '' AND ((starts_with(n, '__') AND ends_with(n, '__') AND length(n) > 4) OR lower(n) IN ({names}) OR (length(n) <= 3 AND ({folders})) OR {suffix}))"
    la, lb = (_first(paths.LAYERS, p, "'unknown'") for p in (f, g))
    same = f"({f} <> '' AND {g} <> '' AND ({f} = {g} OR ({_dir(f)} <> '' AND {_dir(f)} = {_dir(g)}) OR ({la} <> 'unknown' AND {lb} <> 'unknown' AND {la} = {lb})))"
    near = f"CASE WHEN {_TEST.replace('{p}', g)} THEN {_test_base(g)} ELSE {_STRIP.replace('{p}', _name(g))} END"
    test = f"CASE WHEN {_TEST.replace('{p}', f)} THEN CASE WHEN {_test_base(f)} <> '' AND {near} <> '' AND lower({_test_base(f)}) = lower({near}) THEN -0.4 WHEN s < 0.4 THEN 0.2 WHEN s > 0.7 THEN 0.1 ELSE 0.0 END ELSE 0.0 END"
    raw = f"0.5 + CASE WHEN {boiler} THEN -0.35 ELSE 0 END + CASE WHEN {f} <> '' AND {g} <> '' AND NOT {same} THEN -0.15 ELSE 0 END + {test} + CASE WHEN s < 0.25 THEN 0.30 ELSE 0 END + CASE WHEN s > 0.8 AND {same} THEN 0.25 ELSE 0 END"
    conf = f"round(least(0.9, greatest(0.1, CAST({raw} AS DOUBLE))), 4)"
    return f"""
WITH o AS (SELECT DISTINCT file_path, chunk_name, nearest_file, nearest_similarity AS s, coalesce(chunk_name, '') AS n FROM outlier_info WHERE nearest_similarity IS NOT NULL),
c AS (SELECT file_path, chunk_name, s, {conf} AS c FROM o)
SELECT DISTINCT file_path, chunk_name, s AS nearest_similarity, c AS confidence_now, CASE WHEN c >= 0.7 THEN 'critical' WHEN c >= 0.5 THEN 'recommended' ELSE 'informational' END AS tier_now FROM c"""


SQL["v3_outlier_confidence"] = _v3()
_MARKS = [".env", "secret", "credential", "private", "token", "password", ".pem", "id_rsa"]
SQL |= {
    "f1_filtered_chunks": "SELECT DISTINCT chunk_id, file_path, substr(commit_sha, 1, 7) AS short_sha, substr(content, 1, 100) AS head FROM code_chunks WHERE lower(language) = 'go' AND chunk_type = 'method' AND NOT starts_with(file_path, 'tests/')",
    "f11_sensitive_paths": "SELECT DISTINCT path FROM repo_content_objects WHERE " + " OR ".join(f"contains(lower(path), '{m}')" for m in _MARKS),
    "a22_concerns": """
WITH c AS (SELECT DISTINCT chunk_id, repository_id, line_count FROM code_chunks WHERE chunk_type = 'function' AND docstring IS NULL)
SELECT repository_id, count(*) AS n, CAST(sum(line_count) AS BIGINT) AS lines, arg_max(chunk_id, (coalesce(line_count, -1), chunk_id)) AS longest FROM c GROUP BY 1""",
    "a23_token_totals": """
WITH m AS (SELECT thread_id, tokens_used FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY updated_at DESC, thread_id DESC, tokens_used DESC NULLS LAST) AS k FROM chat_messages) WHERE k = 1),
t AS (SELECT DISTINCT thread_id, model FROM chat_threads)
SELECT model, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS tokens, count(*) AS messages, count(DISTINCT m.thread_id) AS threads FROM m JOIN t ON m.thread_id = t.thread_id GROUP BY 1""",
    "a26_hit_scores": "SELECT query_chunk_id, count(*) AS hits, round(CAST(avg(CAST(similarity AS DECIMAL(10,6))) AS DOUBLE), 4) AS mean_score FROM (SELECT DISTINCT * FROM chunk_matches) WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND query_chunk_id IS NOT NULL GROUP BY 1",
    "j2_thread_counts": """
SELECT t.thread_id, t.message_count, coalesce(m.found, 0) AS found FROM (SELECT DISTINCT thread_id, message_count FROM chat_threads) t
LEFT JOIN (SELECT thread_id, count(DISTINCT message_id) AS found FROM chat_messages GROUP BY 1) m ON t.thread_id = m.thread_id""",
    "j4_indexed_files": f"SELECT DISTINCT {_tidy('path')} AS path, {_tidy('path')} IN (SELECT file_path FROM code_chunks WHERE file_path IS NOT NULL) AS indexed FROM repo_content_objects",
    "j18_outlier_clusters": """
WITH c AS (SELECT DISTINCT id, unnest(top_files) AS f FROM cluster_info), o AS (SELECT DISTINCT file_path, chunk_name, nearest_file FROM outlier_info)
SELECT file_path, chunk_name, nearest_file, min(id) AS cluster_id FROM o LEFT JOIN c ON c.f = o.nearest_file GROUP BY 1, 2, 3""",
    "t2_by_severity": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 50",
    "t6_top_outliers": "SELECT file_path, chunk_name, confidence FROM (SELECT DISTINCT * FROM outlier_info) WHERE confidence >= 0.4 ORDER BY confidence DESC, file_path, chunk_name NULLS FIRST LIMIT 15",
    "w1_retention": """
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k > 3 AND o_orderdate < TIMESTAMP '2000-11-04'""",
    "w15_tree_lines": _TREE + "SELECT path, repeat('  ', len(string_split(path, '/')) - 1) || name || CASE WHEN type = 'directory' THEN '/' ELSE '' END AS line FROM t WHERE len(string_split(path, '/')) <= 3 ORDER BY path LIMIT 2000",
}
SQL["v4_cluster_health"] = """
WITH c AS (SELECT id, max(cohesion) AS h, max(chunk_count) AS x FROM cluster_info GROUP BY 1 HAVING max(cohesion) IS NOT NULL),
r AS (SELECT h, x, row_number() OVER (ORDER BY x) AS i FROM c),
a AS (SELECT count(*) AS n, CAST(sum(h * x) AS DOUBLE) / sum(x) AS coh, CAST(sum(i * x) AS DOUBLE) AS ix, CAST(sum(x) AS DOUBLE) AS sx FROM r),
o AS (SELECT count(*) AS o FROM (SELECT DISTINCT * FROM outlier_info)), v AS (SELECT count(*) AS v FROM chunk_vectors)
SELECT CAST(floor(least(100.0, greatest(0.0, coalesce(35.0 * coh, 17.5) + greatest(0.0, 30.0 * (1 - 2.0 * o / v)) + CASE WHEN n < 2 THEN 12.5 ELSE 25.0 * (1 - least(1.0, greatest(0.0, 2.0 * ix / (n * sx) - (n + 1) / CAST(n AS DOUBLE)))) END + 10.0))) AS INTEGER) AS score FROM a, o, v"""
SQL |= {
    "c5_actions": f"""
WITH c AS ({_CHURN.format(long=730, short=90)}), r AS (SELECT c.*, CASE WHEN p_size > 5 THEN p_size / 50.0 END AS cov FROM c LEFT JOIN part ON c.file_path = 'services/part_' || p_partkey || '.py' WHERE changes > 5),
t AS (SELECT file_path, CASE WHEN cov IS NULL THEN 'Consider adding test coverage' WHEN cov < 0.5 THEN 'Add tests before next modification' END AS a,
  CASE WHEN changes > 30 THEN 'Review for potential refactoring opportunities' WHEN authors > 3 THEN 'Ensure code review coverage for changes' END AS b FROM r)
SELECT file_path, CASE WHEN a IS NULL AND b IS NULL THEN 'Monitor for continued high change frequency.' ELSE concat_ws('. ', a, b) || '.' END AS action FROM t""",
    "c3_health": """
WITH c AS (SELECT DISTINCT chunk_id, repository_id, file_path, chunk_type, docstring, line_end FROM code_chunks),
p AS (SELECT repository_id, count(*) FILTER (WHERE chunk_type IN ('function', 'method') AND docstring IS NULL) AS dead, count(*) FILTER (WHERE chunk_type IN ('function', 'method')) AS fns, count(*) AS chunks,
  count(DISTINCT file_path) AS files, count(DISTINCT CASE WHEN line_end > 300 THEN file_path END) AS hot FROM c GROUP BY 1),
o AS (SELECT c.repository_id, count(*) AS n FROM (SELECT DISTINCT file_path FROM outlier_info) i JOIN (SELECT DISTINCT repository_id, file_path FROM c) c USING (file_path) GROUP BY 1)
SELECT p.repository_id, CAST(floor(greatest(0.0, 100.0 - least(40.0, CASE WHEN fns > 0 THEN 80.0 * dead / fns ELSE 0 END) - least(30.0, CASE WHEN files > 0 THEN 60.0 * hot / files ELSE 0 END) - least(20.0, 40.0 * coalesce(o.n, 0) / chunks))) AS INTEGER) AS health
FROM p LEFT JOIN o ON o.repository_id = p.repository_id""",
    "v8_resolved_refs": """
WITH b AS (SELECT repository_id, lower(language) AS branch, max(commit_sha) AS sha FROM code_chunks WHERE language IS NOT NULL GROUP BY 1, 2),
l AS (SELECT repository_id, min(commit_sha) AS sha FROM code_chunks GROUP BY 1),
q AS (SELECT DISTINCT repository_id, unnest([commit_sha, ' refs/heads/python ', 'rust', '', NULL]) AS ref FROM code_chunks),
n AS (SELECT *, nullif(regexp_replace(trim(ref), '^refs/heads/', ''), '') AS x FROM q)
SELECT n.repository_id, ref, CASE WHEN regexp_matches(lower(x), '^[0-9a-f]{40}$') THEN x ELSE coalesce(b.sha, l.sha) END AS commit_sha,
  CASE WHEN regexp_matches(lower(x), '^[0-9a-f]{40}$') THEN 'hash' WHEN b.sha IS NOT NULL THEN 'branch' WHEN l.sha IS NOT NULL THEN 'latest' ELSE 'none' END AS source
FROM n LEFT JOIN b ON b.repository_id = n.repository_id AND b.branch = n.x LEFT JOIN l ON l.repository_id = n.repository_id""",
}
