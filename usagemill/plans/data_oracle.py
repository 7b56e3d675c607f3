"""SQL that gives the same rows as the data queries, where SQL can."""

_NODES = """
WITH RECURSIVE named AS (
  SELECT nullif(lower(trim(payload.id)), '') AS node, nullif(lower(trim(payload.forked_from_id)), '') AS parent FROM codex_meta
), nodes AS (
  SELECT node, min(parent) AS parent FROM named WHERE node IS NOT NULL GROUP BY node
), links AS (
  SELECT n.node, p.node AS parent FROM nodes n LEFT JOIN nodes p ON p.node = n.parent
), walk AS (
  SELECT node, parent, node AS root_id, 0 AS depth, node AS node_path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.node, l.parent, w.root_id, w.depth + 1, w.node_path || '/' || l.node FROM links l JOIN walk w ON l.parent = w.node
), endless AS (
  SELECT node, parent FROM links WHERE node NOT IN (SELECT node FROM walk)
), around AS (
  SELECT node AS start, parent AS spot FROM endless
  UNION
  SELECT a.start, e.parent FROM around a JOIN endless e ON e.node = a.spot
), ring AS (
  SELECT DISTINCT start AS node FROM around WHERE start = spot
)"""

_DUPLICATES = """
WITH usage AS (
  SELECT record_id, nullif(trim(message.id), '') AS mid, nullif(trim(requestId), '') AS req, nullif(trim(sessionId), '') AS ses FROM claude_usage
), keyed AS (
  SELECT 'claude_usage' AS table_name, record_id, mid || '|' || CASE WHEN req IS NOT NULL THEN 'r' || req ELSE 's' || ses END AS k FROM usage
  UNION ALL
  SELECT 'codex_records', record_id, nullif(trim(payload.response_id), '') FROM codex_records
), kept AS (
  SELECT table_name, record_id, min(record_id) OVER (PARTITION BY table_name, k) AS keep_id FROM keyed WHERE k IS NOT NULL
), found AS (
  SELECT table_name, keep_id, record_id AS drop_id FROM kept WHERE record_id > keep_id
)"""

_TEXT = "CASE json_type(raw, '$.{p}') WHEN 'OBJECT' THEN coalesce(raw->>'$.{p}.id', raw->>'$.{p}.mode', raw->>'$.{p}') WHEN 'ARRAY' THEN CASE WHEN json_array_length(raw, '$.{p}') = 1 THEN raw->>'$.{p}[0]' ELSE raw->>'$.{p}' END WHEN 'DOUBLE' THEN regexp_replace(raw->>'$.{p}', '[.]0+$', '') ELSE raw->>'$.{p}' END"
_PATHS = ("payload.model", "payload.model_name", "payload.info.model", "message.usage.speed")
_AT = " UNION ALL ".join(f"SELECT src_file, '{p}' AS path, json_type(raw, '$.{p}') AS t FROM log_lines" for p in _PATHS)
_VALUES = " UNION ALL ".join(f"SELECT src_file, '{p}' AS path, json_type(raw, '$.{p}') AS t, raw->>'$.{p}' AS v FROM log_lines" for p in _PATHS)
_STRING = r'"([^"\\\x00-\x1f]|\\(["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_SKELETON = r"^[ \t\n\r]*\{.*\}[ \t\n\r]*$"


def _strict(text: str) -> str:
    """Whether text is one object of strict JSON: the engine's reader is lax about commas, NaN and numbers, so what is left without strings is looked at too."""
    bare = f"regexp_replace({text}, '{_STRING}', '#', 'g')"
    words = f"regexp_replace(regexp_replace({bare}, '-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?', '#', 'g'), 'true|false|null', '#', 'g')"
    return f"(coalesce(json_valid({text}), false) AND regexp_full_match({words}, '[][{{}}:,# \t\n\r]*') AND NOT regexp_matches({words}, ',[ \t\n\r]*[]}}]|##|# +#') AND coalesce(json_type(CASE WHEN json_valid({text}) THEN {text} END) = 'OBJECT', false))"


_CELL = r"""(?:"((?:[^"]|"")*)"|([^",]*))"""
_PARSED = f"""
WITH base AS (SELECT record_id, layout, raw, layout = 'cline_csv' AND regexp_full_match(raw, '(?s){_CELL}(,{_CELL})*') AS quoted, {_strict("raw")} AS sound FROM raw_records),
cells AS (SELECT *, CASE WHEN sound THEN raw END AS good, CASE WHEN quoted THEN regexp_extract_all(raw || ',', '(?s)((?:"(?:[^"]|"")*"|[^",]*)),', 1) END AS f FROM base),
fields AS (SELECT *, len(f) AS n, list_transform(f, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS g FROM cells),
taken AS (SELECT *, CASE WHEN layout = 'cline_csv' THEN g[7] ELSE good->>'$.session.metrics.inputTokens' END AS tokens, CASE WHEN layout = 'cline_csv' THEN g[12] END AS meta, json_type(good, '$.session.metrics.inputTokens') AS kind FROM fields),
judged AS (SELECT *, (layout = 'cline_csv' OR coalesce(kind IN ('VARCHAR', 'UBIGINT', 'BIGINT'), false)) AND regexp_full_match(trim(tokens), '[0-9]+') AND try_cast(trim(tokens) AS HUGEINT) <= 9223372036854775807 AS whole, {_strict("meta")} AS meta_sound FROM taken)
"""

ORACLE = {
    "p1_found": _NODES + """, below AS (
  SELECT a.node, count(*) - 1 AS descendants FROM (SELECT unnest(string_split(node_path, '/')) AS node FROM walk) a GROUP BY a.node
)
SELECT w.node AS node_id, 'tree' AS kind, w.root_id, w.depth::BIGINT AS depth, w.node_path, b.descendants::BIGINT AS descendants FROM walk w JOIN below b ON b.node = w.node
UNION ALL
SELECT node, CASE WHEN node IN (SELECT node FROM ring) THEN 'cycle' ELSE 'below_cycle' END, '', -1, '', -1 FROM endless""",
    "p1_cycles": _NODES + """
SELECT r.node AS node_id, e.parent AS parent_id FROM ring r JOIN endless e ON e.node = r.node
WHERE r.node = (SELECT min(a.spot) FROM around a WHERE a.start = r.node)""",
    "p1_trees": _NODES + """
SELECT root_id, count(*) AS nodes, max(depth)::BIGINT AS max_depth, count(*) FILTER (WHERE node NOT IN (SELECT parent FROM links WHERE parent IS NOT NULL)) AS leaves FROM walk GROUP BY root_id""",
    "p3_found": _DUPLICATES + """, events AS (
  SELECT sessionId AS session_id, project, epoch_ms(try_cast(timestamp AS TIMESTAMPTZ)) AS t FROM claude_usage
  WHERE record_id NOT IN (SELECT drop_id FROM found WHERE table_name = 'claude_usage') AND trim(sessionId) <> ''
    AND regexp_full_match(timestamp, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]{8,}(Z|[+-][0-9]{2}:[0-9]{2})') AND try_cast(timestamp AS TIMESTAMPTZ) IS NOT NULL
), limits AS (
  SELECT e.*, 3600000 * coalesce((SELECT c.commands.blocks.sessionLength FROM report_config c WHERE c.project = e.project), (SELECT c.commands.blocks.sessionLength FROM report_config c WHERE c.project = '*')) AS gap FROM events e
), marked AS (
  SELECT *, CASE WHEN t - lag(t) OVER w > gap THEN 1 ELSE 0 END AS fresh FROM limits WINDOW w AS (PARTITION BY session_id, project ORDER BY t)
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY session_id, project ORDER BY t RANGE UNBOUNDED PRECEDING) AS part FROM marked
)
SELECT session_id, project, min(t) AS start_ms, max(t) AS end_ms, count(*) AS event_count FROM numbered GROUP BY session_id, project, part""",
    "p5_found": _DUPLICATES + " SELECT table_name, keep_id, drop_id FROM found",
    "p5_ranges": """
WITH lines AS (
  SELECT DISTINCT table_name, src_file, line_no::BIGINT AS n FROM (
    SELECT 'claude_usage' AS table_name, src_file, line_no FROM claude_usage UNION ALL SELECT 'codex_records', src_file, line_no FROM codex_records) WHERE line_no IS NOT NULL
), islands AS (SELECT *, n - row_number() OVER (PARTITION BY table_name, src_file ORDER BY n) AS island FROM lines)
SELECT table_name, src_file, min(n) AS first_line, max(n) AS last_line FROM islands GROUP BY table_name, src_file, island""",
    "p5_by_batch": """
WITH keyed AS (
  SELECT 'claude_usage' AS t, batch_id, nullif(trim(message.id), '') || '|' || CASE WHEN trim(requestId) <> '' THEN 'r' || trim(requestId) WHEN trim(sessionId) <> '' THEN 's' || trim(sessionId) END AS k FROM claude_usage
  UNION ALL SELECT 'codex_records', batch_id, nullif(trim(payload.response_id), '') FROM codex_records
), bounds AS (SELECT t, min(batch_id) AS lo, (max(batch_id) - min(batch_id)) // 3 + 1 AS width FROM keyed GROUP BY t),
first AS (SELECT t, k, min(coalesce((batch_id - lo) // width, 0)) AS d FROM keyed JOIN bounds USING (t) WHERE k IS NOT NULL GROUP BY 1, 2)
SELECT b.t AS table_name, n.n::BIGINT AS delivery, count(f.k) AS accepted FROM bounds b CROSS JOIN range(3) AS n(n) LEFT JOIN first f ON f.t = b.t AND f.d = n.n GROUP BY 1, 2""",
    "p6_found": f"""
WITH files AS (SELECT DISTINCT stream, file_seq, src_file FROM log_lines),
chain AS (SELECT src_file, lag(src_file) OVER (PARTITION BY stream ORDER BY file_seq) AS before FROM files),
here AS (SELECT src_file, path, min(CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END) AS kind FROM ({_AT}) WHERE t IS NOT NULL AND t <> 'NULL' GROUP BY 1, 2),
gone AS (SELECT c.src_file, a.path FROM chain c JOIN here a ON a.src_file = c.before WHERE NOT EXISTS (SELECT 1 FROM here b WHERE b.src_file = c.src_file AND b.path = a.path)),
came AS (SELECT c.src_file, b.path FROM chain c JOIN here b ON b.src_file = c.src_file WHERE c.before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM here a WHERE a.src_file = c.before AND a.path = b.path)),
sole AS (SELECT g.src_file FROM gone g GROUP BY 1 HAVING count(*) = 1 INTERSECT SELECT k.src_file FROM came k GROUP BY 1 HAVING count(*) = 1)
SELECT g.src_file, 'renamed' AS change, g.path AS old_path, k.path AS new_path FROM gone g JOIN came k ON k.src_file = g.src_file WHERE g.src_file IN (SELECT src_file FROM sole)
UNION ALL SELECT src_file, 'removed', path, '' FROM gone WHERE src_file NOT IN (SELECT src_file FROM sole)
UNION ALL SELECT src_file, 'added', '', path FROM came WHERE src_file NOT IN (SELECT src_file FROM sole)
UNION ALL SELECT c.src_file, 'retyped', a.path, a.path FROM chain c JOIN here a ON a.src_file = c.before JOIN here b ON b.src_file = c.src_file AND b.path = a.path AND b.kind <> a.kind""",
    "p6_renames": f"""
WITH files AS (SELECT DISTINCT stream, file_seq, src_file FROM log_lines),
chain AS (SELECT src_file, lag(src_file) OVER (PARTITION BY stream ORDER BY file_seq) AS before FROM files),
each AS (SELECT src_file, path, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind, v FROM ({_VALUES}) WHERE t IS NOT NULL AND t <> 'NULL'),
here AS (SELECT src_file, path, min(kind) AS kind, list(DISTINCT v) AS vals FROM each GROUP BY 1, 2),
gone AS (SELECT c.src_file, a.* EXCLUDE (src_file) FROM chain c JOIN here a ON a.src_file = c.before WHERE NOT EXISTS (SELECT 1 FROM here b WHERE b.src_file = c.src_file AND b.path = a.path)),
came AS (SELECT c.src_file, b.* EXCLUDE (src_file) FROM chain c JOIN here b ON b.src_file = c.src_file WHERE c.before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM here a WHERE a.src_file = c.before AND a.path = b.path)),
grams AS (SELECT path, list_distinct(list_transform(range(1, length(path) + 2), lambda i: substr('  ' || replace(path, '_', '.') || ' ', i, 3))) AS g FROM (SELECT unnest([{", ".join(repr(p) for p in _PATHS)}]) AS path)),
pair AS (SELECT g.src_file, g.path AS o, k.path AS n, (len(list_intersect(x.g, y.g)) / len(list_distinct(x.g || y.g)) + (g.kind = k.kind)::INT + len(list_intersect(g.vals, k.vals)) / len(list_distinct(g.vals || k.vals))) / 3 AS s
  FROM gone g JOIN came k ON k.src_file = g.src_file JOIN grams x ON x.path = g.path JOIN grams y ON y.path = k.path),
n AS (SELECT src_file, count(DISTINCT o) AS gs, count(DISTINCT n) AS cs FROM pair GROUP BY 1),
one AS (SELECT p.* FROM pair p JOIN n USING (src_file) WHERE least(gs, cs) = 1 QUALIFY row_number() OVER (PARTITION BY src_file ORDER BY s DESC, o, n) = 1),
two AS (SELECT p.src_file, p.o, p.n, p.s, q.o AS o2, q.n AS n2, q.s AS s2 FROM pair p JOIN pair q ON q.src_file = p.src_file AND q.o > p.o AND q.n <> p.n JOIN n ON n.src_file = p.src_file WHERE least(gs, cs) = 2 QUALIFY row_number() OVER (PARTITION BY p.src_file ORDER BY p.s + q.s DESC, p.o, p.n) = 1),
best AS (SELECT src_file, o, n, s FROM one UNION ALL SELECT src_file, o, n, s FROM two UNION ALL SELECT src_file, o2, n2, s2 FROM two)
SELECT src_file, o AS old_path, n AS new_path, round(s, 6) AS score FROM best WHERE s >= 0.5""",
    "p6_unified": f"""
SELECT line_id, stream, src_file, line_no, coalesce({", ".join(_TEXT.format(p=p) for p in ("payload.model", "message.model", "payload.model_name", "payload.info.model"))}) AS model, {_TEXT.format(p="message.usage.speed")} AS speed FROM log_lines""",
    "p2_found": _PARSED + """
SELECT record_id, CASE WHEN layout <> 'cline_csv' AND NOT sound THEN 'bad_json' WHEN layout = 'cline_csv' AND NOT quoted THEN 'bad_quoting' WHEN layout = 'cline_csv' AND n <> 12 THEN 'column_count' ELSE 'invalid_value' END AS reason FROM judged
WHERE CASE layout WHEN 'cline_csv' THEN NOT coalesce(quoted AND n = 12 AND whole AND (meta = '' OR meta_sound), false) WHEN 'codex_jsonl' THEN NOT (sound AND coalesce(json_type(good, '$.payload.metadata') IN ('NULL', 'OBJECT'), true)) ELSE NOT coalesce(sound AND whole, false) END""",
}
